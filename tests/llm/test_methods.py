"""Operators against plain versions of what they must give."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from vitrine.llm import encode, html, langid, mixing, packing, pii, quality, queries, simhash, tokencount, tokenfile, topk
from vitrine.llm.common import table

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def texts(sf):
    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(encode.vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def strange():
    rng, signs = random.Random(3), [*"ab  \n\t'strvemld.,12é߀漢😀　\x1c\x85​́\x01ΣİŉA", "<|endoftext|>", "'re", "  \n", "<|startoftext|>", "<|", "'S"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    b = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(b.columns)
    wanted = b.project(",".join(columns)).fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, wanted))


def test_registered():
    assert [n for n in entry.queries() if re.match(r"op\d", n)] == list(queries.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize(("pivots", "annulus"), [(8, 16), (64, 4096)])
def test_top_k(spark, pivots, annulus):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 10)) * 3
    x = centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 10)) * 0.2
    x[100:160] = x[100]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(np.int64)
    wanted = []
    for q in range(0, 700, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        wanted += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    got = topk.top_k(df, k=5, pivots=pivots, annulus_rows=annulus).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((a, b, int(c), d) for a, b, c, d in wanted)


def test_quality_windows(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(200)] + [(200, "a b c d e f g h a b c d e"), (201, "x " * 5000)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.ledger(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = t.split()
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        assert got[i] == len({p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})


def test_policies_and_ablations(spark, sf):
    entries = quality.ledger(table(spark, sf, "documents")).cache()
    bits = [r["fail_bits"] for r in entries.collect()]
    for version, p in quality.POLICIES.items():
        assert quality.decide(entries, version).where("kept").count() == sum(not b & p.mask for b in bits)
    for r in quality.ablations(entries).collect():
        bit = 1 << list(quality.RULES).index(r["rule"])
        mask = quality.POLICIES[quality.CURRENT].mask
        assert (r["n_failed"], r["n_alone"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits))


def test_clean_documents_are_kept(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1")
    rows = quality.decide(quality.ledger(docs)).join(labels, "doc_id").collect()
    assert all(r["kept"] or r["fail_bits"] & 3 for r in rows)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x = "</p><article>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><!-- <article>no</article> --><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text&nbsp;here.<p>Second <a href=x>link</a> text.<div class="ad">Buy</div><form><input><label>Name</label></form><ul><li>point</ul>
<section id="comments"><article><p>I am a reader</p></article></section></article><footer>&copy; x</footer>"""


def test_html():
    assert html.main_text(PAGE) == "Title & more\nFirst bold text here.\nSecond link text.\npoint"
    good = "and so it was that the people of the town had to be there with all of their things and more of it " * 3
    plain = f"<body><div><a href=1>a</a> <a href=2>b</a></div><p>{good}</p><p>Short one</p><p>{good}</p><div>Copyright</div>"
    g = " ".join(good.split())
    assert html.main_text(plain) == f"{g}\nShort one\n{g}"
    assert html.main_text("just words") == "just words"
    assert html.main_text("a < b <b>c</b> <p>d<br>e<br><br>f") == "a < b c\nd e\nf"
    assert html.main_text("<nav>menu<article><p>Unclosed menu") == "Unclosed menu"


def test_pages_of_fixture(sf):
    for (page,) in duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet'").fetchall():
        body = page[page.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(re.sub(r"<[^>]+>", "", b).replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").split()) for b in re.split(r"</?h1>|</?p>", body)]
        assert html.main_text(page) == "\n".join(b for b in blocks if b)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    rows = langid.predict(docs.where(langid.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    taken = [r for r in rows if r["accepted"]]
    assert len(taken) > 0.9 * len(rows) and sum(r["lang_pred"] == r["lang"] for r in taken) / len(taken) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (langid.counts("ab" * 3000) == langid.counts("ab" * 3000)).all() and langid.counts("12 !") is None


def test_long_text_counts_alike(monkeypatch):
    t = "palavra comprida e outras " * 50
    whole = langid.counts(t)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert abs(int(langid.counts(t).sum()) - int(whole.sum())) < 0.2 * whole.sum()


def test_token_counts(texts, strange):
    lib = Tokenizer.from_file(encode.vocabulary("byte_bpe_50k.json"))
    mine = tokencount.Counter(encode.vocabulary("byte_bpe_50k.json"), cache_runs=500)
    some = [t for _, t, _, _ in texts] + strange
    assert [mine.count(t) for t in some] == [len(e.ids) for e in lib.encode_batch(some, add_special_tokens=False)]


def test_token_counts_in_parts(texts, strange, monkeypatch):
    mine = tokencount.Counter(encode.vocabulary("byte_bpe_50k.json"))
    some = [t for _, t, _, _ in texts] + strange + ["x" * 5000 + " " + "y" * 300 + "  z", " ".join(strange)]
    whole = [mine.count(t) for t in some]
    monkeypatch.setattr(tokencount, "PART_CHARS", 40)
    monkeypatch.setattr(tokencount, "LONG_RUN", 3)
    assert [mine.count(t) for t in some] == whole


def test_encoder(texts, strange, words):
    some = [t for _, t, _, _ in texts] + strange
    mine = encode.PieceEncoder(encode.vocabulary("word_bpe_49k.json"), cache_bytes=40_000)
    assert [mine.payload(t.encode()) for t in some] == [np.array(e.ids, "<u4").tobytes() for e in words.encode_batch(some, add_special_tokens=False)]


def test_token_file(spark, sf, texts, words):
    got = {r["doc_id"]: r for r in entry.queries()["op6_token_file"](spark, sf).collect()}
    start = 0
    for i, t, _, _ in texts:
        ids = np.array([*words.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    manifest = tokenfile.write_shards(table(spark, sf, "documents"), shards=3)
    found = tokenfile.lookup(manifest, [7, 150, 10**9])
    assert list(found) == [7, 150] and found[7].tolist() == [*words.encode(texts[7][1], add_special_tokens=False).ids, 1]


class Counted:
    """A shard's bytes, and what was read of them."""

    def __init__(self, data):
        self.data, self.reads = data, []

    def __call__(self, at, n):
        self.reads.append(n)
        return self.data[at : at + n]


@pytest.mark.parametrize("n", [0, 1, 20_000])
def test_perfect_hash(n):
    keys = np.sort(np.random.default_rng(4).choice(10**12, n, replace=False).astype(np.int64))
    _, _, value = tokenfile.perfect_hash(keys)
    assert sorted(value.tolist()) == list(range(n))
    ids = np.arange(5 * n, dtype="<u2")
    sizes = np.full(n, 5)
    data = Counted(tokenfile.MAGIC + ids.tobytes() + b"".join(tokenfile.index_bytes(keys, sizes, 2)))
    shard = tokenfile.Shard(data, len(data.data))
    assert (shard.find_all(keys) == np.arange(n)).all() and (shard.find_all(keys + 10**12) == -1).sum() >= 0.99 * n
    for i in range(0, n, 997):
        data.reads.clear()
        assert shard.find(int(keys[i])) == i and shard.payload(i).tolist() == ids[5 * i : 5 * i + 5].tolist()
        assert len(data.reads) < 20 and max(data.reads) <= 16  # whatever the shard's size
        assert shard.find(int(keys[i]) + 10**12) == -1
    with pytest.raises(ValueError):
        tokenfile.perfect_hash(np.array([5, 5]))


def check_packed(rows, capacity):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["sequence_id"]].append((r["offset"], r["length"]))
    for g in groups.values():
        at = 0
        for offset, length in sorted(g):
            assert offset == at
            at += length
        assert at <= capacity
    return len(groups)


def test_packing(spark, sf, texts, words):
    rows = packing.pack_documents(table(spark, sf, "documents")).collect()
    ids = {i: np.array([*words.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t, _, _ in texts}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        assert zlib.crc32(part) == r["ids_crc32"] and r["ids"] == part and r["start"] == 4096 * r["piece"]
    assert check_packed(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)


def fewest(left, bins, capacity, most):
    """Fewest bins by trying every place of every piece."""
    if not left:
        return len(bins)
    for k in range(len(bins)):
        if bins[k] + left[0] <= capacity and bins[k] not in bins[:k]:
            most = min(most, fewest(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]], capacity, most))
    return min(most, fewest(left[1:], [*bins, left[0]], capacity, most)) if len(bins) < most else most


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(20, 61))
    low = (1, capacity // 5, capacity // 4)[seed % 3]
    lengths = rng.integers(low, capacity * 3 // 4, 10)
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = packing.bin_completion(counts, capacity)
    assert sum(n for _, n in found) == fewest(sorted(lengths.tolist(), reverse=True), [], capacity, 10)
    assert all(sum(x * k for x, k in p) <= capacity for p, _ in found)
    assert packing.lower_bound(counts, capacity) <= sum(n for _, n in found) <= sum(n for _, n in packing.best_fit(counts, capacity))


def test_fewer_than_best_fit():
    counts = np.bincount([20, 17, 17, 8, 8, 5, 5, 4, 3, 3], minlength=31)
    assert sum(n for _, n in packing.bin_completion(counts, 30)) == 3


def test_enumerations_started_anew(monkeypatch):
    rng = np.random.default_rng(1)
    some = [np.bincount(rng.integers(8, 30, 14), minlength=41) for _ in range(20)]
    whole = [packing.bin_completion(c, 40) for c in some]
    monkeypatch.setattr(packing, "OPEN", 1)
    assert [packing.bin_completion(c, 40) for c in some] == whole


@pytest.mark.parametrize("seed", range(8))
def test_triplets(seed):
    """Pieces made by cutting full sequences in three, each of more than a quarter: best-fit wastes some."""
    rng, lengths = np.random.default_rng(seed), []
    for _ in range(14):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(251, 1000 - a - 250))
        lengths += [a, b, 1000 - a - b]
    counts = np.bincount(lengths, minlength=1001)
    assert sum(n for _, n in packing.bin_completion(counts, 1000)) == 14


@pytest.mark.parametrize("seed", range(20))
def test_undominated_fillings(seed):
    """Against all sets of pieces, and the definition: each piece of one can be put into the pieces of another."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 16, 7).tolist()
    gap, counts = 15, np.bincount(lengths, minlength=17)
    sets = {tuple(sorted((x for i, x in enumerate(lengths) if m >> i & 1), reverse=True)) for m in range(128)}
    sets = {s for s in sets if sum(s) <= gap}

    def into(small, room):
        return not small or any(r >= small[0] and into(small[1:], (*room[:i], r - small[0], *room[i + 1 :])) for i, r in enumerate(room))

    wanted = {s for s in sets if not any(o != s and into(s, o) for o in sets)}
    got = [tuple(sorted((x for x, k in f.items() for _ in range(k)), reverse=True)) for f in packing.fillings(counts, gap, packing._Work(10**6, 10**6))]
    assert set(got) == wanted and len(got) == len(wanted)
    assert [sum(x) for x in got] == sorted(map(sum, got), reverse=True)


def test_mixing_targets(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 10 + ["b"] * 30 + [None] * 60 + [""] * 5)]
    got = {r["__vt_source"]: r for r in mixing.targets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # weights: '' 5, a 2, b 1, null 5; caps 150, 300, 900, 1800; all sizes 1050
    assert got[""]["target"] == 150
    level = (1050 - 150) / 8
    assert [round(got[s]["target"], 6) for s in ("a", "b", None)] == [2 * level, level, 5 * level]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_bucket=4).collect()
    per = collections.Counter()
    for r in taken:
        per[r["source"]] += r["__vt_taken"]
        assert r["__vt_taken"] <= 30
    assert per == {"": 150, "a": 225, "b": 112, None: 562}


def test_mixed_documents_repeat(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 3 + ["b"] * 30)]
    df = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = collections.Counter(r["doc_id"] for r in df.collect())
    assert all(n[i] == 3 for i in range(3)) and sum(n[i] for i in range(3, 33)) == 24 and max(n[i] for i in range(3, 33)) == 1


IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d(m.group())) <= 19 and luhn(d(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(d(m.group())) <= 15]


def test_pii_base(texts):
    rng = random.Random(5)
    made = ["".join(rng.choice("a1.@-+ 5(2)b%09") for _ in range(rng.randrange(50))) for _ in range(4000)]
    made += ["4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (614) 555-8001 and 1.2.3.4.5.6.7.8", "a@b.c@d.e f@g", "x" * 3000 + "@" + "y" * 3000, "9" * 5000, "1.2.3." * 500]
    for t in [x[1] for x in texts] + made:
        assert pii.base_spans(t) == plain_spans(t)


#: of other templates than the field learned from
HELD_OUT = """
for help dial [phone:(999) 999-9999] today
ring her cell phone [phone:999-999-9999] at noon
Telefon [phone:0999 999999] ab acht Uhr
the ssn [national_id:999-99-9999] was stolen
her passport [national_id:{k9}] , and a bag
hello , my name is [person:@ @] and this is a letter
With [person:Dr. @ @] in the room
I live at [address:999 @ Street] with two cats
her address is [address:99 @ Road]
the child was born on [birth_date:99/99/9999] there
DOB [birth_date:99.99.9999] , female
set password=[secret:{p12}] and go
use token: [secret:{m40}] for now
key [secret:AKIA{k16}] from the bucket
export SECRET_KEY="[secret:{m30}]"
paid into IBAN [iban:XX99 9999 9999 9999 9999 99] last week
it cost 999 or 9,999 in 9999
under the Apache License, Version 9.9 , and so on
the name of the street was lost in the year 9999
chapter 99 , verse 9 , page 999
"""


def test_pii_field(spark, texts):
    field = pii.trained()
    some = {
        "Call (614) 555-8001 now": ["(614) 555-8001"],
        "ssn 123-45-6789.": ["123-45-6789"],
        "I met Dr. Anna Weber yesterday": ["Dr. Anna Weber"],
        "pay DE89 3704 0044 0532 0130 00 now": ["DE89 3704 0044 0532 0130 00"],
        "My name is John Smith and I live at 12 Oak Street": ["12 Oak Street", "John Smith"],
        "phone 0171 2345678 please": ["0171 2345678"],
        "tel: 555 0134": ["555 0134"],
        "SSN 123 45 6789": ["123 45 6789"],
        "passport C01X00T47": ["C01X00T47"],
        "api_key=9f8a7b6c5d4e3f2a1b0c": ["9f8a7b6c5d4e3f2a1b0c"],
        "born on 12/05/1980": ["12/05/1980"],
        "version 3.0, in 1999, at 10:30, for $5,000.00, no 1234567890123456": [],
    }
    assert [[t[s:e] for _, s, e in x] for t, x in zip(some, pii.spans_of(list(some), field)[1], strict=True)] == list(some.values())
    assert pii.spans_of(["+1 (614) 555-8001 here"], field)[1] == [[("phone", 0, 17)]]
    for lines, least in ((pii.LABELLED, 0.98), (HELD_OUT, 0.85)):
        held = pii.labelled(4, 77, lines)
        right = [list(y) == g for (_, _, g), y in zip(held, field.viterbi([field.scores(s, g) for s, g, _ in held]), strict=True)]
        assert sum(right) >= least * len(right)
    assert pii.redacted("mail a@b.co, 1.2.3.4", [("email", 5, 11), ("ip", 13, 20)]) == "mail [EMAIL], [IP]"


def test_planted(spark):
    """Documents that hold an address, a key and the like are found, others are left alone."""
    field = pii.trained()
    rows = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    mark = re.compile(r'@|AKIA|token = "|password=|\+\d|\d+\.\d+\.\d+\.\d+')  # other numbers of 16 digits are no cards
    found = list(zip([bool(mark.search(t) or plain_spans(t)) for t in rows], map(bool, pii.spans_of(rows, field)[1]), strict=True))
    assert found.count((True, True)) >= 0.98 * sum(m for m, _ in found) and found.count((False, True)) == 0


def test_gradients():
    """Of the likelihood, against differences."""
    ids, x, y, mask = pii.encoded(pii.labelled(1, 5)[:12])
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    params = [rng.normal(size=(len(ids) + 1, k)) * 0.3, rng.normal(size=(k, k)) * 0.3, rng.normal(size=k) * 0.3]
    gradients = pii.likelihood(*params, x, y, mask)[1:]
    for p, g in zip(params, gradients, strict=True):
        for at in rng.integers(1, p.size, 12):
            old, h = p.flat[at], 1e-5
            p.flat[at] = old + h
            up = pii.likelihood(*params, x, y, mask)[0]
            p.flat[at] = old - h
            down = pii.likelihood(*params, x, y, mask)[0]
            p.flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / (2 * h), abs=1e-4)


def test_stretches_are_enough(texts):
    """The stretches give what whole texts give."""
    field, rng = pii.trained(), random.Random(8)
    signs = [*"aeT .,;:()-/=_'\"~", "name ", "phone ", "St ", "Straße ", "Hauptstraße ", " the of and to ", " The Of Anna ", "99 ", "12/05/1980", " key", "AKIA", "QWERTYUIOPASDFGH", "漢", "É", "\x1c", " born on ", " live at ", "sk_live_", "a1B2" * 6, " x" * 25, " Xx" * 9]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(1500)]
    some = [t for _, t, _, _ in texts] + made
    assert pii.field_spans(some, field) == pii.field_spans(some, field, whole=True)


def test_dull_tokens_hold_no_span():
    """The bound behind MARGIN, from the weights: over all windows of dull tokens, what a label gains over none."""
    field, dull = pii.trained(), [*pii.DULL, "<>"]
    n, k = len(dull), len(pii.LABELS)
    row = lambda f: field.w[field.ids.get(f, 0)] - field.w[field.ids.get(f, 0)][0]
    most = np.full(k, -np.inf)
    for g in "_.":
        for m in "_.":
            one = np.array([row(f"0{c}") + row(f"1{g}{c}{m}") + row(f"8-|{c}") + row(f"9-|{c}|{g}") + row("B") for c in dull])
            left = np.array([[row(f"2{b}{g}{c}") + row(f"A-|{b}|{c}") for c in dull] for b in dull])
            right = np.array([[row(f"3{c}{m}{d}") for d in dull] for c in dull])
            near = np.array([[[row(f"4{b}{g}{c}{m}{d}") for d in dull] for c in dull] for b in dull]) + left[:, :, None] + right[None] + one[None, :, None]
            before = np.array([[[row(f"5{a}|{b}{g}{c}") for c in dull] for b in dull] for a in dull])
            after = np.array([[[row(f"6{c}{m}{d}|{e}") for e in dull] for d in dull] for c in dull])
            for a in range(n):
                total = (near + before[a][:, :, None])[:, :, :, None] + after[None]
                for key, i in field.ids.items():
                    if key[0] == "7" and (x := key[1:].split("|"))[0] == dull[a] and all(y in dull for y in x) and len(x) == 5:
                        total[tuple(dull.index(y) for y in x[1:])] += field.w[i] - field.w[i][0]
                if a < n - 1:
                    total[-1] = -np.inf  # no text has a token before its first
                total[:, -1] = total[:, :, -1, :-1] = -np.inf
                most = np.maximum(most, total.max((0, 1, 2, 3)))
    pair = field.pair
    slots = [[i for f, i in field.ids.items() if f[0] == s] for s in "0123456789A"]
    for b in range(1, k, 2):
        i = b + 1
        cost = -(most[i] + pair[i, i] - pair[0, 0])
        assert cost > 0.5, (pii.LABELS[i], cost)  # each dull token inside a span
        enter = (pair[:, b] - pair[:, 0])[[j for j in range(k) if pair[j, b] > -1e3]].max()
        leave = lambda x: (pair[x] - pair[0])[[j for j in range(k) if pair[0, j] > -1e3]].max()  # noqa: B023, E731
        assert most[b] + enter + leave(b) < 0 and most[b] + enter + pair[b, i] - pair[0, 0] + most[i] + leave(i) < 0  # no span of dull tokens only
        tail = abs(leave(b) - leave(i)) + abs(pair[i, i] - pair[b, i])
        head = sum(max(0.0, (field.w[s, i] - field.w[s, b]).max()) for s in slots) + abs(pair[i, i]) + abs(enter) + tail
        assert head / cost < pii.MARGIN, (pii.LABELS[b], head, cost)


def test_long_stretch_in_windows(monkeypatch):
    field = pii.trained()
    text = "11 " * 3000 + "password=b7db7aa4a5fcc78305 " + "12 x " * 2000 + "ssn 123-45-6789 " + "7 " * 300
    whole = pii.field_spans([text], field)
    monkeypatch.setattr(pii, "WINDOW", 300)
    assert pii.field_spans([text], field) == whole == pii.field_spans([text], field, whole=True) and len(whole[0]) == 2


def test_viterbi_is_best():
    field = pii.trained()
    rng = np.random.default_rng(0)
    e = rng.normal(size=(3, len(pii.LABELS)))
    got = field.viterbi([e])[0]
    score = lambda y: field.first[y[0]] + e[range(3), y].sum() + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False))
    paths = np.array(np.meshgrid(*[range(len(pii.LABELS))] * 3)).reshape(3, -1).T
    assert score(list(got)) == pytest.approx(max(score(list(p)) for p in paths))


def test_op9_digest(spark, sf, texts):
    got = {r["doc_id"]: r for r in entry.queries()["op9_pii"](spark, sf).collect()}
    for i, t, _, _ in texts:
        s = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in s) for k in pii.BASE_KINDS]


def plain_fingerprint(t):
    w = t.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, fps):
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2)[0]:
            p, q = sorted((find(ids[i]), find(ids[i + 1 + int(j)])))
            root[q] = p
    return {i: find(i) for i in ids}


def test_fingerprints(texts, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for t in [x[1] for x in texts[:60]] + ["", "One", "ONE two", "É é", "a b c"]:
        assert simhash.fingerprint(t.encode()) % (1 << 64) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("most", [512, 3])
def test_links_and_classes(spark, most):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for f in fps[:12]:
        g = f
        for _ in range(rng.randrange(1, 9)):  # chains of one and two bits, in either half or both
            g ^= 1 << rng.randrange(64)
            g ^= (1 << rng.randrange(64)) if rng.random() < 0.6 else 0
            fps.append(g)
    fps += [fps[0] ^ (1 << i) for i in range(20)] + [fps[1] ^ (7 << 3 * i) for i in range(10)] + [0, 3, 2**63, fps[5]]
    rng.shuffle(fps)
    ids = list(range(100, 100 + len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(prints, most).collect()}
    assert got == plain_classes(ids, fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    assert {(r["u"], r["v"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_pipeline_against_plain_stages(spark, sf, texts, words):
    """Each stage of the pipeline on what the one before kept, by plain means."""
    docs, kept = table(spark, sf, "documents"), None
    for (name, stage), at in zip(corpus_pipeline.STAGES, range(5), strict=True):
        out = stage(spark, docs, sf).cache()
        rows = out.collect()
        before = docs.collect()
        if at == 0:
            verdict = {r["doc_id"]: r["kept"] for r in entry.queries()["op2_quality_rules"](spark, sf).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, ok in verdict.items() if ok}
        if at == 1:
            classes = plain_classes([r["doc_id"] for r in before], [plain_fingerprint(r["text"]) for r in before])
            assert {r["doc_id"] for r in rows} == {i for i, c in classes.items() if i == c}
        if at == 2:
            old = {r["doc_id"]: r["text"] for r in before}
            assert len(rows) == len(before)
            added = dict(zip(old, pii.field_spans(list(old.values()), pii.trained(), whole=True), strict=True))
            for r in rows:
                base = plain_spans(old[r["doc_id"]])
                more = [x for x in added[r["doc_id"]] if not any(x[1] < e and s < x[2] for _, s, e in base)]
                assert r["text"] == pii.redacted(old[r["doc_id"]], base + more) and r["n_chars"] == len(r["text"])
        if at == 3:
            size = collections.Counter()
            for r in before:
                size[r["source"]] += len(r["text"].encode().split())
            took = collections.Counter()
            for r in rows:
                took[r["source"]] += len(r["text"].encode().split())
            target = {r["__vt_source"]: r["target"] for r in mixing.targets(docs).collect()}
            longest = max(len(r["text"].encode().split()) for r in before)
            assert all(abs(took[s] - target[s]) <= longest for s in size)
        if at == 4:
            total = sum(len(words.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
            assert sum(r["length"] for r in rows) == total and check_packed(rows, 4096) == -(-total // 4096)
        docs = kept = out
    assert kept.columns[-2:] == ["sequence_id", "offset"]
