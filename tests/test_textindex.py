"""The text index against plain searches of small catalogues: kept and not, with and without a language."""

import math
import random
import re
import time

import pytest
import __spark_entry__ as entry
from vitrine.functions import stem as st
from vitrine.functions import text as tx
from vitrine.functions.analysis import Analyzer
from vitrine.functions.distance import damerau, keys_of, shared_rows
from vitrine.operators import lattice, listing, textindex
from vitrine.operators.textindex import Options, TextIndex, edits_allowed
from vitrine.plans.spec import build
from vitrine.sources import catalogue as c
from vitrine.sources.artefacts import kept

WORDS = "rio rios riso casa casas caso fotografia fotografias fotógrafo fotografai litografia litogarfia janeiro de do the São sao paulo tela telas pintura mito apache apahce".split()


def ids(df):
    return sorted(r["item_id"] for r in df.select("item_id").collect())


@pytest.fixture(scope="module")
def cat(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    items = [(i, "col_a", rng.choice(["publish", "private", "draft"]), some(4), some(4) if i % 3 else None, some(9), 1, None, None) for i in range(60)]
    meta = [(i % 60, 7 + i % 2, some(5), None, None, None) for i in range(90)] + [(3, 9, None, None, None, None)]
    tax = [(i, "t", [some(3) for _ in range(rng.randrange(3))], None) for i in range(40)]
    return c.Catalogue(spark.createDataFrame(items, c.ITEM), spark.createDataFrame(meta, c.METADATA), spark.createDataFrame(tax, c.TAXONOMIES))


@pytest.fixture(scope="module")
def entries(cat):
    """(item, field, words) of every entry."""
    out = []
    for r in cat.items.collect():
        out += [(r["item_id"], f, r[f]) for f in ("title", "description", "content")]
    out += [(r["item_id"], "metadata", r["value_text"]) for r in cat.metadata.collect()]
    out += [(r["item_id"], "taxonomies", " ".join(r["terms"])) for r in cat.taxonomies.collect()]
    return [(i, f, tx.tokens_str(t)) for i, f, t in out if t]


@pytest.fixture(scope="module", params=[(None, True), (None, False), ("portuguese", True), ("portuguese", False)], ids=str)
def index(request, cat, spark, tmp_path_factory):
    language, keeps = request.param
    folder, made = tmp_path_factory.mktemp("index"), {}

    def keep(name, make, folders=()):
        if name not in made:
            make().write.partitionBy(*folders).parquet(f"{folder}/{name}")
            made[name] = spark.read.parquet(f"{folder}/{name}")
        return made[name]

    return TextIndex.build(cat, keep if keeps else None, analyzer=Analyzer(language))


def forms(word, language):
    return {st.stem(w, language) for w in (word, tx.fold_str(word))} if language else {tx.fold_str(word)}


def plain(entries, alternatives, language, fuzzy=False):
    """Items with all words of one alternative in one entry."""
    stop = Analyzer(language).stopwords

    def held(word, words):
        wanted = forms(word, language)
        for w in words:
            if w in stop or tx.fold_str(w) in stop:
                continue
            found = forms(w, language)
            if wanted & found or fuzzy and any(len(a) > 1 and a[0] == b[0] and damerau(a, b) <= edits_allowed(tx.fold_str(word) if not language else max(forms(word, language), key=lambda x: x == st.stem(word, language))) for a in wanted for b in found):
                return True
        return False

    out = set()
    for i, _, words in entries:
        for way in alternatives:
            real = [w for w in way if w not in stop and tx.fold_str(w) not in stop]
            if real and all(held(w, words) for w in real):
                out.add(i)
    return sorted(out)


QUERIES = ["rio", "casa tela", "São Paulo", "rio de janeiro", "Fotografias, RIO", "zzz", "!!", ""]


@pytest.mark.parametrize("text", QUERIES)
def test_all_words_in_one_entry(index, entries, text):
    assert ids(index.all(text)) == plain(entries, [tx.tokens_str(text)], index.analyzer.language)


@pytest.mark.parametrize("text", ["litografia", "fotografai rio", "apache", "rio"])
def test_typing_errors(index, entries, text):
    found = ids(index.fuzzy(text))
    assert found == plain(entries, [tx.tokens_str(text)], index.analyzer.language, fuzzy=True)


def test_rules(index, entries):
    """Two equal rules that meet, one of two words, and a one-way rule."""
    rules = [(["rio de janeiro", "rj", "casa"], []), (["tela", "pintura"], []), (["sao paulo"], ["mito"])]
    ways = [a + b for a in (["rio", "de", "janeiro"], ["rj"], ["casa"]) for b in (["tela"], ["pintura"])]
    found = index.match(index.lattice("rio de janeiro tela", Options(rules=tuple(rules))))
    folded = [(i, f, [tx.fold_str(w) for w in words]) for i, f, words in entries]
    both = sorted(set(plain(entries, ways, index.analyzer.language)) | set(plain(folded, ways, index.analyzer.language)))
    assert ids(found) == both if index.analyzer.language is None else set(ids(found)) <= set(both)
    assert ids(index.synonyms("São Paulo", rules)) == plain(entries, [["mito"]], index.analyzer.language)


def test_phrase(index, entries):
    language = index.analyzer.language
    stop = index.analyzer.stopwords
    q = [(i, w) for i, w in enumerate(["rio", "casa"])]

    def at(words, s):
        return all(s + i < len(words) and words[s + i] not in stop and forms(words[s + i], language) & forms(w, language) for i, w in q)

    assert ids(index.phrase("rio casa")) == sorted({i for i, _, words in entries if any(at(words, s) for s in range(len(words)))})
    assert ids(index.phrase("")) == []


def test_prefix(index, entries):
    language = index.analyzer.language
    stop = index.analyzer.stopwords
    ending = {i for i, _, words in entries if any(k.startswith("foto") for w in words if w not in stop for k in forms(w, language))}
    assert ids(index.prefix("foto")) == sorted(ending)
    assert ids(index.prefix("casa foto")) == sorted(ending & set(plain(entries, [["casa"]], language)))
    assert ids(index.prefix("")) == ids(index.prefix("   ")) == ids(index.prefix("casa !!")) == []
    keys, more = index.completions("", ("title",))
    assert not keys and not more
    keys, more = index.completions("fot", ("title", "content"), most=1)
    assert more and all(len(k) == 1 for k in keys.values())
    keys, more = index.completions("fot", ("title", "content"))
    assert not more and {k for some in keys.values() for k in some} == {k for _, f, words in entries if f in ("title", "content") for w in words for k in forms(w, language) if k.startswith("fot")}


def test_wants_prefix(index):
    assert index.wants_prefix("foto") and not index.wants_prefix("fo") and not index.wants_prefix("rio") and not index.wants_prefix("")
    assert index.wants_prefix("apache pintura telas rio casa") == (not index.all("apache pintura telas rio casa").count())
    before = len(index.memo)
    index.wants_prefix("foto")
    assert len(index.memo) == before  # asked once


def test_scores(index, entries):
    language = index.analyzer.language
    if language:
        assert ids(index.scores("rio casa")) == ids(index.all("rio casa"))
        return
    q = ["rio", "casa"]
    of = [(i, f, [tx.fold_str(w) for w in words]) for i, f, words in entries if words]
    best = {}
    for i, f, words in of:
        if all(w in words for w in q):
            same = [w for _, g, w in of if g == f]
            mean = sum(map(len, same)) / len(same)
            s = 0.0
            for w in q:
                df, tf = sum(w in x for x in same), words.count(w)
                s += math.log(1 + (len(same) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            part = "own" if f in textindex.OWN else f
            best[i, part] = max(best.get((i, part), 0), s * textindex.FIELDS[f])
    wanted = {}
    for (i, _), s in best.items():
        wanted[i] = wanted.get(i, 0) + s
    found = {r["item_id"]: r["score"] for r in index.scores("rio casa").collect()}
    assert found == pytest.approx(wanted) and found


def test_listing(cat, index, entries):
    q = build({"s": "casa", "orderby": "id", "order": "ASC", "posts_per_page": 100}, ("col_a",))
    public = {r["item_id"] for r in cat.items.where("post_status = 'publish'").collect()}
    assert [r["item_id"] for r in listing.page(cat, q, index).collect()] == [i for i in plain(entries, [["casa"]], index.analyzer.language) if i in public]
    by_score = [r["item_id"] for r in listing.page(cat, build({"s": "casa", "posts_per_page": 100}, ("col_a",)), index).collect()]
    assert sorted(by_score) == [i for i in plain(entries, [["casa"]], index.analyzer.language) if i in public]


def test_many_rules_at_once(spark, cat):
    """Thirty words of ten forms are 10 ** 30 alternatives; none is listed."""
    words = [f"w{i}" for i in range(30)]
    rules = tuple(([w, *(f"{w}x{k}" for k in range(9))], []) for w in words)
    text = " ".join(f"{w}x{i % 9}" for i, w in enumerate(words))
    rows = [(1, "col_a", "publish", text, None, None, 1, None, None), (2, "col_a", "publish", text.rpartition(" ")[0], None, None, 1, None, None)]
    index = TextIndex.build(c.Catalogue(spark.createDataFrame(rows, c.ITEM)))
    began = time.time()
    lat = index.lattice(" ".join(words), Options(rules=rules))
    assert len(lat.arcs) == 300 and len(list(lat.ways(7))) == 7 and time.time() - began < 5
    assert ids(index.match(lat)) == [1]


def ways(words, rules):
    of = lambda t: [(w,) for w in t.split()]
    return sorted(lattice.build([(w,) for w in words], [([of(t) for t in left], [of(t) for t in right]) for left, right in rules]).ways())


def test_ways():
    rules = [(["photo", "foto"], []), (["litho", "lito"], [])]
    assert ways(["photo", "litho"], rules) == sorted([["photo", "litho"], ["photo", "lito"], ["foto", "litho"], ["foto", "lito"]])
    assert ways(["gravura", "a"], [(["gravura"], ["estampa"])]) == [["estampa", "a"]]
    assert ways(["errado"], [(["errado"], ["errado", "certo"])]) == sorted([["errado"], ["certo"]])
    assert ways(["rio", "de", "janeiro"], [(["rio de janeiro", "rj"], []), (["rio"], ["rios"])]) == sorted([["rj"], ["rios", "de", "janeiro"], ["rio", "de", "janeiro"]])


def test_keys_of_near_words(spark):
    """Every word within the edits allowed is found by some shared key, short words and long ones, across the bound between them."""
    rng = random.Random(2)
    pairs = []
    for n in [5, 6, 7, 8, 9, 12, 18, 19, 20, 21, 22, 23, 24, 30] * 8:
        w = "".join(rng.choice("abcde") for _ in range(n))
        v = list(w)
        for _ in range(edits_allowed(w)):
            i = rng.randrange(1, len(v))
            match rng.randrange(4):
                case 0:
                    del v[i]
                case 1:
                    v.insert(i, rng.choice("abcde"))
                case 2:
                    v[i] = rng.choice("abcde")
                case _:
                    v[i - 1 : i + 1] = v[i - 1 : i + 1][::-1] if i > 1 else v[i - 1 : i + 1]
        if v[0] == w[0]:
            pairs.append((w, "".join(v)))
    under = {}
    for r in shared_rows(spark.createDataFrame(sorted({(v,) for _, v in pairs}), "key string")).collect():
        under.setdefault(r["key"], set()).add(r["d"])
    assert len(pairs) > 90 and all(under[v] & set(keys_of(w, edits_allowed(w))) for w, v in pairs)


def test_no_python_in_the_search(cat):
    index = TextIndex.build(cat, analyzer=Analyzer("portuguese"))
    for df in (index.fuzzy("litogarfia rio"), index.scores("rio casa"), index.synonyms("rio tela", [(["rio", "casa"], [])])):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_versions():
    assert Analyzer("english").version != Analyzer("german").version != Analyzer("german", frozenset({"x"})).version
    assert Analyzer("english").version == Analyzer("english").version
    with pytest.raises(ValueError, match="no stemmer"):
        Analyzer("klingon")
    a = Analyzer("portuguese")
    assert [p for p, _ in a.query("Vista do Rio de Janeiro")] == [0, 2, 4]  # stop words leave gaps
    assert a.query("São", stop=frozenset({"sao"})) == []


def test_kept_tables_follow_their_sources(spark, tmp_path):
    """A source that is rewritten, or has files added, gives a new answer in the same session; an unchanged one the kept table."""
    path, made = f"{tmp_path}/t.parquet", []

    def ask():
        return kept("numbers", [path], spark, lambda: (made.append(1), spark.read.parquet(path).groupBy().sum("id"))[1]).first()[0]

    spark.range(20).write.parquet(path)
    assert ask() == ask() == 190 and len(made) == 1
    spark.range(40).write.mode("overwrite").parquet(path)
    assert ask() == ask() == 780 and len(made) == 2
    spark.range(1).selectExpr("id + 1000 AS id").write.mode("append").parquet(path)
    assert ask() == 1780 and len(made) == 3
    for n in range(4):
        spark.range(n + 2).write.mode("overwrite").parquet(path)
        assert ask() == sum(range(n + 2))


def test_queries_follow_their_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n in (20, 40):
        docs.where(f"doc_id < {n}").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        texts = docs.where(f"doc_id < {n}").collect()
        words = {tx.fold_str(w) for r in texts for w in re.findall(r"[^\W\d_]+", r["text"] or "") if len(w) >= 2}
        assert entry.queries()["corpus_vocab"](spark, str(tmp_path)).count() == len(words)
        assert entry.queries()["text_and_match"](spark, str(tmp_path)).count() == sum({"the", "apache", "license"} <= set(tx.tokens_str(tx.fold_str(r["text"] or ""))) for r in texts)
