"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import html, langid, mixing, packing, pii, quality, queries, simhash, tokencount, tokenfile, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "una palabra larga y otra mas corta " * 20_000 + "x" * 50_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "", 4), (4, LONG, "es", "a", len(LONG)), (5, "the same text of a few plain words that is here twice", "en", "b", 53)]
    rows += [(5, rows[4][1], "en", "b", 53), (None, "no id but a text of several words in all", "en", "b", 40), (6, "ß😀 é́  <|endoftext|> mail me: a@b.co", "en", None, 30)]
    return spark.createDataFrame(rows, DOCS)


#: names that operators use inside
CLASH = ("fp", "k", "key", "size", "target", "bucket", "__vt", "__vt_w", "__vt_bits", "__vt_size", "__VT_source", "__vt_taken", "__vt_row", "__vt_hash", "n", "p", "rep", "t", "length", "start", "score", "h", "w", "spans", "c", "l", "taken")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where(F.lit(False))


OPERATORS = {
    "ledger": lambda d: quality.decide(quality.ledger(d)),
    "keep": quality.keep,
    "languages": lambda d: langid.predict(d, langid.train(d)),
    "counts": tokencount.token_counts,
    "files": lambda d: tokenfile.read_shards(tokenfile.write_shards(d)),
    "packing": packing.pack_documents,
    "mix": mixing.mix,
    "mixed": mixing.mixed_documents,
    "pii": pii.find,
    "redact": pii.redact,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
}
ONE_EACH = ("ledger", "languages", "counts", "files", "mix", "pii", "redact", "simhash")


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(name, docs, clashing, none):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_EACH:
        assert len(rows) == docs.count()
    assert OPERATORS[name](none).collect() == []
    more = OPERATORS[name](clashing)
    if name in ("keep", "mixed", "redact", "keep_one"):
        assert more.columns == clashing.columns
    assert len(more.collect()) == len(rows)


@pytest.mark.parametrize("at", range(5))
def test_stages(at, spark, docs, clashing, none, sf):
    stage = corpus_pipeline.STAGES[at][1]
    if at == 4:  # pieces and their places, of every row
        got = stage(spark, docs, sf)
        assert got.columns == stage(spark, none, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert stage(spark, none, sf).count() == 0 and got.where("start = 0").count() == docs.count() and stage(spark, clashing, sf).count() == got.count()
        return
    assert stage(spark, none, sf).columns == none.columns and stage(spark, none, sf).count() == 0
    assert stage(spark, docs, sf).columns == docs.columns
    assert stage(spark, clashing, sf).columns == clashing.columns


def test_pages(spark):
    long = "<article>" + "<p>a long text of words</p>" * 30_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", long), (3, "u", long), (None, "u", "<article><p>x &amp; y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["n_chars"], r["text"][:5]) for r in html.extract(df.withColumn("text", F.lit("clash"))).collect()]
    assert got == [(1, 0, ""), (2, 0, ""), (3, 30_000 * 21 - 1, "a lon"), (3, 30_000 * 21 - 1, "a lon"), (None, 5, "x & y")]
    assert html.extract(df.where("page_id = 9")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0]), (2, None), (3, [nan, 1.0]), (4, [inf]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (20, []), (7, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    one = 64 * 64
    assert got == [(0, 1, 6, one + one // 4), (0, 2, 6, one + one // 4), (0, 3, 1, one), (0, 4, 7, 0), (0, 5, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 6, 0), (20, 4, 6, 0), (20, 5, 7, 0)]
    assert topk.top_k(df.where("vec_id = 99")).collect() == []


def test_defined_results(docs):
    q = {r["doc_id"]: r for r in quality.decide(quality.ledger(docs)).collect()}
    assert not q[1]["kept"] and not q[3]["kept"] and q[1]["n_words"] == q[3]["n_words"] == 0
    fps = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert fps[1]["fp"] == fps[2]["fp"] == fps[3]["fp"] == 0 and fps[2]["component_id"] == fps[3]["component_id"] == 1
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["1", "4", "5", "6"]
    t = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs).collect()}
    assert t[1] == t[2] == 0
    p = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert p[1]["lang_pred"] == p[3]["lang_pred"] == "und" and p[4]["lang_pred"] in ("en", "es")
    red = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert red[1]["text"] is None and red[6]["text"].endswith("mail me: [EMAIL]") and red[6]["n_chars"] == len(red[6]["text"])


def test_vectors_of_one_id(spark):
    """Every row is a candidate but the query's own; each row of an id is a query."""
    rows = [(20, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [1.5, 0.0]), (3, [2.0, 0.0]), (40, [0.0, 1.0]), (40, [0.0, 2.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect())
    one = 64 * 64
    assert got == sorted([(20, 1, 3, 2 * one), (20, 2, 3, 2 * one), (20, 3, 3, one + one // 2), *[(40, 1, 40, 2 * one), (40, 2, 3, 0), (40, 3, 3, 0)] * 2])


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op1_top_k", "op3_main_text")])
def test_queries_of_any_table(name, spark, docs, clashing, tmp_path):
    """Each query over nulls, repeated rows and long texts, with and without columns of any names, and over no rows."""
    got = {}
    for kind, df in {"plain": docs, "clash": clashing, "none": docs.where("doc_id = 99")}.items():
        df.write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        found = queries.queries()[name](spark, f"{tmp_path}/{kind}")
        got[kind] = sorted(map(str, found.collect()))
    assert got["plain"] == got["clash"] and got["none"] == []
    assert len(got["plain"]) == docs.count() or name == "op7_packing"


def test_many_languages(spark):
    """More languages than rows to learn from: a row of each."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(260)]
    rows = [(i * 300 + k, " ".join(f"{s}{rng.choice('xyz')}" for _ in range(40)), f"l{i:03d}") for i, s in enumerate(stems) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(df, max_rows=100).languages) == len(langid.train(df).languages) == 260
