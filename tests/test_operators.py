"""Operators on small rows: the edge cases that the fixture tables lack."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vitrine.functions import stem, text
from vitrine.functions.distance import damerau, distance, one_edit
from vitrine.operators import facets, filters, ingest, listing, mining, monitor, queue, search, vocabulary
from vitrine.plans.spec import Meta, QuerySpec, Unsupported, build
from vitrine.sources import catalogue as c
from vitrine.sources import files


def ids(df):
    return sorted(r["item_id"] for r in df.select("item_id").collect())


@pytest.fixture(scope="module")
def cat(spark):
    d = dt.datetime(2020, 1, 1)
    items = spark.createDataFrame(
        [(1, "col_a", "publish", "Zé", None, "arte do rio", 5, d, None), (2, "col_a", "publish", "são", None, "Fotografia antiga", 6, None, None), (3, "col_a", "private", "SAO ", None, "rio de janeiro", 5, d, None),
         (4, "col_a", "publish", "abc", None, None, 5, dt.datetime(2021, 1, 1), None), (5, "col_b", "publish", None, None, "", None, None, None)], c.ITEM)
    meta = spark.createDataFrame([(1, 7, "a | 0", ["a", "0"], None, None), (2, 7, "", [], None, None), (3, 7, "12", ["12"], [12], 12.0), (4, 8, "red | blue", ["red", "blue"], [1, 12], None), (4, 8, "red", ["red"], None, None)], c.METADATA)
    tax = spark.createDataFrame([(1, "t", ["x"], [1]), (1, "t", ["y"], [2]), (2, "t", ["x"], [1]), (3, "u", ["x"], [1])], c.TAXONOMIES)
    return c.Catalogue(items, meta, tax)


def got(cat, **args):
    return ids(filters.apply(cat, build(args, ("col_a", "col_b"))))


def test_meta_edges(cat):
    m = lambda *a: [dict(zip(("key", "value", "compare"), a, strict=False))]
    assert got(cat, meta_query=m(7, "0")) == [1]  # '0' is a value
    assert got(cat, meta_query=m(7, None, "EXISTS")) == [1, 2]  # an empty entry exists
    assert got(cat, meta_query=m(7, None, "NOT EXISTS")) == [4, 5]
    assert got(cat, meta_query=m(7, "a", "!=")) == [2, 4, 5]  # items without the metadatum pass
    assert got(cat, meta_query=m(8, "12")) == [4]  # all-digit values are ids too
    assert got(cat, meta_query=m(7, 5, "<")) == []  # no number, no range
    assert got(cat, meta_query=[{"key": 8, "value": "red"}, {"key": 8, "value": "blue"}]) == [4]


def test_tax_edges(cat):
    t = lambda **k: [{"taxonomy": "t", **k}]
    assert got(cat, tax_query=t(terms=[1, 2], operator="AND")) == [1]  # in different entries
    assert got(cat, tax_query=t(terms=[2], operator="NOT IN")) == [2, 4, 5]
    assert got(cat, tax_query=t(operator="NOT EXISTS")) == [4, 5]
    assert got(cat, tax_query=t(terms="x", field="name")) == [1, 2]


def test_like_may_cross_values(cat):
    assert ids(cat.metadata.where(filters.meta_match(Meta(8, "red BLUE", "LIKE")))) == [4]


def test_listing_nulls_last_and_title(cat):
    both = lambda **a: [r["item_id"] for r in listing.page(cat, build(a, ("col_a", "col_b"))).collect()]
    assert both()[:2] == [4, 1] and set(both()[2:]) == {2, 5}
    assert both(orderby="date", order="ASC")[:2] == [1, 4]
    assert both(orderby="title", order="ASC") == [4, 2, 1, 5]
    q = QuerySpec(("col_a",), ("publish", "private"), sort=(("title", True),))
    assert [r["item_id"] for r in listing.page(cat, q).collect()] == [4, 3, 2, 1]  # SAO sorts by collation, blanks at its end ignored


def test_facets(cat, spark):
    v = {r["label"]: r["total_items"] for r in facets.several_entries(cat.metadata, 8).collect()}
    assert v == {"red": 1, "blue": 1}  # items are counted, not entries
    many = spark.createDataFrame([(i, 1, None, [f"v{i}"], None, None) for i in range(12)], c.METADATA)
    with pytest.raises(Unsupported):
        facets.capped(facets.values(many, 1), 10)
    assert facets.totals(facets.values(many, 1), 5).first()["pages"] == 3
    order = facets.page(spark.createDataFrame([("Zé", 1), ("são", 1), ("SAO", 1), ("Ábaco", 1), ("abc", 1), ("10", 1), ("_a", 1)], "label string, total_items long"))
    assert [r["label"] for r in order.collect()] == ["_a", "10", "Ábaco", "abc", "SAO", "são", "Zé"]
    for bad in (("taxonomy",), ("text", False), ("text", None, [1])):
        with pytest.raises(Unsupported):
            facets.check(*bad)


def test_search(cat, spark):
    assert ids(search.match_all(cat.items, "RIO arte")) == [1]
    assert ids(search.match_all(cat.items, "!!")) == []
    assert search.analyze("Casa de Pedra", frozenset({"de"})) == [(0, "casa"), (2, "pedra")]
    assert ids(filters.referrers(cat.metadata, 12)) == [3, 4] == ids(filters.referrers(cat.metadata, 12, most=1))  # one more than asked: there are more


def test_damerau_and_deletes(spark):
    for a, b, d in (("ab", "ba", 1), ("arte", "artes", 1), ("litografia", "litogarfia", 1), ("abc", "abc", 0), ("", "ab", 2), ("ca", "abc", 3)):
        assert damerau(a, b) == d
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance("a", "b").alias("d"), one_edit("a", "b").alias("one")).collect()
    assert all(r["d"] == damerau(r["a"], r["b"]) and r["one"] == (r["d"] == 1) for r in rows)
    row = spark.createDataFrame([("abb",)], "w string").select(text.deletes("w").alias("d")).first()
    assert sorted(row["d"]) == ["ab", "abb", "bb"]


def test_stems():
    s = lambda w: stem.stem(w)
    assert s("fotografia") == s("fotografias") == "fotograf"
    assert s("museu") == "mus"
    assert stem.stem("licensed", "english") == stem.stem("licenses", "english")


@pytest.mark.parametrize("language", stem.LANGUAGES)
def test_stems_as_expressions(spark, language):
    """The compiled rules, in Spark and in SQL, give what the rules say: for each ending at each length that lets it stay or go."""
    endings = [e for some, _ in stem.ROUNDS[language] for e, _ in some]
    words = sorted({x[:n] + e + f for x in ("bcdfgh", "ãéloup") for n in range(2, 7) for e in endings for f in ("", endings[0], endings[-1])})
    wanted = {w: stem.stem(w, language) for w in words}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", stem.stemmed(F.col("w"), language)).collect()} == wanted
    con = duckdb.connect()
    con.execute("CREATE TABLE t (w VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    assert dict(con.sql(f"SELECT w, {stem.stem_sql('w', language)} FROM t").fetchall()) == wanted


def test_text_functions(spark):
    df = spark.createDataFrame([("São Paulo, Straße",)], "t string")
    assert df.select(text.fold("t")).first()[0] == "sao paulo, strasse" == text.fold_str("São Paulo, Straße")
    assert df.select(text.fold_word("t")).first()[0] == text.fold_word_str("São Paulo, Straße")
    h = spark.createDataFrame([(5,), (125,), (7300,), (200000,)], "s long").select(text.humanize_seconds("s")).collect()
    assert [r[0] for r in h] == ["5s", "2min 5s", "2h 1min", "2d 7h"]
    assert text.scrub({"a": [{"Api_Token": 1}], "b": 2}) == {"a": [{"Api_Token": "***redacted***"}], "b": 2}
    u = spark.createDataFrame([("https://me:p@ss@host:9200",), ("https://host",)], "u string").select(text.url_user("u"), text.url_password("u"), text.url_bare("u")).collect()
    assert list(u[0]) == ["me", "p@ss", "https://host:9200"] and list(u[1]) == ["", "", "https://host"]
    e = spark.createDataFrame([("&lt;b&gt; &amp;amp; &quot;",)], "t string").select(text.decode_entities("t")).first()[0]
    assert e == '<b> &amp; "'
    refs = {"&#65;&#x42;&#X63;": "ABc", "&Eacute;t&eacute; &euro; &copy;": "Été € ©", "&amp;lt; &amp;#65;": "&lt; &#65;", "&nope; &#0; &#xD800; &#9999999; &;": "&nope; &#0; &#xD800; &#9999999; &;", "a&nbsp;b&#160;c": "a b c", "&#128512; &#38;lt;": "😀 &lt;", "": ""}
    got = spark.createDataFrame([(k,) for k in refs], "t string").select("t", text.decode_entities("t")).collect()
    assert {r[0]: r[1] for r in got} == refs
    assert spark.createDataFrame([(None,)], "t string").select(text.decode_entities("t")).first()[0] is None
    assert spark.createDataFrame([(" OpenSearch ",), ("x",)], "e string").select(text.normalize_engine("e")).collect()[0][0] == "elasticsearch"


def test_files(spark, tmp_path):
    assert files.decode("é".encode()) == "é" and files.decode(b"\xe9") == "é"
    (tmp_path / "l.txt").write_bytes(b"\xef\xbb\xbfa, b\r\n# c\rd")
    assert [(r["line"], r["text"]) for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == [(1, "a, b"), (2, "# c"), (3, "d")]
    assert files.sniff("a,b;c") == ";" and files.sniff("a,b,c;") == "," and files.sniff("x") == ";"
    (tmp_path / "l.csv").write_text('excessão,exceção,"a ""b"""\n,,\n')
    cells = files.read_delimited(spark, str(tmp_path / "l.csv"))
    assert [r["cells"] for r in cells.collect()] == [["excessão", "exceção", 'a "b"']]
    (tmp_path / "r.csv").write_bytes(b'a;b\nc;d;e;f\n"g\nh" ; \n;;\n\xe9;i')
    assert [(r["line"], r["cells"]) for r in files.read_delimited(spark, str(tmp_path / "r.csv")).collect()] == [(1, ["a", "b"]), (2, ["c", "d", "e", "f"]), (3, ["g\nh"]), (6, ["é", "i"])]
    assert files.cells_to_lines(cells, "corrections").first()[0] == 'excessão => exceção, a "b"'
    assert files.cells_to_lines(cells, "stopwords").count() == 3
    files.export_json(cells, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 1


def test_vocabulary(spark):
    lists = lambda d: spark.createDataFrame(list(d.items()), "list string, text string")
    rules, stop = vocabulary.apply(lists({"synonyms": "casa de campo, sítio", "corrections": "excessão => exceção", "stopwords": "www"}), ("de",))
    assert sorted(r["rule"] for r in rules.collect()) == ["casa campo, sitio", "excessao => excessao, excecao"]
    assert [r["word"] for r in stop.collect()] == ["www"]
    with pytest.raises(ValueError, match="arrow required"):
        vocabulary.apply(lists({"corrections": "a, b"}))
    long = vocabulary.parse(vocabulary.lines(lists({"synonyms": "x" * 81 + ", b"})))
    assert long.first()["error"] == "long term"
    assert vocabulary.pending({"synonyms": " "}, None, spark) is False
    assert vocabulary.pending({"synonyms": "a, b"}, None, spark) is True
    notes = vocabulary.compiled(vocabulary.rules(vocabulary.parse(vocabulary.lines(lists({"synonyms": "de, casa"})))), ("de",)).collect()
    assert notes[0]["rule"] is None and notes[0]["note"] == "no effect"


def test_acronyms(spark):
    rows = [("a sede da Companhia Estadual de Energia (CEE)",), ("uma companhia Estadual (CE)",), ("Museu d'Arte Moderna (MAM)",), ("Museu de Arte Moderna (MAM)",), ("o Instituto Ágora (IA) e a Área Livre (ZL)",), ("(ABC) Só (SO)",)]
    got = mining.acronyms(spark.createDataFrame(rows, "text string")).collect()
    assert {(r["acronym"], r["expansion"]) for r in got} == {("CEE", "Companhia Estadual de Energia"), ("MAM", "Museu d'Arte Moderna"), ("MAM", "Museu de Arte Moderna"), ("IA", "Instituto Ágora")}
    df = spark.createDataFrame([("A Ordem dos Advogados do Brasil (OAB) e (X). Ordem dos Advogados do Brasil ( OAB )",), (None,)], "text string")
    assert [tuple(r) for r in mining.acronyms(df).collect()] == [("OAB", "Ordem dos Advogados do Brasil", 2)]


def test_spread_sample(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    assert [r["n"] for r in mining.spread_sample(df, 3, "n").collect()] == [0, 3, 6]


def test_queue_breaker_throttle(spark):
    q = spark.createDataFrame([(1, 10)], "item_id long, enqueued_at long")
    more = spark.createDataFrame([(1, 20), (2, 30), (2, 25), (0, 1), (-4, 1)], "item_id long, enqueued_at long")
    assert sorted(map(tuple, queue.enqueue(q, more).collect())) == [(1, 10), (2, 25)]
    assert queue.enqueue(q, more, cap=1).count() == 1
    calls = [("a", t, o) for t, o in ((0, "fail"), (1, "fail"), (2, "ignored"), (3, "fail"), (4, "ok"), (200, "fail"), (201, "ok"), (202, "fail"))] + [("b", 0, "fail")]
    got = [(r["k"], r["at"], r["state"], r["failures"]) for r in queue.breaker(spark.createDataFrame(calls, "k string, at long, outcome string")).orderBy("k", "at").collect()]
    assert got[:5] == [("a", 0, "closed", 1), ("a", 1, "closed", 2), ("a", 2, "closed", 2), ("a", 3, "opened", 0), ("a", 4, "refused", 0)]
    assert got[5:] == [("a", 200, "closed", 1), ("a", 201, "closed", 0), ("a", 202, "closed", 1), ("b", 0, "closed", 1)]
    rows = spark.createDataFrame([("a", t) for t in (0, 30, 60, 90, 130)] + [("b", 10)], "k string, at long")
    assert sorted(map(tuple, queue.throttle(rows, 60).collect())) == [("a", 0), ("a", 60), ("a", 130), ("b", 10)]
    o = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (1, 4, False), (1, 5, False)], "item_id long, at long, ok boolean")
    assert [r["verdict"] for r in queue.retry_or_drop(o).orderBy("at").collect()] == ["retry", "done", "retry", "retry", "drop"]
    assert [r["verdict"] for r in queue.retry_or_drop(o, reset_on_success=True).orderBy("at").collect()][-1] == "retry"


def test_shard_status_table(spark):
    rows = [("green", None, False, "green"), ("yellow", "green", False, "yellow"), ("yellow", None, True, "green"), (None, "yellow", True, "green"), ("", "red", True, "red"), ("red", "green", True, "red"), (None, None, False, None), ("green", "red", False, "green")]
    df = spark.createDataFrame([r[:3] for r in rows], "index_status string, cluster_status string, single_node boolean")
    assert [r[0] for r in df.select(monitor.shard_status()).collect()] == [r[3] for r in rows]


def test_coverage_surplus(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "c string, i int")
    b = spark.createDataFrame([("x", i) for i in range(5)], "c string, i int")
    got = {r["c"]: (r["coverage_pct"], r["divergence_pct"], r["over_threshold"]) for r in monitor.coverage(a, b, "c").collect()}
    assert got == {"x": (250.0, 0.0, False), "y": (0.0, 100.0, True)}


def test_ingest_entries(spark):
    df = spark.createDataFrame([([" 7 ", "", "7", "x"],), (["12"],)], "t array<string>")
    made = ingest.flatten_value(F.col("t"), F.array(F.lit("Label")), entity=True)
    rows = df.select(*[v.alias(k) for k, v in made.items()]).collect()
    assert rows[0]["value_keyword"] == ["7", "x"] and rows[0]["value_text"] == "7 | x | Label" and rows[0]["value_ids"] == [7] and rows[0]["value_number"] is None
    assert rows[1]["value_number"] == 12.0


def test_save_and_load(cat, spark, tmp_path):
    c.save(cat, str(tmp_path))
    again = c.load(spark, str(tmp_path))
    assert again.items.count() == 5 and again.metadata.where("metadatum_id = 8").count() == 2
    plan = again.metadata.where("metadatum_id = 8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metadatum_id" in plan
