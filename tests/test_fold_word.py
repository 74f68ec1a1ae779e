"""Folding of all words of whole texts."""

import duckdb

import __spark_entry__  # noqa: F401  registers the queries
from vitrine.plans.registry import ORACLES, QUERIES


def test_every_word_is_folded(spark, tmp_path):
    long = "É" * 41
    rows = [(1, f"Straße one\nTwo\r\n\tthree {long}"), (2, "\n Two  "), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, QUERIES["fold_word"](spark, str(tmp_path)).collect()))
    assert found == sorted([("Straße", "strasse"), ("one", "one"), ("Two", "two"), ("three", "three"), (long, "e" * 41)])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == sorted(con.sql(ORACLES["fold_word"]).fetchall())
