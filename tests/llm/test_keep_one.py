"""Of each class of near-duplicates one row stays, whatever ids its rows have."""

import corpus_pipeline
from vitrine.llm import simhash

A, B, C, D, E = (f"{w} stands here before some {w} words that only {w} texts of {w} have" for w in ("one", "other", "third", "fourth", "fifth"))


def near(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return sorted(corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id", "text").collect(), key=str), docs


def test_each_class_keeps_one(spark, sf):
    rows = [(5, A, "a"), (5, B, "b"), (3, B, "b"), (None, C, "a"), (None, C, "b"), (None, D, "a"), (7, D, "a"), (7, E, "b"), (7, E, "b"), (None, E, "b"), (None, None, "c")]
    got, docs = near(spark, sf, rows)
    assert got == sorted([(5, A), (3, B), (None, C), (7, D), (7, E), (None, None)], key=str)
    assert sorted(map(tuple, simhash.keep_one(docs).select("doc_id", "text").collect())) == sorted([(5, A), (3, B), (7, D), (7, E)])


def test_no_class_loses_all(spark, sf):
    """Whichever of two texts of one id has the smaller hash."""
    for one, two in ((A, B), (B, A)):
        got, _ = near(spark, sf, [(5, one, "a"), (5, two, "a"), (3, two, "a")])
        assert got == sorted([(5, one), (3, two)], key=str)
