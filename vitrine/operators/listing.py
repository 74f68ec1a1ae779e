"""Sorted pages of items and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import collated
from vitrine.operators import filters
from vitrine.operators.textindex import Options, TextIndex
from vitrine.plans.spec import QuerySpec
from vitrine.sources.catalogue import Catalogue


def sort_columns(sort: tuple[tuple[str, bool], ...]) -> list[Column]:
    """Items without a value come last either way; ties go by id, in a title's own direction."""
    out, direction = [], False
    for name, ascending in sort:
        c = collated("title") if name == "title" else F.col(name)
        out.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
        direction = ascending if name == "title" else direction
    if "item_id" not in dict(sort):
        out.append(F.col("item_id").asc() if direction else F.col("item_id").desc())
    return out


def matching(catalogue: Catalogue, q: QuerySpec, index: TextIndex | None = None, options: Options = Options()) -> DataFrame:
    """The items of a specification, its text searched in all fields and entries: through an index of the whole catalogue, or by reading it."""
    items = filters.apply(catalogue, q)
    if not q.text:
        return items
    return items.join((index or TextIndex.build(catalogue)).search(q.text, options), "item_id", "left_semi")


def page(catalogue: Catalogue, q: QuerySpec, index: TextIndex | None = None, options: Options = Options()) -> DataFrame:
    """The ids of a page, with their place in the listing: a top-k, not a full sort.

    Scores are of single precision, so that equal ones tie and go by id; items that only the completion of a word finds have none and come last."""
    items = matching(catalogue, q, index, options)
    if "score" in dict(q.sort):
        scores = (index or TextIndex.build(catalogue)).scores(q.text, options).select("item_id", F.col("score").cast("float").alias("score"))
        items = items.join(scores, "item_id", "left").fillna(0.0, ["score"])
    items = items.orderBy(*sort_columns(q.sort))
    if q.offset:
        items = items.offset(q.offset)
    return (items.limit(q.size) if q.size > 0 else items).select("item_id")


def totals(items: DataFrame, size: int) -> DataFrame:
    """found and pages."""
    return items.agg(F.count(F.lit(1)).alias("found")).withColumn("pages", F.ceil(F.col("found") / size).cast("long"))
