"""Values of one metadatum within a filtered set, with the number of items, in collation order.

An item's values are made distinct before they are exploded, so items are counted with one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import fold
from vitrine.plans.spec import Unsupported

CAP_LOW, CAP, CAP_HIGH = 10, 300, 1000
#: Metadata types that have facets.
TYPES = ("text", "textarea", "numeric", "date", "selectbox", "relationship", "user")


def values(metadata: DataFrame, metadatum: int, items: DataFrame | None = None) -> DataFrame:
    """label and total_items."""
    entries = metadata.where(F.col("metadatum_id") == metadatum).select("item_id", F.array_distinct("value_keyword").alias("v"))
    if items is not None:
        entries = entries.join(items.select("item_id"), "item_id", "left_semi")
    return entries.select(F.explode("v").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("total_items"))


def several_entries(metadata: DataFrame, metadatum: int, items: DataFrame | None = None) -> DataFrame:
    """The same where an item may have several entries of the metadatum: pairs are made distinct, in a shuffle more."""
    entries = metadata.where(F.col("metadatum_id") == metadatum).select("item_id", F.explode("value_keyword").alias("label")).distinct()
    if items is not None:
        entries = entries.join(items.select("item_id"), "item_id", "left_semi")
    return entries.groupBy("label").agg(F.count(F.lit(1)).alias("total_items"))


def search(found: DataFrame, text: str) -> DataFrame:
    """Values that contain a text, case aside, accents not."""
    return found.where(F.contains(F.lower("label"), F.lit(text.lower())))


def page(found: DataFrame, offset: int = 0, number: int = 0) -> DataFrame:
    """In Portuguese collation order, ties by bytes; number 0: all."""
    out = found.orderBy(F.collate("label", "pt"), "label")
    if offset:
        out = out.offset(offset)
    return out.limit(number) if number else out


def totals(found: DataFrame, number: int) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / number)).cast("long") if number else F.lit(1).cast("long"))


def capped(found: DataFrame, cap: int = CAP, offset: int = 0, number: int = 0) -> DataFrame:
    """What a capped index answers: all values, or a refusal if there are more than the cap or the page passes it."""
    cap = min(CAP_HIGH, max(CAP_LOW, cap))
    if offset + number > cap or found.limit(cap + 1).count() > cap:
        raise Unsupported("more values than the cap")
    return page(found, offset, number)


def check(kind: str, items_filter: object = None, include: object = None) -> None:
    if kind not in TYPES:
        raise Unsupported(f"facet of {kind}")
    if items_filter is False or include:
        raise Unsupported("facet scope")


def by_folded(found: DataFrame) -> DataFrame:
    """Values that differ in case and accents only, as one."""
    return found.groupBy(fold("label").alias("label")).agg(F.sum("total_items").alias("total_items"))
