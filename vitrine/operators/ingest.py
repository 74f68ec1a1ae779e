"""Building documents from rows, and reconciling source and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import digits_only


def flatten_value(texts: Column, related: Column, entity: bool) -> dict[str, Column]:
    """Fields of a metadata entry from its scalar texts and the titles of related items.

    Keywords keep every distinct text in order; the text joins distinct labels; ids are all-digit texts of entity
    types; the number is set for one numeric text alone.
    """
    clean = F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""))
    labels = F.array_distinct(F.concat(clean, F.filter(related, lambda t: t.isNotNull())))
    ids = F.transform(F.filter(clean, lambda t: digits_only(t)), lambda t: t.cast("long"))
    return {
        "value_keyword": clean,
        "value_text": F.array_join(labels, " | "),
        "value_ids": F.when(F.lit(entity) & (F.size(ids) > 0), ids),
        "value_number": F.when(F.size(clean) == 1, F.get(clean, F.lit(0)).try_cast("double")),
    }


def missing(source: DataFrame, indexed: DataFrame, key: str = "item_id") -> DataFrame:
    """Source items that the index has not."""
    return source.select(key).join(indexed.select(key), key, "left_anti")


def orphans(indexed: DataFrame, live: DataFrame, key: str = "item_id") -> DataFrame:
    """Indexed items whose source is gone or no longer of an indexed status."""
    return indexed.select(key).join(live.where(F.col("post_status").isin("publish", "private", "draft")).select(key), key, "left_anti")


def related_labels(entries: DataFrame, targets: DataFrame, collections: DataFrame) -> DataFrame:
    """item_id and label: the titles of related items that are published in a published collection."""
    shown = targets.where(F.col("post_status") == "publish").join(collections.where(F.col("status") == "publish").select("collection_id"), "collection_id", "left_semi")
    return entries.select("item_id", F.explode("value_ids").alias("target_id")).join(shown.select(F.col("item_id").alias("target_id"), F.col("title").alias("label")), "target_id").select("item_id", "label")


def referrer_pairs(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Items that refer to any changed item: an equality join on exploded ids."""
    pairs = entries.select("item_id", F.explode("value_ids").alias("target_id"))
    return pairs.join(changed.select(F.col("item_id").alias("target_id")), "target_id").where("item_id <> target_id").select("item_id").distinct()


def build_documents(items: DataFrame, collections: DataFrame, authors: DataFrame, metadata: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """One row an item with its entries as arrays; entries are grouped once, before they meet the items."""
    meta = metadata.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("metadatum_id", "value_text", "value_keyword", "value_ids", "value_number"))).alias("metadata"))
    terms = taxonomies.where(F.size("terms") > 0).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("slug", "terms", "term_ids"))).alias("taxonomies"))
    out = items.join(collections, "collection_id", "left").join(authors, "author_id", "left").join(meta, "item_id", "left").join(terms, "item_id", "left")
    return out.withColumns({"collection_name": F.coalesce("collection_name", F.lit("")), "metadata": F.coalesce("metadata", F.array()), "taxonomies": F.coalesce("taxonomies", F.array())})


def corpus_texts(items: DataFrame, metadata: DataFrame, terms: DataFrame) -> DataFrame:
    """item_id and text: title, content and description, then texts that are no numbers or serialised values, then term names."""
    head = items.where(F.col("post_status") == "publish").select("item_id", F.lit(0).alias("k"), F.concat_ws(" . ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("description", F.lit(""))).alias("t"))
    values = metadata.select("item_id", F.lit(1).alias("k"), F.explode("value_keyword").alias("t")).where(F.col("t").try_cast("double").isNull() & ~F.col("t").rlike("^[as]:"))
    names = terms.select("item_id", F.lit(2).alias("k"), F.explode("terms").alias("t"))
    grouped = head.unionByName(values).unionByName(names).groupBy("item_id").agg(F.max(F.when(F.col("k") == 0, 1)).alias("own"), F.array_sort(F.collect_list(F.struct("k", "t"))).alias("parts"))
    return grouped.where("own = 1").select("item_id", F.array_join(F.transform("parts", lambda p: p["t"]), " . ").alias("text"))
