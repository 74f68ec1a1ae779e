"""The index pipeline as a stream: a change feed, de-duplicated, built and written micro-batch by micro-batch.

The checkpoint holds the source's progress; each micro-batch replaces the rows of its items, in the buckets where they
lie, so a batch that is run again after a lost driver or executor leaves the same table. Who refers to whom is kept
beside it, so that a renamed item's referrers are built anew with it, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrine.sources.catalogue import _struct, newest
from vitrine.sources.keyed import BUCKETS, KeyedTable
from vitrine.sources.store import Store

CHANGE = "item_id bigint, post_type string, action string, at timestamp"
REFERENCE = _struct("target_id bigint, item_id bigint")
SPREAD = 8  # buckets of a target
WATERMARK = "10 minutes"


def changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def wanted(feed: DataFrame) -> DataFrame:
    """Saves and deletions of items; drafts of the editor and other types are passed over."""
    return feed.where(F.col("post_type").rlike(r"^(tnc_)?col_\w+$") & F.col("action").isin("save", "delete", "rename", "status"))


def queued(feed: DataFrame) -> DataFrame:
    """Each change once, though the feed may deliver it again. Several changes of an item meet in the batch writer, where the last one counts."""
    return wanted(feed).withWatermark("at", WATERMARK).dropDuplicatesWithinWatermark(["item_id", "action", "at"])


def with_referrers(feed: DataFrame, references: DataFrame) -> DataFrame:
    """Changed items, and for renamed ones, ones of a new status and deleted ones the items that refer to them (target_id, item_id), unless they are in the feed themselves."""
    touched = feed.where(F.col("action").isin("rename", "status", "delete"))
    pulled = touched.select(F.col("item_id").alias("target_id"), "post_type", "at").join(references.select("target_id", "item_id"), "target_id").where("item_id <> target_id")
    one = pulled.groupBy("item_id").agg(F.max(F.struct("at", "post_type")).alias("l")).select("item_id", "l.post_type", F.lit("save").alias("action"), "l.at")
    return feed.select("item_id", "post_type", "action", "at").unionByName(one.join(feed.select("item_id"), "item_id", "left_anti"))


def tables(spark: SparkSession, folder: str, document: T.StructType, buckets: int = BUCKETS) -> tuple[KeyedTable, KeyedTable]:
    """The documents, and who refers to whom: (target_id, item_id), a much referred to target dealt to several buckets."""
    store = Store(spark, folder)
    return KeyedTable(store, "documents", document, buckets=buckets), KeyedTable(store, "references", REFERENCE, "target_id", ("target_id", "item_id"), buckets, SPREAD)


def merge_into(folder: str, build: Callable[[DataFrame], DataFrame], document: T.StructType, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch writer: builds the documents of its items, and of those that refer to renamed, deleted or otherwise published ones, and puts them into their buckets.

    build: of item_ids, their documents; a column ``references`` (array of ids), if there is one, says whom a document refers to, and is kept the other way round."""

    def write(batch: DataFrame, number: int) -> None:
        docs, refers = tables(batch.sparkSession, folder, document, buckets)
        last = newest(batch, "item_id", "at").persist()
        known = refers.lookup(last.where(F.col("action").isin("rename", "status", "delete")).select(F.col("item_id").alias("target_id")))
        every = with_referrers(last, known).persist()
        made = build(every.where("action <> 'delete'").select("item_id")).persist()
        try:
            pairs = lambda df: df.select(F.explode("references").alias("target_id"), "item_id").distinct()
            if "references" in document.names:
                # first, and from the documents as they are: if this dies here, doing it again finds them unchanged
                before = pairs(docs.lookup(every.select("item_id")))
                refers.merge(pairs(made), before.join(pairs(made), ["target_id", "item_id"], "left_anti"))
            docs.merge(made, every.join(made.select("item_id"), "item_id", "left_anti").select("item_id"))
        finally:
            for df in (made, every, last):
                df.unpersist()

    return write


def current(spark: SparkSession, folder: str, document: T.StructType, buckets: int = BUCKETS) -> DataFrame:
    """The documents as the last finished batch left them."""
    return tables(spark, folder, document, buckets)[0].read()


def run(feed: DataFrame, folder: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], document: T.StructType, once: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    writer = queued(feed).writeStream.foreachBatch(merge_into(folder, build, document, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def level_counts(logs: DataFrame, window: str = "1 minute") -> DataFrame:
    """Extension: log rows by level in tumbling windows."""
    return logs.withWatermark("created_at", WATERMARK).groupBy(F.window("created_at", window), "level").agg(F.count(F.lit(1)).alias("n"))


def edit_sessions(feed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of edits by item."""
    return feed.withWatermark("at", WATERMARK).groupBy(F.session_window("at", gap), "item_id").agg(F.count(F.lit(1)).alias("edits"))
