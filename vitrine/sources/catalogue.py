"""The catalogue's tables: items, and a child table for each kind of nested entry.

A condition on an entry is then a row predicate of a narrow table that reaches the scan, and an item filter is a
semi or anti join; predicates inside arrays of structs would do neither.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _struct(ddl: str) -> T.StructType:
    """A schema of flat types and arrays of them; needs no session, unlike Spark's own parser."""
    fields = []
    for field in ddl.split(", "):
        name, kind = field.split(" ", 1)
        fields.append(T.StructField(name, T.ArrayType(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]))
    return T.StructType(fields)


ITEM = _struct(
    "item_id bigint, post_type string, post_status string, title string, description string, content string, author_id bigint, date_created timestamp, date_modified timestamp"
)
METADATA = _struct("item_id bigint, metadatum_id bigint, value_text string, value_keyword array<string>, value_ids array<bigint>, value_number double")
TAXONOMIES = _struct("item_id bigint, slug string, terms array<string>, term_ids array<bigint>")
LOG = _struct(
    "id bigint, created_at timestamp, level string, channel string, message string, context string, cluster_status string, response_time_ms int, collection_id bigint, item_id bigint"
)
RUN = _struct("ts bigint, duration_ms bigint, built bigint, indexed bigint, failed bigint, skipped bigint, dropped bigint, queue_before bigint, queue_after bigint")


@dataclass(frozen=True)
class Catalogue:
    items: DataFrame
    metadata: DataFrame | None = None
    taxonomies: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM])


def entry(df: DataFrame, item: str, metadatum: int, text: Column | None = None, keywords: Column | None = None, ids: Column | None = None, number: Column | None = None) -> DataFrame:
    """Metadata entries of one metadatum; a filter on another one drops the whole scan."""
    given = {"item_id": F.col(item), "metadatum_id": F.lit(metadatum), "value_text": text, "value_keyword": keywords, "value_ids": ids, "value_number": number}
    return df.select(*[(F.lit(None) if given[f.name] is None else given[f.name]).cast(f.dataType).alias(f.name) for f in METADATA])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BRAND, TYPE, SIZE, PRICE = 1, 2, 3, 4
PRIORITY, TOTAL, CUSTOMER, FLAGS = 1, 2, 3, 4


def parts(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Parts as items with four metadata; the words of their names as terms, numbered by their length."""
    p = table(spark, sf_dir, "part")
    items = _items(p, item_id=F.col("p_partkey"), post_type=F.lit("col_part"), post_status=F.lit("publish"), title=F.col("p_name"))
    one = lambda k, c: entry(p, "p_partkey", k, F.col(c).cast("string"), F.array(F.col(c).cast("string")), number=F.col(c).cast("double") if k > 2 else None)
    names = F.split("p_name", " ")
    terms = p.select(F.col("p_partkey").cast("long").alias("item_id"), F.lit("name_words").alias("slug"), names.alias("terms"), F.transform(names, lambda w: F.char_length(w).cast("long")).alias("term_ids"))
    return Catalogue(items, _union([one(BRAND, "p_brand"), one(TYPE, "p_type"), one(SIZE, "p_size"), one(PRICE, "p_retailprice")]), terms)


STATUS = {"F": "publish", "O": "private", "P": "draft"}


def status_of(c: str) -> Column:
    return F.when(F.col(c) == "F", "publish").when(F.col(c) == "O", "private").otherwise("draft")


def orders(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Orders as items with a status, an author and a date; the customer is a relationship, return flags are multi-valued."""
    o = table(spark, sf_dir, "orders")
    items = _items(o, item_id=F.col("o_orderkey"), post_type=F.lit("col_orders"), post_status=status_of("o_orderstatus"), title=F.col("o_orderpriority"), author_id=F.col("o_custkey"), date_created=F.col("o_orderdate"))
    priority = entry(o, "o_orderkey", PRIORITY, F.col("o_orderpriority"), F.array("o_orderpriority"))
    total = entry(o, "o_orderkey", TOTAL, F.col("o_totalprice").cast("string"), F.array(F.col("o_totalprice").cast("string")), number=F.col("o_totalprice"))
    customer = entry(o, "o_orderkey", CUSTOMER, F.col("o_custkey").cast("string"), F.array(F.col("o_custkey").cast("string")), F.array(F.col("o_custkey").cast("long")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    flags = entry(lines, "l_orderkey", FLAGS, F.array_join("flags", " | "), F.col("flags"))
    return Catalogue(items, _union([priority, total, customer, flags]))


def texts(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Documents as full-text items; their source is the collection."""
    d = table(spark, sf_dir, "documents")
    return Catalogue(_items(d, item_id=F.col("doc_id"), post_type=F.concat(F.lit("col_"), "source"), post_status=F.lit("publish"), title=F.substring("text", 1, 60), content=F.col("text")))


def talks(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Conversations as items: the first turn gives title (three words) and description (twelve), each turn is a metadata entry, the roles are terms."""
    t = table(spark, sf_dir, "conversations")
    begins = t.where("turn = 0").withColumn("w", F.split("text", " "))
    of = lambda n: F.array_join(F.slice("w", 1, n), " ")
    items = _items(begins, item_id=F.col("conv_id"), post_type=F.lit("col_talks"), post_status=F.lit("publish"), title=of(3), description=of(12))
    entries = t.select(*[{"item_id": F.col("conv_id"), "metadatum_id": F.col("turn"), "value_text": F.col("text")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA])
    terms = t.groupBy(F.col("conv_id").cast("long").alias("item_id")).agg(F.sort_array(F.collect_set("role")).alias("terms"))
    return Catalogue(items, entries, terms.select("item_id", F.lit("roles").alias("slug"), "terms", F.lit(None).cast("array<bigint>").alias("term_ids")))


def save(catalogue: Catalogue, folder: str) -> None:
    """Write the tables: items by collection, entries by metadatum in item order, so a filter on either reads one part."""
    catalogue.items.write.mode("overwrite").partitionBy("post_type").parquet(f"{folder}/items")
    if catalogue.metadata is not None:
        catalogue.metadata.sortWithinPartitions("metadatum_id", "item_id").write.mode("overwrite").partitionBy("metadatum_id").parquet(f"{folder}/item_metadata")
    if catalogue.taxonomies is not None:
        catalogue.taxonomies.write.mode("overwrite").partitionBy("slug").parquet(f"{folder}/item_taxonomies")


def load(spark: SparkSession, folder: str) -> Catalogue:
    return Catalogue(spark.read.schema(ITEM).parquet(f"{folder}/items"), spark.read.schema(METADATA).parquet(f"{folder}/item_metadata"), spark.read.schema(TAXONOMIES).parquet(f"{folder}/item_taxonomies"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as index runs: one item each, failed where the event is an error."""
    e = table(spark, sf_dir, "events")
    bad = (F.col("event_type") == "error").cast("long")
    return e.select(F.col("event_id").alias("run_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.floor(F.col("value")).cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("built"), (1 - bad).alias("indexed"), bad.alias("failed"), F.col("user_id").cast("long").alias("item_id"), "event_type")


def known_post_types(items: DataFrame) -> DataFrame:
    return items.select("post_type").distinct()


def item_ids(items: DataFrame, post_type: str | None = None) -> DataFrame:
    """All ids of statuses that are indexed, of one collection if asked; an empty name has none."""
    out = items.where(F.col("post_status").isin("publish", "private", "draft"))
    return (out if post_type is None else out.where(F.col("post_type") == post_type)).select("item_id")


def keyset_page(items: DataFrame, after: int, size: int) -> DataFrame:
    """The next ids behind one; size is kept between 100 and 5000."""
    return items.where(F.col("item_id") > after).orderBy("item_id").limit(min(5000, max(100, size))).select("item_id")


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Keyed overwrite: the last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, key: str = "item_id") -> DataFrame:
    """The base with rows of the same key replaced."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(base: DataFrame, keys: DataFrame, key: str = "item_id") -> DataFrame:
    """Without the keys; a key that isn't there is no error."""
    return base.join(keys.select(key), key, "left_anti")
