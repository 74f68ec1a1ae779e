"""Mixing sources to target weights: hash-random keys, a range order within each source, distributed prefix sums, an exact cut.

Every document gets a random key, the hash of its id and text, so reruns agree. Within a source the keys' range
is cut into buckets of about ``rows_per_bucket`` documents. The words of each bucket are summed (combined before
the shuffle), the bucket sums are prefix-summed, and only within a bucket are documents ordered by key and their
words summed up. So no task holds a source, however hot; what one window sorts is a bucket, and the table of
buckets is as many times smaller than the input.

A source's target is taken as whole passes (epochs) over it and a last pass up to the exact word of its budget;
the document at the cut is taken in part, or, with ``whole_documents``, as a whole if its larger part fits.

DataFrame functions only.

Defined results: a null or blank text has size 0 and is taken with 0 words; a null source is a source, the last;
an empty string is the first; rows with a repeated doc_id count each for itself (equal rows stand side by side in
key order); a source without words has target 0; an empty table gives no rows; other columns, whatever
their names, are not read: those that ``mix()`` adds take a prefix that no column has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import table, unused_prefix, words, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 500
P = "__vt_"  # of the columns that mix() adds, unless the input has such columns: see unused_prefix
KEY_BITS = 36  # of the hash; leaves room for 2**27 buckets a source in a long


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: str = P) -> DataFrame:
    """The rows with size, source, and the random key of KEY_BITS bits of each. A null source is told from '' by its rank."""
    if f"{p}size" in docs.columns:
        return docs
    return docs.withColumns(
        {
            f"{p}size": F.size(words(text)).cast("long"),
            f"{p}source": F.col(source),
            f"{p}key": F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(text))), 1, KEY_BITS // 4), 16, 10).cast("long"),
        }
    )


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, key: str = "doc_id", text: str = "text", source: str = "source", p: str = P) -> DataFrame:
    """One row a source: its size, number of rows, weight and target.

    All sizes are shared by weight; no target passes max_epochs times the source's size. Sources are filled in
    the order of the level (cap / weight) at which they are full, so one pass of prefix sums over the sources
    finds the common level of those that never are.
    """
    sums = sized(docs, key, text, source, p).groupBy(f"{p}source").agg(F.sum(f"{p}size").alias("size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col(f"{p}source").asc_nulls_last())
    places = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", F.get(places, F.col("place") % len(weights)))
    full = ranked.withColumn("cap", (F.col("size") * max_epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "place")
    up_to = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = full.withColumns({"total": F.sum("size").over(every), "caps": F.sum("cap").over(up_to) - F.col("cap"), "open": F.sum("weight").over(after)})
    # the common level if this source and all after it stay open; the first source that stays open sets it
    level = filled.withColumn("common", (F.col("total") - F.col("caps")) / F.col("open"))
    found = level.withColumn("at", F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "place", "common"))).over(every)["common"])
    return found.select(F.col(f"{p}source"), F.col("place"), F.col("size").alias("source_size"), "rows", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("at"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    whole_documents: bool = False,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    p: str | None = None,
) -> DataFrame:
    """The rows as they came, with __vt_size, __vt_source_size, __vt_target and __vt_taken (or of another prefix): the words that the mix takes of each.

    Rows that sized() gave, with the prefix p, needn't have the text any more: their words aren't counted again."""
    p = p or unused_prefix(docs.columns)
    names = [c for c in docs.columns if not c.startswith(p)]
    plan = targets(docs, weights, max_epochs, key, text, source, p).withColumn("buckets", F.greatest(F.ceil(F.col("rows") / rows_per_bucket), F.lit(1)))
    plan = plan.withColumn("budget", F.floor(F.col("target")).cast("long")).select(
        F.col(f"{p}source").alias(f"{p}s"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target"), F.col("buckets").alias(f"{p}buckets"), F.col("place").alias(f"{p}place"), F.col("budget").alias(f"{p}budget")
    )

    def placed(rows: DataFrame) -> DataFrame:
        joined = sized(rows, key, text, source, p).join(plan, F.col(f"{p}source").eqNullSafe(F.col(f"{p}s")))
        return joined.withColumn(f"{p}bucket", F.shiftright(F.col(f"{p}key") * F.col(f"{p}buckets"), KEY_BITS))

    sums = placed(docs).groupBy(f"{p}place", f"{p}bucket").agg(F.sum(f"{p}size").alias(f"{p}sum"))
    before = Window.partitionBy(f"{p}place").orderBy(f"{p}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(f"{p}place").alias(f"{p}p"), F.col(f"{p}bucket").alias(f"{p}b"), F.coalesce(F.sum(f"{p}sum").over(before), F.lit(0)).alias(f"{p}start"))
    rows = placed(docs)
    rows = rows.join(starts, (F.col(f"{p}place") == F.col(f"{p}p")) & (F.col(f"{p}bucket") == F.col(f"{p}b")))
    inside = Window.partitionBy(f"{p}place", f"{p}bucket").orderBy(f"{p}key", F.col(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(f"{p}end", F.col(f"{p}start") + F.sum(f"{p}size").over(inside))
    size, full = F.col(f"{p}size"), F.col(f"{p}source_size")
    epochs = F.when(full > 0, F.floor(F.col(f"{p}budget") / full)).otherwise(0).cast("long")
    left = F.col(f"{p}budget") - epochs * full - (F.col(f"{p}end") - size)
    part = F.greatest(F.lit(0), F.least(size, left))
    if whole_documents:
        part = F.when(2 * part >= size, size).otherwise(0)
    return rows.withColumn(f"{p}taken", (epochs * size + part).cast("long")).select(*[F.col(f"`{c}`") for c in names], f"{p}size", f"{p}source_size", f"{p}target", f"{p}taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, whole. Documents without words are kept once."""
    p = unused_prefix(docs.columns)
    rows = mix(docs, whole_documents=True, p=p, **options)
    times = F.when(F.col(f"{p}size") == 0, 1).otherwise(F.col(f"{p}taken") / F.col(f"{p}size")).cast("int")
    return rows.where(times > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")  # so no column of the table meets those of our own
    # the words are counted once; the rest works on rows of four numbers
    rows = written(sized(docs).select("doc_id", "source", *[f"{P}{c}" for c in ("size", "source", "key")]), "sizes")
    return mix(rows, p=P).select("doc_id", *[F.col(f"{P}{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 9) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (3 * size)::DOUBLE AS cap FROM r),
c AS (
  SELECT a.place, ((SELECT sum(size) FROM s)::DOUBLE - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
         / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS common, a.cap / a.weight AS level
  FROM w a, w b GROUP BY a.place, a.cap, a.weight),
t AS (SELECT w.*, least(cap, coalesce(weight * (SELECT min_by(common, level) FROM c WHERE common <= level), cap)) AS target FROM w),
e AS (
  SELECT d.*, t.size AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget % source_size - (upto - size))) END AS BIGINT) AS taken
FROM e
"""
