"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most two of 64 bits differ in at most one bit of one of their two 32-bit
segments. So each distinct fingerprint is indexed under 64 keys, one for every segment and bit, with that bit
wiped out; an equality join on the key finds every candidate and the exact distance verifies it. A pair that
meets under several keys counts under its first one only.

Copies never meet: fingerprints are made distinct first. A key under which more than
``MAX_BUCKET`` fingerprints stand is not joined with itself; its members are keyed once more, with one bit of the
other segment wiped out too (and for equal segments with every two bits), so that all that share such a key
differ in two bits at most and are linked to their smallest member: rows in proportion to the members, no pairs,
nothing lost.

The joins over these keys are hinted as merge joins: Spark takes a frame's size before its explode for the size after it,
64 times too small, and would broadcast all keys through the driver.

Components come from alternating large-star and small-star rounds over the links; each round is a written table.

Defined results: a null or blank text has fingerprint zero, linked like any other; texts of one or two words are
one shingle; equal texts share their class, and a repeated doc_id is in the class of each of its texts; a null
doc_id is a member of its class like any other, links included, and names it only where all its ids are null; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import drop_path, in_batches, new_path, table, unused_prefix, written

SHINGLE = 3
SEED = 42
MAX_BUCKET = 512
MAX_ROUNDS = 60
CHUNK = 1 << 16  # shingles hashed at a time, so that a very long text needs no more memory
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text, as a signed long."""
    w = (text or b"").lower().split()  # of bytes: A-Z and the ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE + 1)
    hashed = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(hashed, dtype="<u8", count=min(CHUNK, n - at))
        by_byte = h.view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
        ones += (np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), found, *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (signed long) of each row, and further columns of longs."""
    schema = ", ".join(["doc_id long, fp long", *(f"`{c}` long" for c in more)])
    return in_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"), *more), _fingerprints, schema)


def _keyed(nodes: DataFrame) -> DataFrame:
    """64 rows a fingerprint: the key holds the wiped bit's place p and the rest of its segment."""
    at = nodes.select("rep", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    half = "(shiftrightunsigned(fp, 32 * (p div 32)) & 4294967295)"
    return at.withColumn("k", F.expr(f"shiftleft(CAST(p AS BIGINT), 32) | ({half} & ~shiftleft(1L, p % 32))"))


#: Of the pair a, b that meets at p: whether it differs in two bits at most, and p is the first place where it meets.
_VERIFY = """bit_count(a_fp ^ b_fp) <= 2 AND CASE
  WHEN bit_count((a_fp ^ b_fp) & 4294967295) <= 1
  THEN CASE WHEN (a_fp ^ b_fp) & 4294967295 = 0 THEN a_p = 0 ELSE a_p < 32 AND (a_fp ^ b_fp) & 4294967295 = shiftleft(1L, a_p % 32) END
  ELSE CASE WHEN shiftrightunsigned(a_fp ^ b_fp, 32) = 0 THEN a_p = 32 ELSE a_p >= 32 AND shiftrightunsigned(a_fp ^ b_fp, 32) = shiftleft(1L, a_p % 32) END END"""


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """u, v (reps, u > v) of a set of links under which the classes of nodes (fp, rep; distinct fp) are those of all links."""
    # few bytes, but 64 rows of each: dealt to as many tasks as other shuffles, not merged by size
    keyed = _keyed(nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")))
    # dealt anew, so that the join below is of two plain exchanges and a key of very many fingerprints can be split
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").hint("rebalance")
    met = written(keyed.hint("merge").join(shared, "k"), "simhash-met")
    few = met.where(F.col("c") <= max_bucket)
    side = lambda s: few.select("k", *[F.col(c).alias(f"{s}_{c}") for c in (("fp", "rep", "p") if s == "a" else ("fp", "rep"))])
    pairs = side("a").hint("merge").join(side("b"), "k").where("a_fp < b_fp").where(_VERIFY)
    pairs = pairs.select(F.greatest("a_rep", "b_rep").alias("u"), F.least("a_rep", "b_rep").alias("v"))
    many = met.where(F.col("c") > max_bucket)
    other = F.expr("shiftrightunsigned(fp, 32 * (1 - p div 32)) & 4294967295")
    one = many.select("k", "rep", other.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    one = one.select(F.col("k").alias("x"), F.col("j").alias("y"), F.expr("o & ~shiftleft(1L, j)").alias("z"), "rep")
    two = many.where("p % 32 = 0").select("p", "fp", "rep", other.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("j")).where("j div 32 < j % 32")
    two = two.select(F.expr("shiftrightunsigned(fp, 32 * (p div 32)) & 4294967295 | shiftleft(CAST(p AS BIGINT), 33)").alias("x"), (F.col("j") + 32).alias("y"), F.expr("o & ~(shiftleft(1L, j div 32) | shiftleft(1L, j % 32))").alias("z"), "rep")
    stars = one.unionByName(two)
    least = stars.groupBy("x", "y", "z").agg(F.min("rep").alias("v")).hint("rebalance")
    starred = stars.hint("merge").join(least, ["x", "y", "z"]).where("rep > v").select(F.col("rep").alias("u"), "v")
    return pairs.unionByName(starred).distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """u, v: of every node of the edges (u > v) but the smallest of its component, that smallest node."""
    spark = edges.sparkSession
    path = new_path(spark, "components")
    edges.write.parquet(path)
    before = None
    for _ in range(max_rounds):
        e = spark.read.schema("u long, v long").parquet(path)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        # each node's larger neighbours are given to the least of its neighbourhood, then its smaller ones
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = new_path(spark, "components")
        small.write.parquet(after)
        done = spark.read.schema("u long, v long").parquet(after)
        state = done.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        path = after
        if state == before:
            return done
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def roots(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Of each distinct fp of fingerprints(), a written table: f, the smallest fp that can be reached over links (root), and the smallest doc_id of all those."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # fingerprints are the nodes: those without a doc_id link others too, and a doc_id of several texts links none
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), max_bucket))
    of = nodes.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "rep")
    of = written(of, "simhash-roots")
    least = of.groupBy("root").agg(F.min("rep").alias("component_id")).hint("rebalance")
    return written(of.join(least, "root").select("f", "root", "component_id"), "simhash-classes")


def classes(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp, component_id of each row of fingerprints(), which should be a written table."""
    # roots are a table of their own: both sides are then plain exchanges, and a fingerprint of very many copies can be split
    return prints.join(roots(prints, max_bucket), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that can be reached over links, of each row; null where none can."""
    return classes(written(fingerprints(docs, key, text), "simhash-fp"), max_bucket)


def keep_one(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """One row of each class: of those with the smallest doc_id, that of least text hash, or the first of equal ones. Of a class without any doc_id a row is kept only where ``unnamed``."""
    # written with a number for each row, so that rows are told apart whatever ids and texts they share
    p = unused_prefix(docs.columns)
    row, text_hash = f"{p}row", f"{p}hash"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = written(fingerprints(rows.withColumn(text_hash, F.xxhash64("text")), more=(text_hash, row)), "simhash-fp")
    # the best row of each fingerprint first: partial minima, so that a class of very many copies is not brought to one task
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash, row)).alias("best"))
    best = best.join(roots(prints), F.col("fp") == F.col("f")).groupBy("root").agg(F.min("best").alias("best"))
    if not unnamed:
        best = best.where("NOT best.none")
    return rows.join(best.select(f"best.{row}"), row, "left_semi").select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
