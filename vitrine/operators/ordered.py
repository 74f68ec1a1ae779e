"""Ranks, running sums and sliding sums in one order over all rows, or over the rows of a key that may hold most of them.

No window holds a key. Rows are range-sorted by key and order; the ranges' counts of each key, few numbers, give every
row its place. Places cut each key into blocks of equal size; a running sum is that of the block's own rows on top of the
sums of the blocks before, and a sliding sum's block takes along the rows that it needs from the block before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.artefacts import written

BLOCK = 100_000  # rows of a key that one window sorts
P = "_o_"  # before the names of columns of our own


def numbered(rows: DataFrame, order: list[str | Column], key: str | None = None) -> DataFrame:
    """The rows with _o_at, their place among those of their key from 0, and _o_m, how many these are. Equal rows stand in any order."""
    by = ([F.col(key).asc_nulls_first()] if key else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # written, so that the ranges, which rest on samples, are drawn once
    placed = written(dealt.withColumns({f"{P}id": F.monotonically_increasing_id(), f"{P}part": F.spark_partition_id(), f"{P}key": F.col(key) if key else F.lit(0)}), "ordered")
    counts = placed.groupBy(f"{P}part", f"{P}key").agg(F.count(F.lit(1)).alias("c"), F.min(f"{P}id").alias(f"{P}first"))
    of = Window.partitionBy(f"{P}key")  # a row for each range that holds any of the key
    before = of.orderBy(f"{P}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(f"{P}part").alias(f"{P}p"), F.col(f"{P}key").alias(f"{P}k"), f"{P}first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias(f"{P}start"), F.sum("c").over(of).alias(f"{P}m"))
    joined = placed.join(starts, (F.col(f"{P}part") == F.col(f"{P}p")) & F.col(f"{P}key").eqNullSafe(F.col(f"{P}k")))
    return joined.select(*rows.columns, (F.col(f"{P}id") - F.col(f"{P}first") + F.col(f"{P}start")).alias(f"{P}at"), f"{P}m")


def running(rows: DataFrame, order: list[str | Column], key: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """The rows with sums over all rows of their key up to themselves."""
    values = {f"{P}v{i}": c for i, c in enumerate(sums.values())}
    placed = written(numbered(rows.withColumns(values), order, key).withColumn(f"{P}b", F.expr(f"{P}at div {block}")), "running")
    totals = placed.groupBy(key, f"{P}b").agg(*[F.sum(v).alias(f"{v}t") for v in values])
    before = Window.partitionBy(key).orderBy(f"{P}b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = totals.select(F.col(key).alias(f"{P}k"), F.col(f"{P}b").alias(f"{P}c"), *[F.coalesce(F.sum(f"{v}t").over(before), F.lit(0)).alias(f"{v}s") for v in values])
    here = Window.partitionBy(key, f"{P}b").orderBy(f"{P}at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({v: F.sum(v).over(here) for v in values})
    joined = local.join(starts, F.col(key).eqNullSafe(F.col(f"{P}k")) & (F.col(f"{P}b") == F.col(f"{P}c")))
    return joined.select(*rows.columns, *[(F.col(v) + F.col(f"{v}s")).alias(name) for name, v in zip(sums, values, strict=True)])


def sliding(rows: DataFrame, order: list[str | Column], key: str, n: int, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """The rows with sums over themselves and the n - 1 rows of their key before them; n is at most the block's size."""
    if n > block:
        raise ValueError("more rows than a block has")
    values = {f"{P}v{i}": c for i, c in enumerate(sums.values())}
    placed = numbered(rows.withColumns(values), order, key).withColumn(f"{P}b", F.expr(f"{P}at div {block}"))
    # the last rows of a block go to the next one too
    both = F.when(F.col(f"{P}at") % block > block - n, F.array(F.col(f"{P}b"), F.col(f"{P}b") + 1)).otherwise(F.array(f"{P}b"))
    dealt = placed.withColumn(f"{P}c", F.explode(both))
    here = Window.partitionBy(key, f"{P}c").orderBy(f"{P}at").rowsBetween(-(n - 1), 0)
    summed = dealt.withColumns({v: F.sum(v).over(here) for v in values}).where(F.col(f"{P}b") == F.col(f"{P}c"))
    return summed.select(*rows.columns, *[F.col(v).alias(name) for name, v in zip(sums, values, strict=True)])
