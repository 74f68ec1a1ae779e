"""Exact top-k by inner product on a pivot-distance index.

The largest inner product with a query q is the nearest neighbour of (q, 0) among the points (x, sqrt(M^2 - |x|^2)),
M the largest norm: |(q, 0) - (x, ..)|^2 = |q|^2 + M^2 - 2 q.x. In that space every vector is keyed by its nearest pivot
and its distance to it; the pivots are means of a bounded sample. Ordered by this key the vectors are cut into
annuli of at most ``annulus_rows`` vectors, each one row of packed numbers with its pivot and its two radii.

Search: an annulus' own queries score it first, which bounds the distance of their k-th neighbour. By the
triangle inequality an annulus of radii [lo, hi] round a pivot at distance d holds nothing nearer than
max(lo - d, d - hi), so a block of queries meets only the annuli within its bounds. A task takes a block's annuli
from the nearest outwards; what is found narrows the bounds, and each query reads an annulus between its own bounds
only, or not at all. A block and an annulus are of bounded size; a task sends at most k candidates of a query on,
and the last step ranks those. Bounds are widened by a relative margin, so rounding loses nothing; scores are
integers.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates, nor do rows with a null id; rows with a repeated id are each a candidate of every other
row, and each a query with k results of its own under that id; shorter vectors count as followed by zeros; ties go to the smaller id; fewer than k candidates are all
returned; an empty table gives no rows; further columns are not read. Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table, written

PIVOTS, MOST_PIVOTS = 64, 512  # as many as a quarter of the root of the rows, between these
SAMPLE_ROWS = 4096  # that pivots are fitted on
ANNULUS_ROWS = 4096
MARGIN = 1e-9
SEED = 3


def vectors(rows: DataFrame, scale: float | None = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v: the components as longs, floor(scale * x), of each row that takes part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(ok).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Of lists of longs, as floats, padded by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)))


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Means of the sample's groups, a few rounds of reassignment."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(SEED).permutation(len(centres))[:pivots]]
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = sample[near == j].mean(0)
    return centres


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integers given as floats: exact in floats where no sum can pass 2**53, else in longs."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of each row, by score, then smaller id; filled up with NONE."""
    n = scores.shape[1]
    if n <= k:
        pad = ((0, 0), (0, k - n))
        return np.pad(scores, pad, constant_values=NONE), np.pad(np.broadcast_to(ids, scores.shape), pad)
    at = np.argpartition(scores, n - k, axis=1)[:, n - k :]
    kth = np.take_along_axis(scores, at, 1).min(1)
    for row in np.nonzero((scores >= kth[:, None]).sum(1) > k)[0]:  # ties at the end: the smaller ids
        some = np.nonzero(scores[row] >= kth[row])[0]
        at[row] = some[np.lexsort((ids[some], -scores[row, some]))[:k]]
    return np.take_along_axis(scores, at, 1), ids[at]


NONE = np.iinfo(np.int64).min + 1
BLOCK_QUERIES = 2048
_ANNULUS = "annulus long, pivot int, lo double, hi double, n long, rows binary, ids binary, vectors binary, n_queries long, query_rows binary, query_ids binary, query_vectors binary, bounds binary"
_BLOCK = "own long, query_rows binary, query_ids binary, query_vectors binary, bounds binary"


def _row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def index(found: DataFrame, k: int, every: int, pivots: np.ndarray, most: float, dim: int, kind: str, annulus_rows: int = ANNULUS_ROWS) -> DataFrame:
    """The annuli. Rows whose id is divisible by ``every`` are also queries; their k-th best score in the annulus is their first bound."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_lifted(_matrix(b.column(2), dim), most), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["row", "vec_id", "v", "pivot", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0

        def annulus(rows: pa.Table) -> pa.RecordBatch:
            nonlocal no
            rows = rows.combine_chunks()
            no_of, ids, x, d = rows["row"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["v"].chunk(0), dim), rows["d"].to_numpy()
            at = np.nonzero(ids % every == 0)[0]
            bounds = np.full(len(at), NONE)
            if len(ids) > k and len(at):
                s = _scores(x[at], x)
                s[np.arange(len(at)), at] = NONE
                bounds = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
            no += 1
            values = [(part << 32) | no, int(rows["pivot"][0].as_py()), float(d[0]), float(d[-1]), len(ids), no_of.tobytes(), ids.tobytes(), x.astype(kind).tobytes()]
            return _row(_ANNULUS, [*values, len(at), no_of[at].tobytes(), ids[at].tobytes(), x[at].astype(kind).tobytes(), bounds.astype("<i8").tobytes()])

        waiting: pa.Table | None = None
        for b in batches:
            some = pa.Table.from_batches([b])
            waiting = pa.concat_tables([waiting, some]) if waiting is not None else some
            while waiting.num_rows:
                pivot = waiting["pivot"].combine_chunks().to_numpy()
                other = pivot != pivot[0]
                same = int(other.argmax()) if other.any() else len(pivot)
                if same == len(pivot) and same < annulus_rows:
                    break
                yield annulus(waiting.slice(0, min(same, annulus_rows)))
                waiting = waiting.slice(min(same, annulus_rows))
        if waiting is not None and waiting.num_rows:
            yield annulus(waiting)

    near = in_batches(found, assign, "row long, vec_id long, v array<long>, pivot int, d double")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(near.repartitionByRange(n, "pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id"), cut, _ANNULUS)


def query_blocks(annuli: DataFrame, dim: int, kind: str, size: int = BLOCK_QUERIES) -> DataFrame:
    """The queries of the annuli, neighbours in the index together, in blocks of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, width = TaskContext.get().partitionId(), 0, dim * np.dtype(kind).itemsize
        held = [b"", b"", b"", b""]
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = [x + y for x, y in zip(held, row, strict=True)]
                while len(held[0]) >= 8 * size:
                    no += 1
                    yield _row(_BLOCK, [(part << 32) | no, *(h[: w * size] for h, w in zip(held, (8, 8, width, 8), strict=True))])
                    held = [h[w * size :] for h, w in zip(held, (8, 8, width, 8), strict=True)]
        if held[0]:
            yield _row(_BLOCK, [(part << 32) | (no + 1), *held])

    n = annuli.agg(F.sum("n_queries")).first()[0] or 0
    some = annuli.where("n_queries > 0").select("query_rows", "query_ids", "query_vectors", "bounds")
    return in_batches(some.coalesce(max(1, -(-n // (4 * size)))), run, _BLOCK)


def _reaches(blocks: DataFrame, pivots: np.ndarray, most: float, dim: int, kind: str) -> DataFrame:
    """own, p, near, far, mid: between which radii round each pivot a block's queries can have neighbours, and round which they look first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["own", "p", "near", "far", "mid"]
        for b in batches:
            for own, x, bounds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)
                d, r = _distances(np.pad(q, ((0, 0), (0, 1))), pivots), _radii(q, np.frombuffer(bounds, "<i8"), most)[:, None]
                columns = [np.full(len(pivots), own), np.arange(len(pivots), dtype=np.int32), (d - r).min(0), (d + r).max(0), d.mean(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return in_batches(blocks.select("own", "query_vectors", "bounds"), run, "own long, p int, near double, far double, mid double")


def _radii(q: np.ndarray, bounds: np.ndarray, most: float) -> np.ndarray:
    """How far the k-th neighbour can be at most, widened against rounding; no bound: anywhere."""
    whole = (q * q).sum(1) + most
    square = np.where(bounds <= NONE, np.inf, whole - 2.0 * bounds)
    return np.sqrt(np.maximum(0, square)) + MARGIN * np.sqrt(whole) + np.sqrt(1e-12 * whole)


class _Search:
    """A block of queries: what is found so far, and how far each query still looks."""

    def __init__(self, rows: bytes, ids: bytes, vectors: bytes, bounds: bytes, k: int, dim: int, kind: str):
        self.own, self.ids, self.k = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), k
        self.q = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        self.bounds = np.frombuffer(bounds, "<i8").copy()
        self.scores, self.found = np.full((len(self.ids), k), NONE), np.zeros((len(self.ids), k), np.int64)

    def meet(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, centre: np.ndarray, most: float) -> None:
        """Look into an annulus, its vectors in order of their distance to the pivot: each query at those between its bounds."""
        radii = _distances(_lifted(x, most), centre)[:, 0]
        d, r = _distances(np.pad(self.q, ((0, 0), (0, 1))), centre)[:, 0], _radii(self.q, self.bounds, most)
        slack = 1e-6 * (1 + radii.max())  # the order was made from the same distances, up to rounding
        low = np.searchsorted(np.minimum.accumulate(radii[::-1])[::-1], d - r - slack)
        high = np.searchsorted(np.maximum.accumulate(radii), d + r + slack, side="right")
        use = np.nonzero(high > low)[0]
        for at in range(0, len(use), 512):
            some = use[at : at + 512]
            s, e = int(low[some].min()), int(high[some].max())
            score = _scores(self.q[some], x[s:e])
            _, row, column = np.intersect1d(self.own[some], rows[s:e], assume_unique=True, return_indices=True)
            score[row, column] = NONE  # the query itself
            new, who = _best(score, ids[s:e], self.k)
            new, who = np.concatenate([self.scores[some], new], 1), np.concatenate([self.found[some], who], 1)
            order = np.lexsort((who, -new), axis=1)[:, : self.k]
            self.scores[some], self.found[some] = np.take_along_axis(new, order, 1), np.take_along_axis(who, order, 1)
            self.bounds[some] = np.maximum(self.bounds[some], self.scores[some, -1])

    def rows(self) -> pa.RecordBatch:
        keep = self.scores > NONE
        each = lambda x: np.broadcast_to(x[:, None], keep.shape)[keep]
        columns = [each(self.own), each(self.ids), self.found[keep], self.scores[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])


def search(annuli: DataFrame, k: int, pivots: np.ndarray, most: float, dim: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, None
        for b in batches:
            for i in range(b.num_rows):
                own, q_rows, q_ids, q_vectors, bounds, pivot, rows, ids, vectors = (c[i].as_py() for c in b.columns[:9])
                if own != current:
                    if block is not None:
                        yield block.rows()
                    current, block = own, _Search(q_rows, q_ids, q_vectors, bounds, k, dim, kind)
                block.meet(np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64), np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), pivots[pivot][None], most)
        if block is not None:
            yield block.rows()

    blocks = written(query_blocks(annuli, dim, kind), "queries")
    rings = annuli.select("annulus", F.col("pivot").alias("p"), "lo", "hi")
    gap = F.greatest(F.col("lo") - F.col("mid"), F.col("mid") - F.col("hi"), F.lit(0.0))
    pairs = _reaches(blocks, pivots, most, dim, kind).join(rings, "p").where("near <= hi AND far >= lo").select("own", "annulus", gap.alias("gap"))
    pairs = pairs.join(annuli.select("annulus", "pivot", "rows", "ids", "vectors"), "annulus").join(blocks, "own")
    # in a task the annuli of a block come from the nearest outwards
    near = pairs.sortWithinPartitions("own", "gap").select("own", "query_rows", "query_ids", "query_vectors", "bounds", "pivot", "rows", "ids", "vectors")
    met = in_batches(near, meet, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int | None = None, annulus_rows: int = ANNULUS_ROWS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: the k other rows of largest inner product."""
    # written with a number for each row, so that a query is told from other rows of its id
    found = written(vectors(rows, scale, key, vector).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    dim, most, top = facts["dim"] or 1, facts["most"] or 0.0, facts["top"] or 0
    kind = next((t for t in ("<i2", "<i4") if top <= np.iinfo(t).max), "<i8")  # of the components as they are packed
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(facts["n"] ** 0.5) // 4))
    sample = found.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(SAMPLE_ROWS).collect()
    x = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        x[i, : len(r["v"])] = r["v"]
    centres = fit_pivots(_lifted(x, most), pivots) if len(sample) else np.zeros((1, dim + 1))
    annuli = written(index(found, k, every, centres, most, dim, kind, annulus_rows), "annuli")
    return search(annuli, k, centres, most, dim, kind)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.r <> q.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
