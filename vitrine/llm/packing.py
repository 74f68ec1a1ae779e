"""Packing token pieces into as few sequences as can be, by bin completion over the table of lengths.

A length is at most the capacity, so the whole input's lengths are a table of at most ``capacity`` counts: that
is all the driver gets. There bin completion runs over counts instead of pieces: around the largest length left
it enumerates the undominated fillings of the gap, those of least waste first. A filling is dominated where pieces of
it (or none) can be exchanged for one larger piece that is left and still fits. Each is taken as often as the counts
allow, then fewer times, and the search backs up where what is left needs too many sequences to beat the incumbent,
first the best-fit-decreasing solution. It ends at the lower bound, when nothing is left to try (the packing is then
of fewest sequences), or after ``node_limit`` fillings taken or ``step_limit`` steps of enumeration, whichever comes
first; these limits bound the driver's seconds, and drop no piece. Only the last ``OPEN`` lengths that the search stands
at hold their enumeration; one further back is started anew when the search backs up to it, so the driver's memory is
bounded too.

The solution is a list of patterns, each with the number of sequences made alike. The pieces of a length are
numbered across the cluster (a hash bucket within the length at a time, so no task holds a length) and the n-th
piece takes the n-th place that the patterns have for its length.

Defined results: a null or empty text is one piece that holds the end id; equal rows are packed each for itself,
and of rows with a repeated doc_id none is told from the other; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table, written
from vitrine.llm.encode import END, encoder, vocabulary

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
NODE_LIMIT = 20_000
STEP_LIMIT = 10_000_000
OPEN = 16
ROWS_PER_BUCKET = 500
BROADCAST_ROWS = 200_000  # of places; about 10 MB
BATCH_BYTES = 32 << 20

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), sequences


# ---------------------------------------------------------------- the plan, on the table of lengths


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that are needed at least: by the sum, and by what fits beside pieces of more than half the capacity."""
    lengths = np.arange(capacity + 1)
    n, sizes = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    half = capacity // 2
    small = np.arange(1, half + 1)
    alone = n[capacity + 1] - n[capacity - small + 1]  # nothing of at least ``small`` fits beside these
    mid = n[capacity - small + 1] - n[half + 1]
    room = capacity * mid - (sizes[capacity - small + 1] - sizes[half + 1])
    rest = sizes[half + 1] - sizes[small]
    more = np.maximum(0, -((room - rest) // capacity))
    return int(max(-(-sizes[-1] // capacity), n[capacity + 1] - n[half + 1], (alone + mid + more).max(initial=0)))


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: sequences that are alike are filled together."""
    by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    open_gaps: list[int] = []
    import bisect

    def put(gap: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if not by_gap[gap]:
            bisect.insort(open_gaps, gap)
        by_gap[gap].append((pattern, n))

    for length in np.nonzero(counts)[0][::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                if n := left // each:
                    put(capacity - each * length, ((length, each),), n)
                if rest := left % each:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            gap = open_gaps[at]
            pattern, n = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps.pop(at)
            each = gap // length
            full = min(n, left // each)
            if full:
                put(gap - each * length, (*pattern, (length, each)), full)
            left, n = left - full * each, n - full
            if n and left:
                put(gap - left * length, (*pattern, (length, left)), 1)
                left, n = 0, n - 1
            if n:
                put(gap, pattern, n)
    return [p for group in by_gap.values() for p in group]


class _Enough(Exception):
    """The search has used up its limits."""


class _Work:
    def __init__(self, nodes: int, steps: int):
        self.nodes, self.steps = nodes, steps

    def step(self, n: int = 1) -> None:
        self.steps -= n
        if self.steps < 0:
            raise _Enough


def _reach(xs: list[int], n: list[int], most: int) -> list[int]:
    """For each i, the sums up to ``most`` that pieces of the lengths xs[i:] have, as bits of an integer."""
    mask, out = (1 << (most + 1)) - 1, [1]
    for x, left in zip(reversed(xs), reversed(n), strict=True):
        sums, left, k = out[-1], min(left, most // x), 1
        while left:
            k = min(k, left)
            sums |= (sums << (x * k)) & mask
            left, k = left - k, 2 * k
        out.append(sums)
    return out[::-1]


def _of_sum(xs: list[int], n: list[int], reach: list[int], i: int, s: int, work: _Work) -> Iterator[tuple[tuple[int, int], ...]]:
    """All multisets of the lengths xs[i:], n[i:] of each at most, whose sum is s; the larger pieces first."""
    if not s:
        yield ()
        return
    while i < len(xs):
        work.step()
        x = xs[i]
        for k in range(min(n[i], s // x), 0, -1):
            if reach[i + 1] >> (s - k * x) & 1:
                for rest in _of_sum(xs, n, reach, i + 1, s - k * x, work):
                    yield ((x, k), *rest)
        if not reach[i + 1] >> s & 1:
            return
        i += 1


def _spread(bits: int, most: int) -> int:
    """Each bit also at the next ``most`` places."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[tuple[int, int], ...], waste: int, free: int) -> bool:
    """Whether pieces of the filling, or none, can be exchanged for one piece of ``free`` (its lengths' bits) that is at least as long as they are and leaves the waste at zero or more."""
    one, more = 0, 0  # sums of one piece, of several
    for x, k in filling:
        for _ in range(k):
            more |= (one | more) << x
            one |= 1 << x
    return bool(free & (_spread(more, waste) | (_spread(one, waste - 1) << 1 if waste else 0) | ((2 << waste) - 2)))


def fillings(counts: np.ndarray, gap: int, work: _Work) -> Iterator[dict[int, int]]:
    """The undominated fillings of a gap, those of least waste first: a piece that fits exactly dominates all; exact pairs can't be dominated then."""
    xs = np.nonzero(counts[: gap + 1])[0][::-1] if gap > 0 else np.zeros(0, np.int64)
    if not len(xs):
        yield {}
        return
    if xs[0] == gap:
        yield {gap: 1}
        return
    a = xs[2 * xs >= gap]
    for x in a[(counts[gap - a] > 0) & ((2 * a != gap) | (counts[a] > 1))].tolist():
        yield {x: 1, gap - x: 1} if 2 * x != gap else {x: 2}
    lengths, n = xs.tolist(), counts[xs].tolist()
    work.step(len(lengths))
    reach, free = _reach(lengths, n, gap), sum(1 << x for x in lengths)
    for waste in range(gap + 1):
        if not reach[0] >> (gap - waste) & 1:
            continue
        for filling in _of_sum(lengths, n, reach, 0, gap - waste, work):
            if waste or sum(k for _, k in filling) > 2:
                spent = sum(1 << x for x, k in filling if k == counts[x])
                if not dominated(filling, waste, free & ~spent):
                    yield dict(filling)


class _Node:
    """The sequences around the largest length left: the patterns to try there, each as often as can be, then fewer times."""

    def __init__(self, left: np.ndarray, capacity: int, work: _Work, above: _Node | None):
        self.top, self.left, self.work, self.times = int(np.flatnonzero(left)[-1]), left, work, 0
        self.gap = capacity - self.top
        # a pattern that the node above has taken for the same length it has taken as often as it is to be
        self.done = above.done | {above.pattern} if above and above.top == self.top else frozenset()
        self.pattern: tuple[tuple[int, int], ...] = ()
        self.tried, self.fillings = 0, None

    def next(self) -> bool:
        if self.times > 1:
            self.times -= 1
            return True
        if self.fillings is None:
            inside = self.left.copy()
            inside[self.top] -= 1
            self.fillings = islice(fillings(inside, self.gap, self.work), self.tried, None)
        for filling in self.fillings:
            self.tried += 1
            pattern = filling | {self.top: filling.get(self.top, 0) + 1}
            self.pattern = tuple(sorted(pattern.items(), reverse=True))
            if self.pattern not in self.done:
                self.times = min(int(self.left[x]) // k for x, k in self.pattern)
                return True
        return False


def bin_completion(counts: np.ndarray, capacity: int, node_limit: int = NODE_LIMIT, step_limit: int = STEP_LIMIT) -> list[Pattern]:
    """Patterns that pack all counts (counts[length], length 1 to capacity)."""
    left = counts.astype(np.int64).copy()
    total, need, best = int((left * np.arange(len(left))).sum()), lower_bound(left, capacity), best_fit(left, capacity)
    incumbent, sequences, rest = sum(n for _, n in best), 0, total
    work, above = _Work(node_limit, step_limit), []

    def put(node: _Node, sign: int) -> None:
        nonlocal sequences, rest
        for x, k in node.pattern:
            left[x] -= sign * k * node.times
            rest -= sign * x * k * node.times
        sequences += sign * node.times

    try:
        node = _Node(left, capacity, work, None) if incumbent > need else None
        while node:
            if not node.next():
                node = above.pop() if above else None
                if node:
                    put(node, -1)
                continue
            work.nodes -= 1
            if work.nodes < 0:
                break
            put(node, 1)
            fits = sequences + -(-rest // capacity) < incumbent
            if not fits or sequences + lower_bound(left, capacity) >= incumbent:
                put(node, -1)
                if not fits and node.times == 1:  # the fillings still to come waste as much or more
                    node = above.pop() if above else None
                    if node:
                        put(node, -1)
                continue
            if rest:
                above.append(node)
                if len(above) > OPEN:
                    above[-OPEN - 1].fillings = None
                node = _Node(left, capacity, work, node)
                continue
            best, incumbent = [(x.pattern, x.times) for x in (*above, node)], sequences
            if incumbent == need:
                break
            put(node, -1)
    except _Enough:
        pass
    assert sum(n * k * x for p, n in best for x, k in p) == total
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, per sequence, first sequence, offset): the place of the pieces numbered first to end - 1 of a length."""
    upto: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, upto[length], upto[length] + n * each, each, sequence, offset))
            upto[length] += n * each
            offset += length * each
        sequence += n
    return rows


# ---------------------------------------------------------------- pieces and places, across the cluster


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of each document's pieces."""
    path = tokenizer or vocabulary(VOCABULARY)
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc, ids in zip(b.column(0).to_pylist(), enc.payloads(t.as_py() for t in b.column(1)), strict=True):
                data = ids + END
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
                held += len(data) * with_ids
                if held > BATCH_BYTES:
                    yield _batch(rows, names)
                    rows, held = [], 0
            yield _batch(rows, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return in_batches(docs.select(F.col(key).cast("long"), F.col(text).cast("binary")), cut, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)


def pack(parts: DataFrame, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> DataFrame:
    """The pieces, any rows with doc_id, piece, ids_crc32 and length (1 to capacity), with sequence_id and offset. Reads them three times: give a written table."""
    spark = parts.sparkSession
    lengths = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["n"]
    rows = places(bin_completion(counts, capacity, node_limit)) if lengths else []
    spots = spark.createDataFrame(rows, "l long, first long, end long, each long, seq0 long, off0 long")
    buckets = spark.createDataFrame([(r["length"], -(-r["n"] // ROWS_PER_BUCKET)) for r in lengths], "b_length long, buckets long")
    spread = parts.join(F.broadcast(buckets), F.col("length") == F.col("b_length")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("s_length"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = spread.withColumn("no", F.row_number().over(inside) - 1).join(bases, (F.col("length") == F.col("s_length")) & (F.col("bucket") == F.col("s_bucket"))).withColumn("no", F.col("no") + F.col("base"))
    placed = numbered.join(F.broadcast(spots) if len(rows) <= BROADCAST_ROWS else spots, (F.col("length") == F.col("l")) & (F.col("no") >= F.col("first")) & (F.col("no") < F.col("end")))
    nth = F.col("no") - F.col("first")
    return placed.select(*parts.columns, (F.col("seq0") + F.expr("(no - first) div each")).alias("sequence_id"), (F.col("off0") + (nth % F.col("each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Every document's pieces with their ids, and where each goes."""
    return pack(written(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity, node_limit)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
