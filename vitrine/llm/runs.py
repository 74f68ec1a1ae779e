"""Periodic runs: a harmonic grid, vectorised prefix hashes and binary searches for common extensions.

A run of period p and at least 2p words holds two neighbouring grid points i = kp and j = i + p whose words are equal.
So for every period up to half a text all grid points are looked at, n/1 + n/2 + ... pairs, n log n in all; from
the pairs with equal words the longest common extensions forwards and backwards are found by binary search, over all
(period, grid point) pairs of many texts at a time, each probe being one comparison of prefix hashes. Runs found from
several grid points or for multiples of their period are made one, under the smallest period.

Hashes are polynomials modulo 2**64: equal words give equal hashes, so an extension is never found too short; one
found too long shows when the words themselves are compared, and the stretches that really agree take its place.

Texts of a batch are worked on together up to ``CHUNK`` words, a longer one by itself; pairs by ``PAIRS`` at a time. So
memory follows the longest text, not the number of its pairs.

Defined results: a null, empty or blank text has no words, no runs and an empty rest; a null id is kept; repeated rows
each have their own result; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table

LEAST = 12  # words of a run
CHUNK = 1 << 18
PAIRS = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that no power of it vanishes
NEAR = 3  # words beside a grid point, on one side or the other, that any run of LEAST words has equal too

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring numbers of words have unlike values."""
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Texts side by side, as numbers of words, and prefix hashes over all of them."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, base: int = BASE):
        """bounds: where each text begins, and the end of the last."""
        self.ids, self.bounds = ids, bounds
        self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), base, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(ids.astype(np.uint64)) * self.powers[:-1], dtype=np.uint64)])

    def same(self, i: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of n words from i and from i + p agree."""
        j = i + p
        return (self.sums[i + n] - self.sums[i]) * self.powers[p] == self.sums[j + n] - self.sums[j]

    def grid(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, i, period) of the pairs whose words, and some beside them, are equal."""
        size = np.diff(self.bounds)
        texts = np.flatnonzero(size >= least)
        half = size[texts] // 2
        of = np.repeat(texts, half)  # of each (text, period): the text, the period, how many pairs
        period = np.arange(len(of)) - np.repeat(np.cumsum(half) - half, half) + 1
        pairs = (size[of] - 1) // period
        upto = np.cumsum(pairs)
        near = NEAR if least >= 12 else 0
        at = 0
        while at < len(of):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - pairs[at] + PAIRS, "right")))
            n = pairs[at:end]
            t, p = np.repeat(of[at:end], n), np.repeat(period[at:end], n)
            i = self.bounds[t] + p * (np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n))
            hit = np.flatnonzero(self.ids[i] == self.ids[i + p])
            t, p, i = t[hit], p[hit], i[hit]
            left, right = np.ones(len(i), bool), np.ones(len(i), bool)
            for d in range(1, near + 1):
                ahead = np.minimum(i + d, len(self.ids) - 1 - p)
                right &= (i + p + d < self.bounds[t + 1]) & (self.ids[ahead] == self.ids[ahead + p])
                back = np.maximum(i - d, 0)
                left &= (i - d >= self.bounds[t]) & (self.ids[back] == self.ids[back + p])
            hit = np.flatnonzero(left | right)
            yield t[hit], i[hit], p[hit]
            at = end

    def extent(self, t: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretch around each pair begins and ends, by two binary searches over all pairs at once."""
        low, high = np.ones(len(i), np.int64), self.bounds[t + 1] - i - p
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            good = self.same(i[open_], p[open_], middle)
            low[open_] = np.where(good, middle, low[open_])
            high[open_] = np.where(good, high[open_], middle - 1)
        back, high = np.zeros(len(i), np.int64), i - self.bounds[t]
        while (open_ := np.flatnonzero(back < high)).size:
            middle = (back[open_] + high[open_] + 1) // 2
            good = self.same(i[open_] - middle, p[open_], middle)
            back[open_] = np.where(good, middle, back[open_])
            high[open_] = np.where(good, high[open_], middle - 1)
        return i - back, i + p + low

    def runs(self, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
        """Of each text its runs as (start, length, period), by start, then period."""
        found = [np.zeros((0, 4), np.int64)]
        for t, i, p in self.grid(least):
            s, e = self.extent(t, i, p)
            long = e - s >= np.maximum(least, 2 * p)
            found.append(np.unique(np.stack([s, e, p, t], 1)[long], axis=0))
        rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
        # a stretch of several periods is a run of the smallest, of which the others are multiples
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.zeros(0, bool)
        first = np.flatnonzero(new).tolist() + [len(rows)]
        good: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in zip(first, first[1:]):
            for s, e, p, t in rows[a:b].tolist():
                if np.array_equal(self.ids[s : e - p], self.ids[s + p : e]):
                    good[s, e] = min(good.get((s, e), (p, t)), (p, t))
                    break
                for x, y in _stretches(self.ids[s : e - p] == self.ids[s + p : e]):
                    if y - x + p >= max(least, 2 * p):
                        key = (s + x, s + y + p)
                        good[key] = min(good.get(key, (p, t)), (p, t))
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.bounds[1:]]
        for (s, e), (p, t) in good.items():
            out[t].append((s - int(self.bounds[t]), e - s, p))
        return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """The longest stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        marks[s + p] += 1
        marks[s + length] -= 1
    return np.cumsum(marks[:-1]) == 0


def find(texts: list[list[bytes]], least: int = LEAST, base: int = BASE) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    bounds = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(bounds[-1]))
    return Words(ids, bounds, base).runs(least)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Of each row doc_id, runs (start, length, period) in words and collapsed, the text without the words that a run repeats.

    edit: what to make of a row's words first, given its id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part: list[list[bytes]] = []
            keys: list[int | None] = []
            held = 0
            for k, t in zip(b.column(0), b.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if edit:
                    words = edit(k.as_py(), words)
                if part and held + len(words) > CHUNK:
                    yield _rows(keys, part, least)
                    keys, part, held = [], [], 0
                keys.append(k.as_py())
                part.append(words)
                held += len(words)
            if part:
                yield _rows(keys, part, least)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return in_batches(rows, work, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _rows(keys: list[int | None], texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    runs = find(texts, least)
    rest = [b" ".join(compress(w, kept(len(w), r).tolist()) if r else w) for w, r in zip(texts, runs, strict=True)]
    spans = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], pa.list_(RUN))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), spans, pa.array(rest, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in a tenth of the rows, chosen by the id, the words from some place on repeat a few of them. A row without an id stays as it is."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), edit=planted)
    # the longest run, then the first, then that of the smallest period
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = rows.select("doc_id", "runs", "collapsed", order.alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
