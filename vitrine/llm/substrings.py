"""Substring de-duplication: documents stream through suffix automata of the reference passages that they may share.

A window is ``least`` consecutive words of a document. It goes where its words also begin in a document of a smaller id.

The reference is every document, far too much for one automaton or for every task. So it is cut into shards that windows
find by themselves: a window's anchor is the least hash of its runs of ``gram`` words, the first of equal ones. Windows of
the same words have the same anchor, at the same place in them, so a window can only recur within its anchor's shard.
Neighbouring windows of one anchor make a passage, some 66 words for windows of 50.

1. Every text is read once for its anchors and the hashes of their passages, 16 bytes for some 18 words.
2. An anchor of one document only has nothing to find and goes. Of the others the documents with equal passages are told
   by the passage's hash: all but the smallest id hold nothing new there.
3. An anchor with several passages is a shard. Its passages, each from its smallest document, come in order of those ids;
   each streams through the automaton of those of smaller documents, whose matching statistics say after each word how
   many words up to it stand in the reference; ``least`` or more is a window to remove. Then it joins the reference.
   Automata are built where a shard's documents meet; broadcasting all of them to all tasks would take each document
   through each shard, and their size has no bound but that of the corpus.
4. A shard of more than ``MAX_PASSAGES`` passages is cut by the windows themselves: each window of it is found by its
   own hash of 128 bits, wherever it stands. No case is dropped.
5. What is found goes back to the documents, whose words are marked and taken out.

Defined results: a null, empty or blank text has no words; a null id has no order, so nothing is removed from such a row
and nothing because of it; rows of one id, with the same or other texts, don't remove words of each other; an empty
table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import drop_path, in_batches, new_path, table

LEAST = 50  # words of a window
GRAM = 16  # words of an anchor
MAX_PASSAGES = 1000  # of a shard that one automaton holds
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
KNOWN_WORDS = 1 << 20  # whose hashes a task remembers


class _Hashes(dict):
    """A word's hash, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Cutter:
    """Cuts texts into passages."""

    def __init__(self, least: int = LEAST, gram: int = GRAM):
        self.least, self.gram = least, min(gram, least)
        self.hashes = _Hashes()
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = 2 * n + 1024
            self.powers, self.inverses = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, INVERSE))

    def grams(self, words: list[bytes]) -> np.ndarray:
        """A hash of each run of gram words."""
        n = len(words)
        self._grow(n)
        values = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers[:n], dtype=np.uint64)])
        x = (sums[self.gram :] - sums[: -self.gram]) * self.inverses[: n - self.gram + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))

    def passages(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage its anchor, its first word and the one after its last."""
        n = len(words) - self.least + 1  # windows
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        grams = self.grams(words)
        view = np.lib.stride_tricks.sliding_window_view(grams, self.least - self.gram + 1)
        at = np.concatenate([view[i : i + 4096].argmin(1) for i in range(0, n, 4096)]) + np.arange(n)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:], [n]]) - 1
        return grams[at[first]].view(np.int64), first, last + self.least

    def hashed(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, hash, start, end) of each passage."""
        anchors, starts, ends = self.passages(words)
        if len(anchors):
            text = b" ".join(words)
            place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            for a, s, e, x, y in zip(anchors.tolist(), starts.tolist(), ends.tolist(), place[starts].tolist(), (place[ends] - 1).tolist(), strict=True):
                yield a, _signed(xxhash.xxh64_intdigest(text[x:y])), s, e


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Automaton:
    """The suffix automaton of several texts: a state for each set of places where the same strings end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the shorter strings of q, those that end behind p's."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Iterable[bytes]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:  # of a text before
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def statistics(self, words: Iterable[bytes]) -> Iterator[int]:
        """After each word, how many words up to it stand somewhere in the texts."""
        state = n = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            yield n


def spans(statistics: Iterable[int], least: int) -> list[tuple[int, int]]:
    """The maximal spans that windows of least words found in the reference cover."""
    out: list[list[int]] = []
    for i, n in enumerate(statistics, 1):
        if n >= least:
            if out and i - least <= out[-1][1]:
                out[-1][1] = i
            else:
                out.append([i - least, i])
    return [(s, e) for s, e in out]


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_SPANS = "array<struct<s:int,e:int>>"


def _structs(rows: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"s": s, "e": e} for s, e in rows]


def _anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """doc, x and its passages' anchors and hashes, of each row with an id; equal passages of a row once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(least, gram)
        for b in batches:
            found = [list(dict.fromkeys((a, d) for a, d, _, _ in cut.hashed((t.as_py() or b"").split()))) for t in b.column(2)]
            lists = [pa.array([[p[i] for p in some] for some in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc", "x", "a", "d"])

    rows = docs.where("doc IS NOT NULL AND t IS NOT NULL").select("doc", "x", "t")
    return in_batches(rows, work, "doc long, x long, a array<long>, d array<long>").where("size(a) > 0")


def _cut_out(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """Of rows with a list of wanted passages (a, d, hot): each one's words, or of hot ones the hashes of its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(least, gram)
        for b in batches:
            out: list[tuple] = []
            for doc, t, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = t.as_py().split()
                left = {(w["a"], w["d"]): w["hot"] for w in wanted}
                for a, d, s, e in cut.hashed(words):
                    hot = left.pop((a, d), None)
                    if hot:
                        for i in range(s, e - least + 1):
                            h = xxhash.xxh128_intdigest(b" ".join(words[i : i + least]))
                            out.append((a, d, doc, i - s, _signed(h >> 64), _signed(h & (1 << 64) - 1), None))
                    elif hot is not None:
                        out.append((a, d, doc, None, None, None, b" ".join(words[s:e])))
                    if len(out) >= 4096:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    names = ["a", "d", "owner", "at", "h1", "h2", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return in_batches(texts, work, "a long, d long, owner long, at int, h1 long, h2 long, words binary")


def _streamed(passages: DataFrame, least: int) -> DataFrame:
    """(a, d, spans) of the passages of which a smaller document holds a part. Rows of an anchor come together, in order of their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple[int, int, list]] = []
        for a, shard in groupby(rows, lambda r: r[0]):
            reference, before = Automaton(), []
            for _, own in groupby(shard, lambda r: r[1]):
                for words in before:
                    reference.add(words)
                before = []
                for d, same in groupby(own, lambda r: r[2]):
                    words = next(same)[3].split()
                    before.append(words)
                    if len(reference.next) > 1 and (found := spans(reference.statistics(words), least)):
                        out.append((a, d, _structs(found)))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), SPANS), strict=True)], names=["a", "d", "spans"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), SPANS), strict=True)], names=["a", "d", "spans"])

    dealt = passages.select("a", "owner", "d", "words").repartition("a").sortWithinPartitions("a", "owner", "d")
    return in_batches(dealt, work, f"a long, d long, spans {_SPANS}")


def _taken_out(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """doc_id, n_words, removed (spans) and kept of rows with a list of found passages (a, d, spans; null spans: all of it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(least, gram)
        for b in batches:
            out: list[tuple] = []
            for doc, t, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = (t.as_py() or b"").split()
                cover: list[tuple[int, int]] = []
                if found:
                    of = {(f["a"], f["d"]): f["spans"] for f in found}
                    for a, d, s, e in cut.hashed(words):
                        if (a, d) in of:
                            part = of[a, d]
                            cover += [(s, e)] if part is None else [(s + p["s"], s + p["e"]) for p in part]
                cover = _merged(cover)
                keep = np.ones(len(words), bool)
                for s, e in cover:
                    keep[s:e] = False
                rest = b" ".join(compress(words, keep.tolist()) if cover else words)
                out.append((doc, len(words), _structs(cover), rest))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), SPANS, pa.binary()), strict=True)]
            columns[3] = columns[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "removed", "kept"])

    return in_batches(docs, work, f"doc_id long, n_words long, removed {_SPANS}, kept string")


def _merged(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(cover):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """Of each row doc_id, n_words, removed (spans of words that documents of smaller ids have too) and kept (the other words, by single blanks)."""
    spark = docs.sparkSession
    # x tells apart rows of one id; rows that share both have the same text and the same result
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("x"), F.col(text).cast("binary").alias("t"))
    used: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(new_path(spark, f"substrings-{name}"))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    anchors = kept(_anchors(rows, least, gram), "anchors").select("doc", "x", F.explode(F.arrays_zip("a", "d")).alias("p")).select("p.a", "p.d", "doc", "x")
    met = anchors.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    # dealt anew, so that the join is of two plain exchanges and an anchor of very many documents can be split
    shared = met.where("low < high").select("a", (F.col("d0") < F.col("d1")).alias("several")).hint("rebalance")
    hits = kept(anchors.join(shared, "a"), "hits")
    drop_path(spark, used[0])
    first = kept(hits.groupBy("a", "d", "several").agg(F.min(F.struct("doc", "x")).alias("o")).select("a", "d", "several", "o.*"), "first")
    several = first.where("several")
    size = several.groupBy("a").agg((F.count(F.lit(1)) > max_passages).alias("hot")).hint("rebalance")
    wanted = several.join(size, "a").groupBy("doc", "x").agg(F.collect_list(F.struct("a", "d", "hot")).alias("wanted"))
    passages = kept(_cut_out(rows.where("doc IS NOT NULL AND t IS NOT NULL").join(wanted, ["doc", "x"]).select("doc", "t", "wanted"), least, gram), "passages")
    windows = passages.where("words IS NULL").select("a", "d", "owner", "at", "h1", "h2").distinct()
    earliest = windows.groupBy("h1", "h2").agg(F.min("owner").alias("low")).hint("rebalance")
    of_windows = windows.join(earliest, ["h1", "h2"]).where("low < owner").groupBy("a", "d").agg(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + least).alias("e"))).alias("spans"))
    parts = _streamed(passages.where("words IS NOT NULL"), least).unionByName(of_windows)
    found = first.select("a", "d", F.col("doc").alias("owner")).join(parts, ["a", "d"], "left").hint("rebalance")
    mine = hits.select("a", "d", "doc", "x").join(found, ["a", "d"]).where("doc > owner OR spans IS NOT NULL")
    removal = mine.groupBy("doc", "x").agg(F.collect_list(F.struct("a", "d", F.when(F.col("doc") == F.col("owner"), F.col("spans")).alias("spans"))).alias("found"))
    removal = kept(removal, "found").hint("rebalance")
    for path in used[1:-1]:
        drop_path(spark, path)
    return _taken_out(rows.join(removal, ["doc", "x"], "left").select("doc", "t", "found"), least, gram)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(greatest(len(w) - 49, 0))) AS i)),
f AS (SELECT h, min(doc_id) AS low FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, i + j AS k FROM v JOIN f USING (h), (SELECT unnest(range(50)) AS j) WHERE low < doc_id),
g AS (SELECT r, list(k) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
