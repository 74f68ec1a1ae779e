"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of a piece form a doubly linked list; a heap holds the ranks of its adjacent pairs. The lowest rank, of
equal ones the leftmost, is popped again and again; a popped pair that is no longer there is passed over; a merge
links the new symbol to its neighbours and pushes its two new pairs. The count is the number of initial symbols less
the number of merges. No identifiers are made.

Text is first cut as the vocabulary's library does: at special strings (one token each), then into runs with their
leading blank, then by script class within a run. A worker counts each distinct run once and keeps the count in a
table of bounded size, long runs aside; a long text is counted in parts. Merging a piece of n bytes costs n log n, so a text of one very long word is no exception.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal rows have equal counts; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table
from vitrine.llm.encode import vocabulary

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_RUNS = 400_000
LONG_RUN = 200  # longer ones are not kept
PART_CHARS = 1 << 19
#: The white space of the library's patterns, and its classes of pieces inside a run.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A single blank between two runs of other signs: a text can be cut before it.
BETWEEN = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])").search
_counters: dict[str, Counter] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's visible ones for themselves, the others in order from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class Counter:
    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.runs, self.pieces = re.compile(RUNS).findall, regex.compile(PIECES).findall
        self.cache_runs, self.known = cache_runs, {}

    def piece(self, piece: str) -> int:
        """Tokens of one piece."""
        sym = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, ranks = len(sym), self.ranks
        if n < 2:
            return n
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, ""
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def learn(self, runs: set[str]) -> dict[str, int]:
        """Count what isn't known; long runs are not kept, but given back."""
        if len(self.known) > self.cache_runs:
            self.known.clear()
        long: dict[str, int] = {}
        for run in runs:
            if run not in self.known:
                (self.known if len(run) <= LONG_RUN else long)[run] = sum(map(self.piece, self.pieces(run)))
        return long

    def part(self, text: str) -> int:
        runs = self.runs(text)
        try:
            return sum(map(self.known.__getitem__, runs))
        except KeyError:
            long = self.learn(set(runs))
            return sum(long[r] if r in long else self.known[r] for r in runs)

    def plain(self, text: str) -> int:
        """Of a text without special strings, a part of it at a time: a blank between two words begins the second one's run."""
        total = at = 0
        while len(text) - at > PART_CHARS and (m := BETWEEN(text, at + PART_CHARS)):
            total, at = total + self.part(text[at : m.start()]), m.start()
        return total + self.part(text[at:] if at else text)

    def count(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def counter(path: str) -> Counter:
    """One a worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row."""
    path = tokenizer or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            n = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return in_batches(docs.select(F.col(key).cast("long"), F.col(text).cast("string"), size.alias("n")), run, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
