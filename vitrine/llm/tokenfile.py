"""Token ids in binary shard files, with a minimal perfect hash index from document keys to their place.

A shard file (all integers little-endian), written from front to back while its documents are encoded:

    magic "VTOK2\\0\\0\\0"
    the ids (unsigned, of 2 bytes where the vocabulary fits in 16 bits, else of 4), document after document
    of each document in file order: key (signed 64-bit), all of them; then first id (64-bit), with one more at the end
    of each hash value: fingerprint (32-bit), then document number (32-bit), all of them side by side
    of each 64-bit word of the hash's levels: the word, and how many bits are set in all words before (64-bit each)
    of each level: its first word, and its number of bits (64-bit each)
    the trailer: documents, ids, distinct keys, words, levels, bytes an id (64-bit each), magic

The hash: at each level the keys left are hashed into a bit field; a key alone on its bit has found its value, the
rank of the bit over all levels, and the others go on to the next level. A lookup reads the trailer and the levels'
table, one word a level, about one and a half on average, then one fingerprint, which refuses nearly every key that
isn't there, the document's key, which refuses the rest, and the two ends of its ids: a few reads by offset, however
large the shard, then the payload alone. No key is searched for and no table of keys is held in memory.

Documents are range-partitioned by id, each partition is one shard in ascending order; a task writes its
shard under a name of its own and moves it into place, so a task that is run again leaves the same file. It holds
the documents of a batch at a time and 24 bytes for each of the shard. The folder is the shared one; files go through
pyarrow's file systems, so it may be local, HDFS or an object store.

Defined results: a null or empty text is the end id alone; a null doc_id comes first and is found under
``NULL_KEY``, which is its own key in the file, so that a doc_id of that value is told from it by its place only and
is read back as null; of rows with a repeated doc_id the first in file order (by text hash) is the one a lookup finds,
all are stored; an empty table writes no file and gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, new_path, qualified, table, written
from vitrine.llm.encode import END, encoder, vocabulary

MAGIC = b"VTOK2\0\0\0"
TRAILER = 56
VOCABULARY = "word_bpe_49k.json"
NULL_KEY = -(1 << 63)
GAMMA = 2.0  # bits a key left
MAX_LEVELS = 48
DEAL_BYTES = 64 << 20  # of text that a shard should hold, about
ROWS_PER_FILE = 10_000  # of the manifest
READ_IDS = 1 << 20  # ids of a shard read at a time, about


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a level or seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 977) >> np.uint64(32)).astype("<u4")


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct 64-bit keys, a minimal perfect hash: its words, each with the bits set before it; of each level its first word and number of bits; the value of each key."""
    left, at_key, words, levels, value, n_words, ranked = keys, np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0, 0
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        bits = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
        at = (_mix(left, level) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        hit = alone[at]
        value[at_key[hit]] = ranked + np.cumsum(alone)[at[hit]] - 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        levels.append((n_words, bits))
        n_words, ranked = n_words + bits // 64, ranked + int(hit.sum())
        left, at_key = left[~hit], at_key[~hit]
    if len(left):
        raise ValueError("keys of a perfect hash must be distinct")
    words = np.concatenate(words) if words else np.zeros(0, "<u8")
    before = np.cumsum(np.concatenate([[0], np.bitwise_count(words)]), dtype=np.uint64)[:-1]
    return np.stack([words, before], 1).astype("<u8"), np.array(levels, "<u8").reshape(-1, 2), value


def index_bytes(keys: np.ndarray, sizes: np.ndarray, width: int) -> list[bytes]:
    """What stands behind the ids of a shard file, from the key and number of ids of each document."""
    firsts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype("<i8")
    distinct, at = np.unique(keys, return_index=True)
    words, levels, value = perfect_hash(distinct)
    slots = np.zeros((len(distinct), 2), "<u4")
    slots[value] = np.stack([fingerprints(distinct), at.astype("<u4")], 1)
    trailer = np.array([len(keys), firsts[-1], len(distinct), len(words), len(levels), width], "<u8")
    return [keys.astype("<i8").tobytes(), firsts.tobytes(), slots.tobytes(), words.tobytes(), levels.tobytes(), trailer.tobytes(), MAGIC]


class Shard:
    """A shard file, read by offset: ``read(offset, length)`` gives its bytes. The trailer and the levels' table (at most 48 rows) are read at once."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail = read(size - TRAILER, TRAILER)
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard file")
        self.n, self.n_ids, distinct, words, levels, self.width = (int(x) for x in np.frombuffer(tail, "<u8", 6))
        self.at_keys = 8 + self.n_ids * self.width
        self.at_firsts = self.at_keys + 8 * self.n
        self.at_slots = self.at_firsts + 8 * (self.n + 1)
        self.at_words = self.at_slots + 8 * distinct
        at_levels = self.at_words + 16 * words
        self.levels = np.frombuffer(read(at_levels, 16 * levels), "<u8").reshape(-1, 2)

    def numbers(self, at: int, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.read(at, n * np.dtype(kind).itemsize), kind)

    def find(self, key: int) -> int:
        """The document number of a key, -1 where the shard has none."""
        k = np.array([key], np.int64)
        for level, (first, bits) in enumerate(self.levels.tolist()):
            bit = int(_mix(k, level)[0]) % bits
            word, before = (int(x) for x in self.numbers(self.at_words + 16 * (first + bit // 64), "<u8", 2))
            if word >> (bit % 64) & 1:
                value = before + (word & ((1 << (bit % 64)) - 1)).bit_count()
                print_, number = (int(x) for x in self.numbers(self.at_slots + 8 * value, "<u4", 2))
                found = print_ == int(fingerprints(k)[0]) and int(self.numbers(self.at_keys + 8 * number, "<i8", 1)[0]) == key
                return number if found else -1
        return -1

    def payload(self, number: int) -> np.ndarray:
        """A document's ids as unsigned 32-bit integers."""
        first, end = (int(x) for x in self.numbers(self.at_firsts + 8 * number, "<i8", 2))
        return self.numbers(8 + self.width * first, f"<u{self.width}", end - first).astype("<u4")

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """The document numbers of many keys, by the same hash over the whole index."""
        words = self.numbers(self.at_words, "<u8", (self.levels[:, 1].sum() // 64 * 2)).reshape(-1, 2) if len(self.levels) else np.zeros((0, 2), "<u8")
        slots = self.numbers(self.at_slots, "<u4", (self.at_words - self.at_slots) // 4).reshape(-1, 2)
        number, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (first, bits) in enumerate(self.levels.tolist()):
            bit = (_mix(keys[todo], level) % np.uint64(bits)).astype(np.int64)
            word, low = words[first + bit // 64], (bit % 64).astype(np.uint64)
            hit = (word[:, 0] >> low & np.uint64(1)) == 1
            value = word[hit, 1] + np.bitwise_count(word[hit, 0] & ((np.uint64(1) << low[hit]) - np.uint64(1)))
            same = slots[value, 0] == fingerprints(keys[todo[hit]])
            number[todo[hit]] = np.where(same, slots[value, 1].astype(np.int64), -1)
            todo = todo[~hit]
        return number


#: Schemes of Spark's connectors, as pyarrow names them.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _place(uri: str):
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _open(uri: str) -> tuple[Shard, Any]:
    store, path = _place(uri)
    f = store.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return Shard(read, f.size()), f


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files; the manifest, a written table: file, shard, n_docs, n_ids, start (ids in all shards before), first_key, last_key."""
    spark = docs.sparkSession
    folder = (qualified(spark, folder) if folder else new_path(spark, "shards")).rstrip("/")
    path = tokenizer or vocabulary(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        enc, keys, sizes = encoder(path), [], []
        width = 2 if len(enc.ends) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        store, top = _place(folder)
        store.create_dir(top, recursive=True)
        own, name = f"{top}/.{shard:06d}-{uuid.uuid4().hex}", f"{top}/{shard:06d}.vtok"
        with store.open_output_stream(own) as f:
            f.write(MAGIC)
            for b in chain([batch], batches):
                keys.append(np.array(b.column(0).fill_null(NULL_KEY)))
                for ids in enc.payloads(t.as_py() for t in b.column(1)):
                    data = np.frombuffer(ids + END, "<u4").astype(f"<u{width}")
                    f.write(data)
                    sizes.append(len(data))
            k = np.concatenate(keys)
            for part in index_bytes(k, np.array(sizes), width):
                f.write(part)
        store.move(own, name)
        row = [f"{folder}/{shard:06d}.vtok", shard, len(k), sum(sizes), int(k[0]), int(k[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "shard", "n_docs", "n_ids", "first_key", "last_key"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    if not shards:
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // DEAL_BYTES))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = in_batches(dealt, write, "file string, shard long, n_docs long, n_ids long, first_key long, last_key long")
    # as many rows as shards: each stands for tens of MB of ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # rows of a few numbers: dealt anew, so that the manifest isn't a file for each shard
    return written(written(manifest.repartition(1 + shards // ROWS_PER_FILE), "manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document, each looked up by its key's hash where the key has one row."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, f = _open(file)
                with f:
                    keys = shard.numbers(shard.at_keys, "<i8", shard.n)
                    firsts = shard.numbers(shard.at_firsts, "<i8", shard.n + 1)
                    found = shard.find_all(keys)
                    if (found < 0).any() or (keys[found] != keys).any():
                        raise ValueError(f"the index of {file} misses keys of its own")
                    # a key's first row is found by its hash, its other rows stand behind that one
                    first = np.concatenate([[True], keys[1:] != keys[:-1]])
                    at = np.where(first, found, np.arange(shard.n))
                    for part in np.split(at, np.flatnonzero(np.diff(firsts[:-1] // READ_IDS)) + 1) if shard.n else []:
                        low, high = int(firsts[part].min()), int(firsts[part + 1].max())
                        ids = shard.numbers(8 + shard.width * low, f"<u{shard.width}", high - low).astype("<u4")
                        data = [ids[s - low : e - low].tobytes() for s, e in zip(firsts[part].tolist(), firsts[part + 1].tolist(), strict=True)]
                        k = keys[part]
                        columns = [pa.array(k, pa.int64(), mask=k == NULL_KEY), pa.array(firsts[part] + start), pa.array(firsts[part + 1] - firsts[part]), pa.array([zlib.crc32(p) for p in data], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_ids, names=names)

    files = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return in_batches(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, np.ndarray]:
    """The ids of single documents, on the driver: one job finds the shards whose range holds any of the keys, then each key takes a few reads by offset."""
    wanted = F.lit(sorted(set(keys)))
    rows = manifest.where(F.exists(wanted, lambda k: (F.col("first_key") <= k) & (F.col("last_key") >= k))).select("file", "first_key", "last_key").collect() if keys else []
    found: dict[int, np.ndarray] = {}
    for row in sorted(rows, key=lambda r: r["file"]):
        shard, f = _open(row["file"])
        with f:
            for k in keys:
                if k not in found and row["first_key"] <= k <= row["last_key"] and (n := shard.find(k)) >= 0:
                    found[k] = shard.payload(n)
    return found


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
