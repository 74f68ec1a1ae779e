"""Keyed tables: rows dealt to hash buckets of their key, of which a batch rewrites only those that it touches.

The files of a batch lie in a folder of their own, a folder for each bucket in it. Which folder each bucket's rows are
in is a small table (bucket, batch) with a row for each bucket that isn't empty; it is written last, as a version of
its own, so that a reader sees the table before a batch or behind it, never half of it. A batch that dies leaves
files that nothing names; they go with the next one. A bucket is rewritten whole, so no files pile up.

A key that very many rows share, as a target that a third of all items refer to, is dealt to ``spread`` buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.sources.catalogue import _struct
from vitrine.sources.store import KEPT, Store

PLACES = _struct("bucket int, batch string")
BUCKETS = 256
ROWS_PER_BUCKET = 20_000  # at which compact() aims


class Busy(Exception):
    """Another writer holds the table."""


class KeyedTable:
    def __init__(self, store: Store, name: str, schema: T.StructType, key: str = "item_id", identity: tuple[str, ...] | None = None, buckets: int = BUCKETS, spread: int = 1):
        """identity: the columns that tell rows apart, the key by itself if there are no others. spread: over how many buckets a key's rows are dealt, by the identity's last column."""
        self.store, self.name, self.schema, self.key, self.buckets, self.spread = store, name, schema, key, buckets, spread
        self.identity = identity or (key,)

    # ------------------------------------------------ where rows are

    @property
    def _places(self) -> str:
        return f"{self.name}_places"

    def _bucket(self, salt: Column | None = None) -> Column:
        of = [F.col(self.key)] if self.spread == 1 else [F.col(self.key), F.pmod(F.col(self.identity[-1]), F.lit(self.spread)) if salt is None else salt]
        return F.pmod(F.xxhash64(*of), F.lit(self.buckets)).cast("int")

    def places(self) -> dict[int, str]:
        """The folder of each bucket that isn't empty: at most a row for each bucket."""
        return {r["bucket"]: r["batch"] for r in self.store.read(self._places, PLACES).collect()}

    def _data(self, batch: str, bucket: int | None = None) -> str:
        return f"{self.store.folder}/{self.name}_data/{batch}" + ("" if bucket is None else f"/bucket={bucket}")

    def _rows(self, places: dict[int, str]) -> DataFrame:
        spark = self.store.spark
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self._data(batch, b) for b, batch in sorted(places.items())])

    def exists(self) -> bool:
        return self.store.exists(self._places)

    def create(self) -> bool:
        return self.store.create(self._places, PLACES)

    def drop(self) -> bool:
        there = self.store.drop(self._places)
        self.store.drop(f"{self.name}_data")
        return there

    def read(self) -> DataFrame:
        """All rows as the last finished batch left them."""
        return self._rows(self.places())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys: of the keys' buckets only."""
        salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(self.spread)]))
        touched = self._touched(keys.select(self.key).distinct().withColumn("salt", salts).select(self._bucket(F.col("salt")).alias("bucket")))
        return self._rows({b: p for b, p in self.places().items() if b in touched}).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _touched(self, buckets: DataFrame) -> set[int]:
        return {r["bucket"] for r in buckets.distinct().collect()}  # at most the number of buckets

    def stats(self) -> dict[str, int]:
        size = {"rows": self.read().count(), "files": 0, "bytes": 0}
        for bucket, batch in self.places().items():
            top = self.store._hadoop(self._data(batch, bucket))
            found = self.store._fs(top).getContentSummary(top)
            size["files"] += int(found.getFileCount())
            size["bytes"] += int(found.getLength())
        return size

    # ------------------------------------------------ changes

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Put rows in place of those of the same identity, and take out those of gone's; how many buckets that rewrote.

        Doing it again leaves the same table."""
        spark, of = self.store.spark, list(self.identity)
        rows = spark.createDataFrame([], self.schema) if rows is None else rows.select(*self.schema.names)
        gone = rows.select(*of).limit(0) if gone is None else gone.select(*of)
        rows, gone = rows.persist(), gone.persist()
        try:
            places = self.places()
            touched = self._touched(rows.select(self._bucket().alias("bucket")).unionByName(gone.select(self._bucket().alias("bucket"))))
            if not touched:
                return 0
            changed = rows.select(*of).unionByName(gone).distinct()
            stay = self._rows({b: p for b, p in places.items() if b in touched}).join(changed, of, "left_anti")
            written = self._write(stay.unionByName(rows))
            self._publish({b: p for b, p in places.items() if b not in touched} | written)
            return len(touched)
        finally:
            rows.unpersist()
            gone.unpersist()

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Files of a new batch, a few for each bucket; which buckets have any."""
        batch = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(self._data(batch))
        top = self.store._hadoop(self._data(batch))
        names = [s.getPath().getName() for s in self.store._fs(top).listStatus(top) if s.isDirectory()]
        return {int(n.removeprefix("bucket=")): batch for n in names if n.startswith("bucket=")}

    def _publish(self, places: dict[int, str]) -> None:
        before = [self.store.spark.read.schema(PLACES).parquet(f"{self.store.folder}/{self._places}/v{v}") for v in self.store.versions(self._places)[1 - KEPT :]]
        named = {r["batch"] for df in before for r in df.select("batch").distinct().collect()} | set(places.values())
        self.store.write(self._places, self.store.spark.createDataFrame(sorted(places.items()), PLACES).coalesce(1))
        # what no kept version names goes: of batches replaced, and of those that died
        top = self.store._hadoop(f"{self.store.folder}/{self.name}_data")
        fs = self.store._fs(top)
        if fs.exists(top):
            for s in fs.listStatus(top):
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)

    def compact(self, buckets: int | None = None) -> int:
        """Deal all rows to as many buckets as their number asks for; that number."""
        rows = self.read()
        n = buckets or max(1, -(-rows.count() // ROWS_PER_BUCKET))
        self.buckets = n
        self._publish(self._write(rows))
        return n


@contextmanager
def locked(store: Store, name: str, seconds: float, now: float) -> Iterator[None]:
    """The only writer for a while: a file that can be made once. One that is older than so many seconds was left by a writer that died."""
    path = store._path(f"{name}.lock")
    fs = store._fs(path)
    if fs.exists(path):
        held = fs.open(path)
        try:
            since = float(bytes(held.readAllBytes()).decode() or 0)
        finally:
            held.close()
        if now - since < seconds:
            raise Busy(name)
        fs.delete(path, False)
    fs.mkdirs(path.getParent())
    if not fs.createNewFile(path):
        raise Busy(name)
    out = fs.create(path, True)
    out.write(bytearray(str(now).encode()))
    out.close()
    try:
        yield
    finally:
        fs.delete(path, False)
