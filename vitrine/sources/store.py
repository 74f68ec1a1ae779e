"""Versioned tables in a folder: each write is a new version, readers take the newest that was finished.

A write that dies leaves no marker and is never read; a reader keeps its version while a newer one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.sources.catalogue import delete, upsert

KEPT = 3  # versions
MOST_FILES, FILE_BYTES = 200, 64 << 20


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self._hadoop("/".join([self.folder, *parts]))

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Finished versions, ascending."""
        top = self._path(name)
        fs = self._fs(top)
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(self._path(name, p.getName(), "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The newest version; an empty table of the schema where there is none."""
        versions = self.versions(name)
        if not versions:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        df = self.spark.read
        return (df.schema(schema) if schema else df).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        versions = self.versions(name)
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{(versions[-1] if versions else 0) + 1}")
        for old in versions[: 1 - KEPT]:
            self._fs(self._path(name)).delete(self._path(name, f"v{old}"), True)

    def drop(self, name: str) -> bool:
        """Whether there was one; dropping none is no error."""
        there, top = self.exists(name), self._path(name)
        self._fs(top).delete(top, True)
        return there

    def create(self, name: str, schema: T.StructType) -> bool:
        """An empty table, unless there is one."""
        if self.exists(name):
            return False
        self.write(name, self.spark.createDataFrame([], schema))
        return True

    def recreate(self, name: str, schema: T.StructType) -> None:
        self.drop(name)
        self.create(name, schema)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add files to the newest version; when it has very many small ones, it is written anew as few."""
        versions = self.versions(name)
        if not versions:
            self.write(name, rows)
            return
        rows.select(*self.read(name).columns).write.mode("append").parquet(f"{self.folder}/{name}/v{versions[-1]}")
        top = self._path(name, f"v{versions[-1]}")
        size = self._fs(top).getContentSummary(top)
        if size.getFileCount() > MOST_FILES and size.getLength() < MOST_FILES * FILE_BYTES:
            self.write(name, self.read(name).coalesce(1 + size.getLength() // FILE_BYTES))

    def bulk(self, name: str, rows: DataFrame, key: str = "item_id", check=None) -> DataFrame:
        """Upsert the rows that a check (a Column: null or the reason) lets pass; the others with their reason."""
        reason = F.lit(None).cast("string") if check is None else check
        judged = rows.withColumn("reason", reason).persist()
        good = judged.where("reason IS NULL").drop("reason")
        if good.take(1):  # nothing to write: no new version
            self.write(name, upsert(self.read(name, rows.schema), good, key))
        # a table of its own: as many rows as were refused, and it stays as it is when the input changes
        self.write(f"{name}_refused", judged.where("reason IS NOT NULL").select(F.col(key).cast("bigint"), "reason"))
        judged.unpersist()
        return self.read(f"{name}_refused")

    def remove(self, name: str, keys: DataFrame, key: str = "item_id") -> None:
        self.write(name, delete(self.read(name), keys, key))

    def stats(self, name: str) -> dict[str, int]:
        """Rows, files and bytes of the newest version."""
        versions = self.versions(name)
        if not versions:
            return {"rows": 0, "files": 0, "bytes": 0}
        top = self._path(name, f"v{versions[-1]}")
        size = self._fs(top).getContentSummary(top)
        return {"rows": self.read(name).count(), "files": int(size.getFileCount()), "bytes": int(size.getLength())}
