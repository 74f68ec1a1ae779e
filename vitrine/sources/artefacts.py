"""Index artefacts: tables that are made once from others and read by many queries, as a search index is.

They are kept in the folder that driver and executors share (spark.checkpoint.dir) for as long as the application
runs, one for each name and state of its sources: when files of a source are added, removed or rewritten, the next
reader makes the table anew. A table is written beside its place and moved there whole; of a name, the last two
states are kept, so that a query that has begun on the one before can end.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_making = threading.Lock()
_tables: dict[str, DataFrame] = {}
KEPT_STATES = 2


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, an error on a cluster, and in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="vitrine-"))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, path: str) -> str:
    """What tells a table's present files from others: their paths, lengths and times. One listing a folder, no file is read."""
    found, open_ = [], [path]
    while open_:
        p, fs = _path(spark, open_.pop())
        for s in fs.listStatus(p):
            where = s.getPath().toString()
            if s.isDirectory():
                open_.append(where)
            else:
                found.append((where, s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:16]


def kept(name: str, sources: list[str], spark: SparkSession, make: Callable[[], DataFrame], folders: tuple[str, ...] = ()) -> DataFrame:
    """The table of this name that was made from the present files of its sources (paths of tables), made now if it isn't there. folders: columns that have a folder for each value."""
    place = hashlib.sha256(repr(sources).encode()).hexdigest()[:16]
    folder = f"{shared_dir(spark)}/vitrine-index-{spark.sparkContext.applicationId}/{name}-{place}"  # of this application: its tables are forgotten with it
    version = hashlib.sha256("".join(state(spark, s) for s in sources).encode()).hexdigest()[:16]
    top, fs = _path(spark, folder)
    done, _ = _path(spark, f"{folder}/{version}")
    if not fs.exists(done):
        fs.mkdirs(top)
        fs.deleteOnExit(top.getParent())
        own = f"{folder}/.{version}-{uuid.uuid4().hex[:8]}"
        make().write.partitionBy(*folders).parquet(own)
        with _making:
            if fs.exists(done):  # another thread was faster
                fs.delete(_path(spark, own)[0], True)
            else:
                fs.rename(_path(spark, own)[0], done)
                states = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(top) if not s.getPath().getName().startswith("."))
                for _, old in states[:-KEPT_STATES]:
                    fs.delete(_path(spark, old)[0], True)
    # a version never changes, so its files need be listed once only
    if done.toString() not in _tables:
        _tables[done.toString()] = spark.read.parquet(f"{folder}/{version}")
    return _tables[done.toString()]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, which goes when the application ends: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vitrine-steps-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = _path(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
