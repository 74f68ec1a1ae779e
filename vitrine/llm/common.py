"""What the operators share: the words of a text, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white space characters; bytes.split() splits alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """The words of a text, in order; none where it is null or blank."""
    c = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WHITE))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, GAP))


def unused_prefix(columns: list[str], like: str = "__vt") -> str:
    """A prefix for columns of our own that no column of the input begins with, in any case."""
    low, n = [c.lower() for c in columns], 0
    while any(c.startswith(f"{like}{n or ''}_") for c in low):
        n += 1
    return f"{like}{n or ''}_"


BATCH_BYTES = "4m"  # of rows that go to a Python worker at a time
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, by batches bounded in bytes (unless the session sets a bound of its own): a batch of long texts is no larger than one of short texts."""
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, that of the cluster's default file system where it has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset: on a cluster an error; in local mode, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vitrine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with its file system's scheme; deleted when the application ends."""
    path = f"{shared_dir(spark)}/vitrine-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    return fs.makeQualified(p).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

