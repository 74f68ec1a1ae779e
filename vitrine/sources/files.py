"""Vocabulary files and logs: text lists, delimited files with a sniffed delimiter, encodings, JSON."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import scrub_map

#: Fixed value: the size up to which a list is read where a caller wants that limit.
MAX_BYTES = 2 << 20


def decode(data: bytes) -> str:
    """UTF-8 if it is, else windows-1252."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def read_list(spark: SparkSession, path: str, cut: int | None = None) -> DataFrame:
    """Lines of a text file, with their numbers; line ends made alike, a byte-order mark dropped. cut: only the first so many bytes of each file."""
    files = spark.read.format("binaryFile").load(path)
    content = F.substring(F.col("content"), 1, cut) if cut else F.col("content")
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "windows-1252"))
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(plain, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def sniff(first_line: str) -> str:
    """The most frequent of ; , and tab; ties keep the earlier one."""
    return max(";,\t", key=first_line.count)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """path, line (of the row's first line) and cells of each row of quoted files, trimmed, empty ones dropped; rows of any width, each file by its own delimiter and encoding.

    A file is one row of the source: these are lists that people write, and quoted cells may hold line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = decode(data.as_py()).removeprefix("\ufeff")
                reader = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text.split("\n", 1)[0]))
                rows, at = [], 1
                for row in reader:
                    if cells := [x for x in (cell.strip() for cell in row) if x]:
                        rows.append((at, cells))
                    at = reader.line_num + 1
                for k in range(0, len(rows), 10_000):
                    some = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([n for n, _ in some], pa.int32()), pa.array([x for _, x in some], pa.list_(pa.string()))], names=["path", "line", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line int, cells array<string>")


def cells_to_lines(cells: DataFrame, kind: str) -> DataFrame:
    """Lines of a vocabulary list: corrections as ``a => b, c``, stop words one each, others ``a, b``."""
    if kind == "stopwords":
        return cells.select(F.explode("cells").alias("text"))
    if kind == "corrections":
        many = F.concat(F.get("cells", F.lit(0)), F.lit(" => "), F.array_join(F.slice("cells", 2, F.size("cells")), ", "))
        return cells.select(F.when(F.size("cells") > 1, many).otherwise(F.get("cells", F.lit(0))).alias("text"))
    return cells.select(F.array_join("cells", ", ").alias("text"))


def log_rows(rows: DataFrame) -> DataFrame:
    """Log rows as they are kept: no tags in the message, no secrets in the context (a JSON object)."""
    context = F.to_json(scrub_map(F.from_json("context", "map<string,string>")))
    return rows.withColumns({"message": F.regexp_replace("message", "<[^>]*>", ""), "context": context})


def log_page(logs: DataFrame, level: str | None = None, channel: str | None = None, since=None, per_page: int = 50, page: int = 1) -> DataFrame:
    """Newest first; a page has 1 to 500 rows."""
    for c, v in (("level", level), ("channel", channel)):
        if v:
            logs = logs.where(F.col(c) == v)
    if since is not None:
        logs = logs.where(F.col("created_at") >= F.lit(since))
    size = min(500, max(1, per_page))
    return logs.orderBy(F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def retained(logs: DataFrame, now, days: int) -> DataFrame:
    """Rows not older than so many days, at least one."""
    return logs.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max(1, days))))


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
