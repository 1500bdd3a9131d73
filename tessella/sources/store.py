"""Stored tables: columnar, by day, and other objects."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A columnar table; sorting within files lets readers skip row groups by their bounds."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; with ``date=`` folders, a table by day with the column ``date``."""
    return spark.read.option("basePath", path).parquet(path)


def write_by_day(df: DataFrame, path: str, stamp: str, sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A table by day: one folder for each UTC day. Rows are brought together by day and spread over a
    few tasks within it, so that a busy day isn't one task's work."""
    day = df.withColumn("date", F.to_date(stamp))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = day.repartitionByRange(parts, "date", stamp)
    (out.sortWithinPartitions("date", *(sort_by or [stamp]))).write.mode(mode).partitionBy("date").parquet(path)


def select_by_day(spark: SparkSession, path: str, where: Column | None, aggregate: Callable[[DataFrame, Sequence[str]], DataFrame], per_day: bool = False) -> DataFrame:
    """An aggregate over a table by day. A condition on ``date`` prunes folders. ``aggregate`` gets the
    rows and the keys to group by; with ``per_day`` these hold ``date``, so that results are per day,
    as an engine that runs day by day would give."""
    df = read_table(spark, path)
    df = df.filter(where) if where is not None else df
    return aggregate(df, ["date"] if per_day else []).drop("date")


def replace(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df``, which may be computed from the table at ``path``, in its place: aside first, then
    swapped. The old table is deleted only once the new one stands in its place; if that fails, it is
    put back."""
    spark = df.sparkSession
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(hadoop(path))
    if there and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"can't move {path}; the new table is in {aside}")
    try:
        moved = fs.rename(hadoop(aside), hadoop(path))
    except Exception:
        moved = False
    if not moved:
        if there and not fs.rename(hadoop(old), hadoop(path)):
            raise OSError(f"can't put {old} back to {path}")
        raise OSError(f"can't move {aside} to {path}")
    fs.delete(hadoop(old), True)
    return spark.read.parquet(path)


def write_value(value, path: str) -> int:
    """A plain value as JSON in one local file; returns the bytes written."""
    return write_text(json.dumps(value), path)


def read_value(path: str):
    with open(path) as f:
        return json.load(f)


def write_text(text: str, path: str) -> int:
    data = text.encode()
    with open(path, "wb") as f:
        return f.write(data)


def lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A text file's lines, or the first ``most``."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df if most is None else df.limit(most)


def dir_ls(path: str, full: bool = False) -> list[str]:
    return [os.path.join(path, n) if full else n for n in sorted(os.listdir(path))]


def mkdir(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def run_script(spark: SparkSession, path: str) -> DataFrame | None:
    """Runs a file of SQL statements separated by ``;`` at line ends; the last result."""
    out = None
    with open(path) as f:
        for statement in f.read().split(";\n"):
            if statement.strip().rstrip(";"):
                out = spark.sql(statement.strip().rstrip(";"))
    return out
