"""Session settings and durable storage."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster, use its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is set, a temporary one on a local
    master (tests), and an error elsewhere: other machines wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for one table, deleted at the session's end, or at the end of the
    surrounding ``temporary``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessella-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators store within are deleted at the end; what is to be kept of a result that
    reads them has to be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in _OPEN.pop():
            hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(path), True)


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a table in the shared folder, which is deleted at the
    session's end. What follows reads the table, so neither a second use nor a lost executor
    computes ``df`` again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_parts(df: DataFrame, rows_per_part: int = 1_000_000) -> int:
    """Partitions for an ordered pass over ``df``: ``spark.sql.shuffle.partitions``, or more where a
    partition would exceed ``rows_per_part`` rows. Counting reads no columns."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / rows_per_part))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that costs far more than moving its rows: where its files give fewer partitions
    than the cluster has cores, its rows are dealt out evenly; otherwise it stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df
