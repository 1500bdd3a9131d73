"""Readings: valid rows, one per source and stamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def wall_us(stamp: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC stamp (the session's zone must be UTC)."""
    return F.unix_micros(stamp.cast("timestamp"))


def valid_readings(df: DataFrame, key: str = "enumstring", stamp: str = "datetime") -> DataFrame:
    """Rows with a source and a stamp. 1970-01-01T00:00:00 is the null stamp and left out too."""
    us = wall_us(F.col(stamp))
    return df.filter(F.col(key).isNotNull() & F.col(stamp).isNotNull() & (us != 0))


def distinct_readings(df: DataFrame, values: Sequence[str], key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """One row ``(key, t_us, *values)`` per source and stamp; of rows sent again the one with the
    smallest ``order`` counts. NaN becomes null. Copies collapse map-side, before the shuffle, so
    that neither a hot source nor a hot stamp loads one task."""
    first = F.coalesce(F.col(order), F.lit(2**63 - 1))
    valid = valid_readings(df, key, stamp).select(
        F.col(key).alias("k"), wall_us(F.col(stamp)).alias("t"), first.alias("o"),
        *[denan(df, v).alias(f"v{i}") for i, v in enumerate(values)])
    got = valid.groupBy("k", "t").agg(*[F.min_by(f"v{i}", "o").alias(f"v{i}") for i in range(len(values))] or [F.min("o").alias("o")])
    return got.select(F.col("k").alias(key), F.col("t").alias("t_us"), *[F.col(f"v{i}").alias(v) for i, v in enumerate(values)])


def denan(df: DataFrame, name: str) -> Column:
    """Column ``name`` with NaN as null."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if df.schema[name].dataType.typeName() in ("double", "float") else c
