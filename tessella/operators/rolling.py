"""Totals over trailing periods by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.readings import DAY_US, distinct_readings


def daily_totals(df: DataFrame, value: str, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """``(key, day, total, n)`` for each source and UTC day with a reading; ``day`` counts from 1970.
    ``n`` counts non-null values; a day of nulls only has total 0. A total beyond BIGINT is null."""
    r = distinct_readings(df, [value], key, stamp, order)
    day = F.expr(f"(t_us - pmod(t_us, {DAY_US})) div {DAY_US}")
    return r.groupBy(key, day.alias("day")).agg(
        F.coalesce(F.try_sum(value), F.when(F.count(value) == 0, F.lit(0))).alias("total"), F.count(value).alias("n"))


def every_day(totals: DataFrame, key: str = "enumstring") -> DataFrame:
    """``totals`` with a row for each day from a source's first to its last; new days have total 0.
    One row per source and day enters the window, so a source's window is bounded by the calendar."""
    w = W.partitionBy(key).orderBy("day")
    nxt = F.coalesce(F.lead("day").over(w), F.col("day") + 1)
    days = totals.withColumn("until", nxt).withColumn("first_day", F.first("day").over(w))
    return days.select(key, "first_day", F.explode(F.sequence(F.col("day"), F.col("until") - 1)).alias("d"), "day", "total", "n").select(
        key, "first_day", F.col("d").alias("day"),
        F.when(F.col("d") == F.col("day"), F.col("total")).otherwise(F.lit(0)).alias("total"),
        F.when(F.col("d") == F.col("day"), F.col("n")).otherwise(F.lit(0)).alias("n"))


def trailing_totals(df: DataFrame, value: str = "volume", periods: Sequence[int] = (7, 30), key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """For each source and day, days without a reading included: ``total_P`` and ``avg_P`` (per
    non-null reading; null where there was none) over the P days ending that day.

    Sums of 1, 2, 4, 8, ... days are formed by adding a block to the same block shifted by its
    length; a period is the sum of the blocks of its binary digits, each shifted by the days
    already covered. Every step is a ``lag`` over one and the same partitioning and order, so the
    whole ladder costs one shuffle. Days before a source's first count as 0. A sum beyond BIGINT is
    null. Empty input gives no rows; null sources and stamps are left out."""
    if not periods or min(periods) < 1:
        raise ValueError("periods must be positive numbers of days")
    w = W.partitionBy(key).orderBy("day")
    grid = every_day(daily_totals(df, value, key, stamp, order), key)
    # a null total stands for an overflow, so a missing earlier day needs its own default
    back = lambda c, n: F.lag(c, n, 0).over(w) if n else F.col(c)
    cols = {"total": "total", "n": "n"}
    grid = grid.withColumns({f"{c}_b1": F.col(c).cast("bigint") for c in cols})
    size = 1
    while size * 2 <= max(periods):
        grid = grid.withColumns({f"{c}_b{size * 2}": F.try_add(F.col(f"{c}_b{size}"), back(f"{c}_b{size}", size)) for c in cols})
        size *= 2
    out = []
    for p in periods:
        sums = {}
        for c in cols:
            acc, covered, block = None, 0, size
            while block:
                if p & block:
                    part = back(f"{c}_b{block}", covered)
                    acc, covered = part if acc is None else F.try_add(acc, part), covered + block
                block //= 2
            sums[c] = acc
        out += [sums["total"].alias(f"total_{p}"), F.when(sums["n"] > 0, sums["total"] / sums["n"]).alias(f"avg_{p}")]
    return grid.select(key, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), (F.col("day") - F.col("first_day") + 1).alias("day_no"), F.col("total").alias("total_1"), *out)
