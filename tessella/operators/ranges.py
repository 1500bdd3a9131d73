"""Whole-table order without a single task: rows numbered and values carried across ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ordered import range_ordered
from tessella.session import durable, range_parts


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counts are taken map-side."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def stored_ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` sorted by ``by`` (ascending, nulls first), stored, with the columns ``_part`` (number of
    the range) and ``_at`` (place within). ``by`` should be a total order, else ties are in any order."""
    n = range_parts(df)
    at = F.monotonically_increasing_id()
    return durable(range_ordered(df, list(by), n).withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))


def with_rank(df: DataFrame, by: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based row number in the order of ``by``. Only the ranges' sizes, one row for
    each, are summed in a single task; they are stored, so that Spark joins them by their size. Jobs
    run when this is called."""
    s = stored_ranges(df, by)
    sizes = s.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return s.join(durable(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def bucketed(df: DataFrame, n: int, by: Sequence[str], name: str = "bucket") -> DataFrame:
    """``floor(rank * n / rows)``: the quantile bucket, 0 to n - 1, of each row."""
    rows = max(df.count(), 1)
    return with_rank(df, by, "_rank").withColumn(name, F.floor(F.col("_rank") * n / rows)).drop("_rank")


def carry_last(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row among rows of equal ``keys`` (null
    equals null), in the order of ``by``. Groups of any size are spread over ranges of ``by``; from
    range to range only one value per range travels. Jobs run when this is called."""
    s = stored_ranges(df.withColumn("_v", value), [*keys, *by])
    inside = W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    k = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keys])
    # per range its first key and its last key with the last value seen under it
    ends = s.groupBy("_part").agg(F.min_by(k, "_at").alias("_first"), F.max_by(k, "_at").alias("_last"))
    ends = durable(ends)
    tails = s.join(ends.select("_part", "_last"), "_part").filter(k.eqNullSafe(F.col("_last")) & F.col("_v").isNotNull()).groupBy("_part").agg(F.max_by("_v", "_at").alias("_tail"))
    seen = ends.join(tails, "_part", "left")
    # the value handed on: the nearest earlier range's tail that has one, if no other key lies between
    w = W.orderBy("_part")
    over = w.rowsBetween(W.unboundedPreceding, -1)
    handed = seen.withColumn("_from", F.last(F.when(F.col("_tail").isNotNull(), F.struct("_last", "_tail")), ignorenulls=True).over(over))
    handed = handed.select("_part", F.col("_first"), F.when(F.col("_from._last").eqNullSafe(F.col("_first")), F.col("_from._tail")).alias("_handed"))
    out = s.join(durable(handed), "_part")
    own = F.last("_v", ignorenulls=True).over(inside)
    return out.withColumn(name, F.coalesce(own, F.when(k.eqNullSafe(F.col("_first")), F.col("_handed")))).drop("_v", "_part", "_at", "_first", "_handed")
