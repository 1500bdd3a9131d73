"""Moving and running sums over whole tables or very large groups.

The window functions put a group in one task. Here rows are range-partitioned by key and order, so
that a group of any size, or a table without key, is spread; what crosses from range to range is
the last ``n - 1`` values (moving) or one sum (running) per range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import windows as N
from tessella.functions.compare import clean
from tessella.operators.ranges import stored_ranges
from tessella.session import durable

FUNCTIONS = {"msum": N.msum, "mcount": N.mcount, "mavg": N.mavg, "mmax": N.mmax, "mmin": N.mmin}


def windowed(df: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int = 0) -> DataFrame:
    """``df`` with columns made by window functions over rows of equal ``keys`` (null equals null) in the order
    ``by``, each a function of the ordered window, that look at most ``before`` rows back and ``after``
    ahead. Each range is handed copies of so many rows around it. Jobs run when this is called."""
    s = stored_ranges(df, [*keys, *by]).withColumn("_own", F.lit(True))
    sizes = s.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = durable(sizes.withColumn("_start", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")))
    placed = s.join(starts.select("_part", "_start"), "_part").withColumn("_row", F.col("_start") + F.col("_at")).drop("_start", "_at")
    # which ranges each one lends rows to, and which rows: among those that begin, or end, near enough
    far = (starts.agg(F.max("_n")).first()[0] or 0) + before + after
    near = F.collect_list(F.struct("_part", "_start", "_n")).over(W.orderBy("_start").rangeBetween(-far, far))
    pairs = starts.withColumn("_near", near).select(F.col("_part").alias("_from"), F.col("_start").alias("_a"), (F.col("_start") + F.col("_n")).alias("_e"), F.explode("_near").alias("_to")).filter("_from != _to._part")
    least, end = F.col("_to._start") - before, F.col("_to._start") + F.col("_to._n") + after
    loans = pairs.filter((F.col("_e") > least) & (F.col("_a") < end)).select(F.col("_from").alias("_part"), F.col("_to._part").alias("_for"), least.alias("_least"), end.alias("_end"))
    lent = placed.join(durable(loans), "_part").filter("_row >= _least and _row < _end")
    lent = lent.withColumn("_part", F.col("_for")).withColumn("_own", F.lit(False)).drop("_for", "_least", "_end")
    w = W.partitionBy("_part", *keys).orderBy("_row")
    return placed.unionByName(lent).withColumns({n: f(w) for n, f in columns.items()}).filter("_own").drop("_own", "_part", "_row")


def moving(df: DataFrame, kind: str, n: int, value: str, by: Sequence[str], keys: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``df`` with a moving function (``msum mcount mavg mmax mmin``) of the last ``n`` rows of equal
    ``keys`` (null equals null) in the order ``by``. Null and NaN are passed over, sums of nothing are
    0, other results null."""
    return windowed(df, by, keys, {name or kind: lambda w: FUNCTIONS[kind](n, value, w)}, n - 1)


def running_sum(df: DataFrame, value: str, by: Sequence[str], keys: Sequence[str] = (), name: str = "rsum") -> DataFrame:
    """``df`` with the running sum of ``value`` among rows of equal ``keys`` in the order ``by``. Jobs run when
    this is called."""
    s = stored_ranges(df.withColumn("_x", F.coalesce(clean(value), F.lit(0))), [*keys, *by])
    k = F.struct(F.lit(0).alias("_"), *keys)
    parts = s.withColumn("_k", k).groupBy("_part", "_k").agg(F.sum("_x").alias("_sum"), F.min("_at").alias("_a"))
    # only a range's first key continues from before; its earlier parts are summed
    heads = parts.withColumn("_before", F.sum("_sum").over(W.partitionBy("_k").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).filter("_a = 0 and _before is not null").select("_part", F.col("_k").alias("_first"), "_before")
    inside = F.sum("_x").over(W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    out = s.withColumn(name, inside).join(durable(heads), "_part", "left")
    mine = F.when(k.eqNullSafe(F.col("_first")), F.col("_before"))
    return out.withColumn(name, F.col(name) + F.coalesce(mine, F.lit(0))).drop("_x", "_part", "_at", "_first", "_before")
