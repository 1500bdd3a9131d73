"""Moving and running functions over ``Window.partitionBy(...).orderBy(...)``.

Null and NaN are passed over. For tables without a partition key, or with one that holds too much
for a task, see ``operators.moving``.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.compare import as_col, clean


def _back(w: WindowSpec, n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("a window has at least one row")
    return w.rowsBetween(1 - n, 0)


def msum(n: int, x, w: WindowSpec) -> Column:
    """Sum of the last n rows, fewer at the start; 0 where all are null."""
    return F.coalesce(F.sum(clean(x)).over(_back(w, n)), F.lit(0))


def mcount(n: int, x, w: WindowSpec) -> Column:
    return F.count(clean(x)).over(_back(w, n))


def mavg(n: int, x, w: WindowSpec) -> Column:
    return F.avg(clean(x)).over(_back(w, n))


def mmax(n: int, x, w: WindowSpec) -> Column:
    return F.max(clean(x)).over(_back(w, n))


def mmin(n: int, x, w: WindowSpec) -> Column:
    return F.min(clean(x)).over(_back(w, n))


def rsum(x, w: WindowSpec, seed=0) -> Column:
    """Running sum, starting from ``seed``."""
    return F.coalesce(F.sum(clean(x)).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + as_col(seed)


def shift(n: int, x, w: WindowSpec, fill=None) -> Column:
    """The value n rows before (after, for negative n), or ``fill`` beyond the ends."""
    return F.lag(as_col(x), n, fill).over(w) if n >= 0 else F.lead(as_col(x), -n, fill).over(w)


def maxback(x, w: WindowSpec) -> Column:
    """The larger of a value and the one before."""
    return F.greatest(clean(x), F.lag(clean(x), 1).over(w))


def minback(x, w: WindowSpec) -> Column:
    return F.least(clean(x), F.lag(clean(x), 1).over(w))


def mapback(f, x, w: WindowSpec, seed=None) -> Column:
    """``f(value, value before)``; the first value is kept, or combined with ``seed``."""
    x = as_col(x)
    there = F.row_number().over(w) > 1
    return F.when(there, f(x, F.lag(x, 1).over(w))).otherwise(x if seed is None else f(x, as_col(seed)))


def rank(w: WindowSpec) -> Column:
    """0-based rank; ties by the order's last key."""
    return F.row_number().over(w) - 1


def crossings(a: Column, b: Column, w: WindowSpec) -> Column:
    """Sign of the change where two series cross (1 up, -1 down, else 0)."""
    now = F.signum(a - b)
    before = F.lag(now, 1).over(w)
    return F.when((now != before) & (now != 0) & before.isNotNull(), now).otherwise(0).cast("int")
