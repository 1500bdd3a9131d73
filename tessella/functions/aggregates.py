"""Aggregates that skip null and NaN.

An empty ``sum`` is 0; ``count`` counts all rows; empty minima, maxima and averages are null. First
and last need an order, as rows have none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compare import as_col, clean, text_key


def count() -> Column:
    return F.count(F.lit(1))


def sum_(x) -> Column:
    return F.coalesce(F.sum(clean(x)), F.lit(0))


def avg(x) -> Column:
    return F.avg(clean(x))


def min_(x, text: bool = False) -> Column:
    return F.min(text_key(x))["s"] if text else F.min(clean(x))


def max_(x, text: bool = False) -> Column:
    return F.max(text_key(x))["s"] if text else F.max(clean(x))


def std(x) -> Column:
    """Population standard deviation."""
    return F.stddev_pop(clean(x))


def var(x) -> Column:
    """Population variance."""
    return F.var_pop(clean(x))


def median(x) -> Column:
    """Exact; holds a group's distinct values in one task. For groups without bound use digests."""
    return F.median(clean(x))


def first(x, order) -> Column:
    """The value in the row of smallest ``order``, null or not."""
    return F.min_by(as_col(x), as_col(order))


def last(x, order) -> Column:
    return F.max_by(as_col(x), as_col(order))


def count_null(x) -> Column:
    return F.count_if(clean(x).isNull())


def count_nonnull(x) -> Column:
    return F.count(clean(x))


def values(x, order) -> Column:
    """The group's values in order, as an array (bounded groups only)."""
    return F.transform(F.sort_array(F.collect_list(F.struct(as_col(order).alias("o"), as_col(x).alias("x")))), lambda e: e["x"])


def vwap(price, size) -> Column:
    """Average of ``price`` weighted by ``size``; null where the sizes sum to 0."""
    p, s = clean(price), clean(size)
    return F.try_divide(F.sum(p * s), F.sum(F.when(p.isNotNull(), s)))
