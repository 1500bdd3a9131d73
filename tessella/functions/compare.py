"""Comparison and boolean expressions.

Null equals null and is the smallest value; NaN counts as null. Strings compare by upper case first,
then by length, then as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """A column: given one, or of that name; other values become literals."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clean(x) -> Column:
    """A numeric column with NaN as null."""
    return F.nullif(as_col(x), F.lit(float("nan")))


def text_key(s) -> Column:
    """Sort and comparison key of a string; null stays null."""
    s = as_col(s)
    return F.when(s.isNotNull(), F.struct(F.upper(s).alias("u"), F.length(s).alias("n"), s.alias("s")))


def equals(a, b) -> Column:
    return as_col(a).eqNullSafe(as_col(b))


def noteq(a, b) -> Column:
    return ~equals(a, b)


def less(a, b, text: bool = False) -> Column:
    """``a < b`` with null below everything but null."""
    a, b = (text_key(a), text_key(b)) if text else (as_col(a), as_col(b))
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def lesseq(a, b, text: bool = False) -> Column:
    return ~less(b, a, text)


def greater(a, b, text: bool = False) -> Column:
    return less(b, a, text)


def greatereq(a, b, text: bool = False) -> Column:
    return ~less(a, b, text)


def between(x, low, high) -> Column:
    """Inclusive; nothing lies between reversed bounds. Null is between only if ``low`` is null."""
    return lesseq(low, x) & lesseq(x, high)


def in_(x, values) -> Column:
    """Membership in a list of literals, in which null may stand, or in an array column."""
    x = as_col(x)
    if isinstance(values, (list, tuple, set)):
        some = [v for v in values if v is not None]
        hit = F.coalesce(x.isin(some), F.lit(False)) if some else F.lit(False)
        return hit | x.isNull() if len(some) < len(values) else hit
    arr = as_col(values)
    return F.when(x.isNull(), F.exists(arr, lambda e: e.isNull())).otherwise(F.coalesce(F.array_contains(arr, x), F.lit(False)))


def match(a, b) -> Column:
    """Whether two whole values (arrays, structs) are equal."""
    return as_col(a).eqNullSafe(as_col(b))


def not_(x) -> Column:
    """1 for 0 and false, else 0; null and NaN give 0."""
    return F.coalesce(as_col(x).cast("double") == 0, F.lit(False)).cast("int")


def and_(a, b) -> Column:
    """The smaller of two values, on booleans the logical and."""
    return F.least(as_col(a), as_col(b))


def or_(a, b) -> Column:
    """The larger of two values, on booleans the logical or."""
    return F.greatest(as_col(a), as_col(b))


mins, maxes = and_, or_


def xor(a, b) -> Column:
    """Bytewise exclusive or of two ASCII strings; the shorter one cycles. An empty or null one gives null."""
    a, b = as_col(a), as_col(b)
    n = F.greatest(F.length(a), F.length(b))
    code = lambda s, i: F.ascii(F.substring(s, F.pmod(i, F.length(s)) + 1, F.lit(1)))
    mixed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(code(a, i).bitwiseXOR(code(b, i))))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.array_join(mixed, ""))


def which(mask) -> Column:
    """Positions of an integer array, each repeated by its value: true positions of a 0/1 mask."""
    return F.flatten(F.transform(as_col(mask), lambda x, i: F.array_repeat(i, F.coalesce(x.cast("int"), F.lit(0)))))


def filter_(arr, f) -> Column:
    """Elements for which ``f`` holds."""
    return F.filter(as_col(arr), f)
