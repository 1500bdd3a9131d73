"""List functions on array columns."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compare import as_col, text_key


def take(n: int, arr) -> Column:
    """The first n elements, from the end for negative n, cycling beyond the length; an empty array gives an empty one."""
    a = as_col(arr)
    if n == 0:
        return F.slice(a, 1, 0)
    index = F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.sequence(F.lit(n), F.lit(-1))
    return F.when(F.size(a) > 0, F.transform(index, lambda i: F.get(a, F.pmod(i, F.size(a))))).when(a.isNotNull(), F.slice(a, 1, 0))


def drop(n: int, arr) -> Column:
    """Without the first n elements (the last, for negative n)."""
    a = as_col(arr)
    left = F.greatest(F.size(a) - abs(n), F.lit(0))
    return F.slice(a, F.lit(n + 1) if n >= 0 else F.lit(1), left)


def car(arr) -> Column:
    return F.get(as_col(arr), F.lit(0))


def cdr(arr) -> Column:
    return drop(1, arr)


def last_of(arr) -> Column:
    return F.try_element_at(as_col(arr), F.lit(-1))


def reverse(arr) -> Column:
    return F.reverse(as_col(arr))


def sort(arr) -> Column:
    """Ascending, nulls first."""
    return F.sort_array(as_col(arr))


def sort_text(arr) -> Column:
    return F.transform(F.sort_array(F.transform(as_col(arr), text_key)), lambda e: e["s"])


def _graded(arr, down: bool) -> Column:
    a = as_col(arr)
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i if down else i).alias("i")))
    return F.transform(F.sort_array(pairs, not down), lambda e: F.abs(e["i"]))


def ascend(arr) -> Column:
    """Positions that sort the array; ties keep their order."""
    return _graded(arr, False)


def descend(arr) -> Column:
    return _graded(arr, True)


def order(arr) -> Column:
    """0-based rank of each element; ties by position."""
    up = ascend(arr)
    return ascend(up)


def distinct(arr) -> Column:
    """Unique elements in first-seen order."""
    return F.array_distinct(as_col(arr))


unique = distinct


def part(arr) -> Column:
    """Map of each value to the positions where it stands."""
    a = as_col(arr)
    keys = F.array_distinct(F.filter(a, lambda x: x.isNotNull()))
    at = lambda v: F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"] == v), lambda e: e["i"])
    return F.map_from_arrays(keys, F.transform(keys, at))


def union(a, b) -> Column:
    return F.array_union(as_col(a), as_col(b))


def intersect(a, b) -> Column:
    return F.array_intersect(as_col(a), as_col(b))


def except_(a, b) -> Column:
    """Elements of ``a`` not in ``b``, duplicates kept."""
    b = as_col(b)
    return F.filter(as_col(a), lambda x: ~F.exists(b, lambda y: y.eqNullSafe(x)))


setminus = except_


def join(a, b) -> Column:
    return F.concat(as_col(a), as_col(b))


def cross(a, b) -> Column:
    """All pairs of two lists within a cell."""
    b = as_col(b)
    return F.flatten(F.transform(as_col(a), lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))


def range_(start, stop=None, step=None) -> Column:
    """Python's range; steps may be fractions. Empty where nothing fits."""
    if stop is None:
        start, stop = 0, start
    a, b, s = as_col(start), as_col(stop), as_col(1 if step is None else step)
    n = F.ceil((b - a) / s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: a + i * s)).otherwise(F.array().cast("array<bigint>") if step is None or isinstance(step, int) else F.array().cast("array<double>"))


def enumerate_(n) -> Column:
    return range_(n)


def repeat(n, x) -> Column:
    return F.array_repeat(as_col(x), as_col(n).cast("int"))


def enlist(x) -> Column:
    return F.array(as_col(x))


def flatten(arr) -> Column:
    return F.flatten(as_col(arr))


def transpose(arr) -> Column:
    """Rows and columns of an array of arrays swapped; the shortest row gives the height."""
    a = as_col(arr)
    height = F.array_min(F.transform(a, F.size))
    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.transform(a, lambda r: F.get(r, i)))).otherwise(F.slice(a, 1, 0))


def split_at(cuts, arr) -> Column:
    """The list cut before each of the given positions."""
    a, c = as_col(arr), as_col(cuts)
    ends = F.concat(c, F.array(F.size(a)))
    return F.transform(F.concat(F.array(F.lit(0)), c), lambda s, i: F.slice(a, s + 1, F.greatest(F.get(ends, i) - s, F.lit(0))))


def ngram(n: int, arr) -> Column:
    """Chunks of n elements; the last may be shorter."""
    a = as_col(arr)
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda i: F.slice(a, i * n + 1, n))).when(a.isNotNull(), F.slice(F.array(a), 1, 0))


def search(x, arr) -> Column:
    """0-based position of the first equal element; null if there is none."""
    return F.nullif(F.array_position(as_col(arr), as_col(x)), F.lit(0)) - 1


def has_index(arr, i) -> Column:
    return (as_col(i) >= 0) & (as_col(i) < F.size(as_col(arr)))


def explode_on(x, arr) -> Column:
    """The list cut at each element equal to ``x``, which is removed."""
    a, x = as_col(arr), as_col(x)
    start = F.struct(F.slice(F.array(a), 1, 0).alias("done"), F.slice(a, 1, 0).alias("now"))
    step = lambda s, e: F.when(e.eqNullSafe(x), F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.slice(a, 1, 0).alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(e)).alias("now")))
    return F.aggregate(a, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def implode_with(x, arr) -> Column:
    """Lists joined with an element between."""
    a = as_col(arr)
    return F.flatten(F.transform(a, lambda e, i: F.when(i == 0, e).otherwise(F.concat(F.array(as_col(x)), e))))


# combinatorics: pairs and triples are expressions; results that grow beyond that are made in Arrow batches,
# for lists whose result has at most MOST_RESULTS lists

MOST_RESULTS = 1_000_000


def _python(kind: str, f, size):
    def run(a):
        if a is None:
            return None
        if size(len(a)) > MOST_RESULTS:
            raise ValueError(f"more than {MOST_RESULTS} lists from {len(a)} elements")
        return f(a)

    return F.udf(run, kind, useArrow=True)


def _once(lists, repeats: bool) -> list:
    return [list(c) for c in (lists if repeats else dict.fromkeys(lists))]


def powerset(arr, kind: str = "bigint") -> Column:
    """All sublists, shortest first."""
    return _python(f"array<array<{kind}>>", lambda a: [list(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n)], lambda n: 2**n)(as_col(arr))


def combinations(arr, n: int, repeats: bool = False, kind: str = "bigint") -> Column:
    """Sublists of n elements in the order of their places; equal ones once, unless ``repeats``."""
    a = as_col(arr)
    if n in (1, 2, 3):
        def after(place, k):  # lists of k elements from places behind
            rest = F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["i"] > place), lambda e: e)
            if k == 1:
                return F.transform(rest, lambda e: F.array(e["x"]))
            return F.flatten(F.transform(rest, lambda e: F.transform(after(e["i"], k - 1), lambda tail: F.concat(F.array(e["x"]), tail))))

        out = after(F.lit(-1), n)
        return out if repeats else F.array_distinct(out)
    return _python(f"array<array<{kind}>>", lambda x: _once(itertools.combinations(x, n), repeats), lambda m: math.comb(m, n))(a)


def permutations(arr, repeats: bool = False, kind: str = "bigint") -> Column:
    """All orders; equal ones once, unless ``repeats``."""
    return _python(f"array<array<{kind}>>", lambda a: _once(itertools.permutations(a), repeats), math.factorial)(as_col(arr))


# adverbs


def fold(f, arr, seed) -> Column:
    return F.aggregate(as_col(arr), as_col(seed), f)


def unfold(f, arr, kind: str = "bigint") -> Column:
    """The fold's intermediate results, first element included."""
    a = as_col(arr).cast(f"array<{kind}>")
    step = lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(F.concat(s, F.array(f(F.try_element_at(s, F.lit(-1)), x).cast(kind))))
    return F.aggregate(a, F.array().cast(f"array<{kind}>"), step)


def _times(f, x, n: int, keep: bool) -> Column:
    start = F.array(as_col(x))
    step = lambda s, _: F.concat(s if keep else F.slice(s, 1, 0), F.array(f(F.try_element_at(s, F.lit(-1)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step) if n > 0 else start


def repeat_times(f, n: int, x) -> Column:
    """``f`` applied n times to a value."""
    return F.try_element_at(_times(f, x, n, False), F.lit(-1))


def unfold_times(f, n: int, x) -> Column:
    """The value and the results of applying ``f`` once, twice, ... n times."""
    return _times(f, x, n, True)


def converge(f, x, most: int = 100) -> Column:
    """``f`` applied until the value no longer changes; an error if it still does after ``most`` times."""
    return F.try_element_at(reconverge(f, x, most), F.lit(-1))


def reconverge(f, x, most: int = 100) -> Column:
    """The value and the results on the way to the fixpoint, which comes last."""
    same = lambda s: F.get(s, F.size(s) - 1).eqNullSafe(F.get(s, F.size(s) - 2))
    grow = lambda s, _: F.when((F.size(s) > 1) & same(s), s).otherwise(F.concat(s, F.array(f(F.try_element_at(s, F.lit(-1))))))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(as_col(x)), grow)
    failed = F.raise_error(F.lit(f"no fixpoint after {most} times"))
    return F.when(same(out), F.slice(out, 1, F.size(out) - 1)).otherwise(failed)


def mapdown(f, arr, other=None) -> Column:
    """``f`` of each element, or of each pair of two lists."""
    return F.transform(as_col(arr), f) if other is None else F.zip_with(as_col(arr), as_col(other), f)


def mapright(f, x, arr) -> Column:
    x = as_col(x)
    return F.transform(as_col(arr), lambda e: f(x, e))


def mapleft(f, arr, x) -> Column:
    x = as_col(x)
    return F.transform(as_col(arr), lambda e: f(e, x))


def mapback(f, arr) -> Column:
    """``f(element, element before)``; the first is kept."""
    a = as_col(arr)
    return F.transform(a, lambda e, i: F.when(i == 0, e).otherwise(f(e, F.get(a, i - 1))))


def dotp(a, b) -> Column:
    """Sum of products of two number lists."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
