"""First-match and as-of joins. Keys are equal where both are null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ranges import carry_last, largest_group, with_rank
from tessella.schema import uncollide

Keys = str | Sequence[str] | Mapping[str, str]


def key_pairs(keys: Keys | None) -> list[tuple[str, str]]:
    """Left and right names of a key given as name, list of names or map from left to right."""
    if keys is None:
        return []
    if isinstance(keys, str):
        return [(keys, keys)]
    return list(keys.items()) if isinstance(keys, Mapping) else [(k, k) for k in keys]


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs])


def left_join(left: DataFrame, right: DataFrame, keys: Keys, order: str | Sequence[str], extra: Sequence[str] | None = None) -> DataFrame:
    """Each left row once, with the right columns of the **first** right row (in ``order``) of equal
    keys; null where there is none. Right names that collide get a number. The right side is reduced
    to one row per key before the join, map-side first, so that hot keys cost nothing there; on the
    left, adaptive execution splits them."""
    pairs = key_pairs(keys)
    gone = {b for _, b in pairs}
    rest = [c for c in right.columns if c not in gone and (extra is None or c in extra)]
    at = F.struct(*([order] if isinstance(order, str) else order))
    r = right.groupBy(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).agg(F.min_by(F.struct(F.lit(1).alias("_"), *rest), at).alias("_r"))
    out = left.join(r, _same([(left[a], r[f"_k{i}"]) for i, (a, _) in enumerate(pairs)]), "left")
    names = uncollide([*left.columns, *rest])[len(left.columns):]
    return out.select(*[left[c] for c in left.columns], *[F.col("_r")[c].alias(n) for c, n in zip(rest, names)])


def inner_join(left: DataFrame, right: DataFrame, keys: Keys, order: str | Sequence[str]) -> DataFrame:
    """As ``left_join``, without the left rows that have no match."""
    joined = left_join(left, right.withColumn("_hit", F.lit(1)), keys, order)
    return joined.filter(F.col("_hit").isNotNull()).drop("_hit")


def semi_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left rows whose keys occur on the right."""
    return _half(left, right, keys, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left rows whose keys don't occur on the right."""
    return _half(left, right, keys, "left_anti")


def _half(left: DataFrame, right: DataFrame, keys: Keys, how: str) -> DataFrame:
    pairs = key_pairs(keys)
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    return left.join(r, _same([(left[a], r[f"_k{i}"]) for i, (a, _) in enumerate(pairs)]), how)


def zip_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Tables paired by row number, left rows kept."""
    a = with_rank(left, left_order, "_row")
    names = uncollide([*left.columns, *right.columns])[len(left.columns):]
    b = with_rank(right, right_order, "_rrow").toDF(*names, "_rrow")
    return a.join(b, a["_row"] == b["_rrow"], "left").drop("_row", "_rrow")


def asof_join(left: DataFrame, right: DataFrame, keys: Keys | None, fuzzy: str | tuple[str, str], order: str | Sequence[str] = (), split: bool | None = None, most: int = 2_000_000) -> DataFrame:
    """Each left row with the right columns of the last right row of equal keys whose fuzzy value is
    not above its own; of equal fuzzy values the last in ``order`` counts. A null fuzzy value is the
    smallest. The right fuzzy column is dropped, colliding names get a number.

    Both sides are united and the last right row is carried forward, in one shuffle by the keys.
    Where there is no key, or one key has more than ``most`` rows of both (counted map-side; ``split``
    decides instead), ranges of keys and time are used, with one row handed from range to range."""
    pairs = key_pairs(keys)
    lf, rf = (fuzzy, fuzzy) if isinstance(fuzzy, str) else fuzzy
    gone = {b for _, b in pairs} | {rf}
    rest = [c for c in right.columns if c not in gone]
    names = uncollide([*left.columns, *rest])[len(left.columns):]
    ties = [order] if isinstance(order, str) else list(order)
    ks = [f"_k{i}" for i in range(len(pairs))]
    lk = [F.col(a).alias(k) for (a, _), k in zip(pairs, ks)]
    rk = [F.col(b).alias(k) for (_, b), k in zip(pairs, ks)]
    rcols = F.struct(F.lit(1).alias("_"), *[F.col(c).alias(n) for c, n in zip(rest, names)])
    tie = F.struct(F.lit(0).alias("_"), *ties)
    l_ = left.select(*lk, F.col(lf).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    r_ = right.select(*rk, F.col(rf).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), rcols.alias("_r"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    if split is None:
        split = not pairs or largest_group(both, ks) > most
    if split:
        done = carry_last(both, ks, ["_t", "_side", "_tie"], F.col("_r"), "_got")
    else:
        w = W.partitionBy(*ks).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
        done = both.withColumn("_got", F.last("_r", ignorenulls=True).over(w))
    done = done.filter(F.col("_side") == 1)
    return done.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_got")[n].alias(n) for n in names])
