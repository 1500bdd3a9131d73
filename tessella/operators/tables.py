"""Table operators: selection, sorting, positions, sets, changes.

Tables have no row order of their own; operators that need one take the columns of a total order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.compare import as_col, text_key
from tessella.operators.ranges import with_rank
from tessella.schema import uncollide

# sorting and positions


def _texts(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    return [text_key(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in cols]


def sort(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Ascending by the columns (all, from left to right), nulls first, strings case-folded first."""
    return df.orderBy(*[c.asc_nulls_first() for c in _texts(df, cols or df.columns)])


def ascend(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Ascending by ``col``, nulls first; ties in ``order``."""
    return df.orderBy(_texts(df, [col])[0].asc_nulls_first(), *order)


def descend(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Descending by ``col``, nulls last; ties in ``order``."""
    return df.orderBy(_texts(df, [col])[0].desc_nulls_last(), *order)


def top(df: DataFrame, n: int, col: str, order: Sequence[str], down: bool = True) -> DataFrame:
    """The first n rows in descending (ascending) order; taken per partition first."""
    return (descend if down else ascend)(df, col, order).limit(n)


def take(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows, or the last for negative n; no cycling (see ``cycle``)."""
    by = [F.col(c) if n >= 0 else F.col(c).desc() for c in order]
    return df.orderBy(*by).limit(abs(n))


def drop(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Without the first n rows, or the last for negative n."""
    ranked = with_rank(df, order, "_rank")
    keep = F.col("_rank") >= n if n >= 0 else F.col("_rank") < df.count() + n
    return ranked.filter(keep).drop("_rank")


def cycle(df: DataFrame, n: int, order: Sequence[str], name: str = "place") -> DataFrame:
    """n rows, going round the table again where it is shorter; ``name`` is the place, from 0. An
    empty table gives no rows."""
    size = df.count()
    if not size or n <= 0:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint"))
    ranked = with_rank(df, order, "_rank")
    times = F.ceil((F.lit(n) - F.col("_rank")) / size)
    return ranked.filter(F.col("_rank") < n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1))).withColumn(name, F.col("_rank") + F.col("_i") * size).drop("_rank", "_i")


def reverse(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order])


def rows_at(df: DataFrame, places: Sequence[int], order: Sequence[str]) -> DataFrame:
    """The rows at the given places (from 0), repeated and in that order."""
    want = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(places)], "_i int, _rank bigint")
    return with_rank(df, order, "_rank").join(F.broadcast(want), "_rank").orderBy("_i").drop("_rank", "_i")


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def deal(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


# distinct and sets


def distinct(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """Unique values of the columns in first-seen order."""
    return df.groupBy(*cols).agg(F.min(order).alias("_first")).orderBy("_first").drop("_first")


def pieces(df: DataFrame, cuts: Sequence[int], order: Sequence[str], name: str = "piece") -> DataFrame:
    """``df`` with the number of the piece each row falls in when the table is cut before the given places."""
    ranked = with_rank(df, order, "_rank")
    piece = sum(((F.col("_rank") >= c).cast("int") for c in cuts), F.lit(0))
    return ranked.withColumn(name, piece).drop("_rank")


def part(df: DataFrame, col: str, order: str) -> DataFrame:
    """``(col, places)``: each value's row ids in order, as an array (bounded groups only)."""
    return df.groupBy(col).agg(F.sort_array(F.collect_list(order)).alias("places"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` not in ``b``; duplicates are kept, null equals null."""
    r = b.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(a.columns)]).distinct()
    on = None
    for i, c in enumerate(a.columns):
        e = a[c].eqNullSafe(r[f"_r{i}"])
        on = e if on is None else on & e
    return a.join(r, on, "left_anti")


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in columns of the same names."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# selection


def where_all(df: DataFrame, *terms) -> DataFrame:
    """Rows that meet all terms, applied one after the other. A term may be a function of an
    aggregate builder: ``lambda agg: F.col("x") == agg(F.max("x"))`` sees the rows left so far, as a
    subquery of the same plan."""
    for t in terms:
        if callable(t) and not isinstance(t, Column):
            now = df
            t = t(lambda e, now=now: now.agg(e).scalar())
        df = df.filter(t)
    return df


def select(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def group(df: DataFrame, keys: Mapping[str, Column | str] | Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates by keys, key columns first; null is a key like others."""
    named = keys.items() if isinstance(keys, Mapping) else [(k, k) for k in keys]
    return df.groupBy(*[as_col(c).alias(n) for n, c in named]).agg(*[a.alias(n) for n, a in aggs.items()])


# changes


def insert(df: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the rows of ``new``, which has the same columns, or those in ``columns`` (others become
    null). Numbers widen; an unknown or missing column is an error."""
    want = list(columns or df.columns)
    if sorted(new.columns) != sorted(want):
        raise ValueError(f"columns {sorted(new.columns)} are not {sorted(want)}")
    unknown = set(want) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return df.unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, keys: Sequence[str], order: str, left_order: str | None = None) -> DataFrame:
    """``df`` with each new row replacing the row of equal keys, or added.

    Of several new rows for a present key the last (by ``order``) counts. New rows of absent keys are
    all added. Where ``df`` has several rows of a key, the first (by ``left_order``) is replaced, or all
    of them without an order. Keys are equal where both are null."""
    cols = df.columns
    new = new.select(*cols, *([order] if order not in cols else []))
    new_rest = F.struct(*cols)
    last = new.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(new_rest, order).alias("_new"))
    left = df
    first = F.lit(True)
    if left_order:
        first = F.row_number().over(W.partitionBy(*keys).orderBy(left_order)) == 1
    left = left.withColumn("_first", first)
    on = None
    for k in keys:
        e = left[k].eqNullSafe(last[f"_k_{k}"])
        on = e if on is None else on & e
    hit = F.col("_new").isNotNull() & F.col("_first")
    kept = left.join(last, on, "left").select(*[F.when(hit, F.col("_new")[c]).otherwise(left[c]).alias(c) for c in cols])
    old_keys = df.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        e = new[k].eqNullSafe(old_keys[f"_o_{k}"])
        on = e if on is None else on & e
    added = new.select(*cols).join(old_keys, on, "left_anti")
    return kept.unionByName(added)


def update(df: DataFrame, sets: Sequence[tuple[str, Column]], where: Column | None = None) -> DataFrame:
    """Columns set from left to right; later ones see earlier results. With ``where`` only rows that meet
    it change, and no column may be added."""
    for name, e in sets:
        if where is not None:
            if name not in df.columns:
                raise ValueError(f"a restricted update can't add column {name!r}")
            df = df.withColumn("_hit", F.coalesce(where, F.lit(False)) if "_hit" not in df.columns else F.col("_hit"))
            df = df.withColumn(name, F.when(F.col("_hit"), e).otherwise(F.col(name)))
        else:
            df = df.withColumn(name, e)
    return df.drop("_hit")


def update_by(df: DataFrame, keys: Sequence[str], sets: Mapping[str, Column], order: Sequence[str] = ()) -> DataFrame:
    """Expressions computed per group and written to every row of it. Aggregates are taken map-side and joined
    back (null equals null), so that no group meets in one task; window functions, built by
    ``lambda w: ...`` over the group in ``order``, are one task's work for a group: ``operators.moving`` has
    them for groups of any size."""
    windows = {n: e for n, e in sets.items() if callable(e) and not isinstance(e, Column)}
    totals = {n: e for n, e in sets.items() if n not in windows}
    out = df
    if totals:
        g = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[e.alias(f"_t{i}") for i, e in enumerate(totals.values())])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        out = out.join(g, same, "left").withColumns({n: F.col(f"_t{i}") for i, n in enumerate(totals)}).drop(*g.columns)
    ordered: WindowSpec = W.partitionBy(*keys).orderBy(*order) if order else W.partitionBy(*keys)
    return out.withColumns({n: e(ordered) for n, e in windows.items()}) if windows else out


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows that don't meet the condition; where it is null the row stays."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def delete_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


# making and taking apart


def table(spark: SparkSession, names: Sequence[str], columns: Sequence[Sequence]) -> DataFrame:
    """A table of equal-length lists; lists of one element are repeated, others must agree."""
    n = max((len(c) for c in columns), default=0)
    if any(len(c) not in (1, n) for c in columns):
        raise ValueError("columns differ in length")
    cols = [list(c) * n if len(c) == 1 and n != 1 else list(c) for c in columns]
    return spark.createDataFrame(list(zip(*cols)), uncollide(names))


def extract(df: DataFrame, most: int = 1_000_000):
    """A small result as Python values: one value, the list of one column or row, or a list of columns.
    More than ``most`` rows are an error: they belong in a table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    if len(df.columns) == 1:
        vals = [r[0] for r in rows]
        return vals[0] if len(vals) == 1 else vals
    if len(rows) == 1:
        return list(rows[0])
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in df.columns]


def table_arithmetic(a: DataFrame, b: DataFrame, op, order: Sequence[str]) -> DataFrame:
    """Tables combined column by column, paired by row number (keyed by ``order``, which both have and which
    is kept); columns of one side only are carried."""
    ra = with_rank(a, order, "_row")
    rb = with_rank(b, order, "_row").toDF(*[f"_b_{c}" for c in b.columns], "_row")
    both = ra.join(rb, "_row", "full")
    cols = []
    for c in dict.fromkeys([*a.columns, *b.columns]):
        if c in order or c not in b.columns:
            cols.append(F.col(c))
        elif c not in a.columns:
            cols.append(F.col(f"_b_{c}").alias(c))
        else:
            cols.append(op(F.col(c), F.col(f"_b_{c}")).alias(c))
    return both.select(*cols)
