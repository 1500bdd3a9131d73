"""Irregular readings onto a regular grid, by validity intervals.

Each reading holds from its time until the next one. The intervals are intersected with the cells of
the grid: a cell that an interval covers wholly, and in which none starts, has no reading. For
averages a value holds for ``hold_us`` at most; the lengths of the intersections weigh it and give the
cell's coverage.

Readings are packed in ordered chunks (``operators.packed``), and each chunk makes the cells of its own
span of time, from the reading before its first to its last. Only the cells at a span's two ends can
be shared with other chunks; their parts are added up, the others are final as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ordered import starts
from tessella.operators.packed import Chunk, joined, map_chunks, packed, parts
from tessella.operators.readings import HOUR_US
from tessella.session import durable

#: Cells that a task makes at once.
MOST = 1_000_000


def pieces(start: np.ndarray, end: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intersections of intervals with cells: each one's interval, cell and length."""
    a = start // step
    size = np.where(end > start, (end - 1) // step - a + 1, 0)
    i = np.repeat(np.arange(len(start)), size)
    cell = a[i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
    return i, cell, np.minimum(end[i], (cell + 1) * step) - np.maximum(start[i], cell * step)


def sliced(size: np.ndarray, most: int = MOST) -> Iterator[slice]:
    """Slices of items whose sizes sum to about ``most``, of one item at least."""
    run, a = np.cumsum(size), 0
    while a < len(size):
        e = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + most, side="right")))
        yield slice(a, e)
        a = e


def empty_runs(df: DataFrame, step_us: int = HOUR_US, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """The longest runs of cells without a reading between a source's first and last reading:
    ``(key, first_cell, last_cell)``. Readings of equal stamp are one; empty input gives no rows. A job
    runs when this is called: the chunks are stored."""
    chunks = packed(df, [], key=key, stamp=stamp, order=order)
    ends = durable(parts(chunks).select("k", "pid", "prev_us", "skip"))
    out = map_chunks(joined(chunks, ends), lambda c: empty_of(c, step_us), "k string, first_cell bigint, last_cell bigint", [])
    return out.withColumn("k", F.col("k").cast(df.schema[key].dataType)).withColumnRenamed("k", key)


def empty_of(c: Chunk, step: int) -> Iterator[pa.Table]:
    s, us = c.s, c.us
    if c.row.get("prev_us") is not None:
        s, us = np.append(0, s), np.append(c.row["prev_us"], us)
    at = np.flatnonzero(s[1:] == s[:-1])
    at = at[us[at + 1] // step > us[at] // step + 1]
    for part in sliced(us[at + 1] // step - us[at] // step):
        mine = at[part]
        i, cell, length = pieces(us[mine], us[mine + 1], step)
        none = (length == step) & (cell != us[mine][i] // step)
        i, cell = i[none], cell[none]
        first = np.flatnonzero(starts(i))
        yield pa.table({"k": pa.array([c.names[x] for x in s[mine[i[first]]]], pa.string()), "first_cell": cell[first], "last_cell": cell[np.append(first[1:], len(i)) - 1] if len(i) else cell})


VALUES = pa.struct([("first_us", pa.int64()), ("last_us", pa.int64()), ("last", pa.float64())])


def _ends(c: Chunk) -> tuple[dict]:
    """Of an edge chunk's values the first one's time and the last one, of all readings, then without the first."""
    out = []
    for a in (0, 1):
        at = np.flatnonzero(~np.isnan(c.values[0][a:])) + a
        out.append((c.us[at[0]], c.us[at[-1]], c.values[0][at[-1]]) if len(at) else (np.iinfo(np.int64).max, 0, np.nan))
    return ({n: np.array([o[j] for o in out]) for j, n in enumerate(("first_us", "last_us", "last"))},)


CELLS = "k string, pid int, open boolean, cell bigint, n bigint, vol_n bigint, vol_sum bigint, known double, area double, covered bigint"


def regular_series(df: DataFrame, level: str = "close", total: str = "volume", step_us: int = HOUR_US, hold_us: int = HOUR_US, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """One row per source and cell from its first to its last reading:
    ``(key, cell, start, n, total, level, twa, coverage, state)``.

    ``twa`` is the average of ``level`` over the part of the cell that validity intervals cover,
    ``coverage`` that part's share, ``level`` the last value known at the cell's end (carried over
    empty cells), ``total`` the sum of ``total`` (0 in a cell without readings, null where none of
    its readings has one, or beyond BIGINT). ``state`` is ``reading``, or ``filled`` for a cell without
    readings, or ``unknown`` for one before any value. The last interval of a source ends with the
    cell of its last value. Null values are passed over; readings of equal stamp are one; empty
    input gives no rows. A task makes the cells of one source at a time where these are many. Jobs
    run when this is called: the chunks are stored."""
    chunks = packed(df, [level, total], [False, True], _ends, (VALUES,), key, stamp, order)
    w = W.partitionBy("k").orderBy("pid")
    own = F.get("x0", F.when(F.col("skip"), 1).otherwise(0))
    before = F.last(F.when(F.col("v.last_us") > 0, F.struct("v.last_us", "v.last")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.min("v.first_us").over(w.rowsBetween(1, W.unboundedFollowing))
    ends = parts(chunks, "first_us", "x0").withColumn("v", own)
    ends = ends.select("k", "pid", "skip", "prev_us", F.lead("first_us").over(w).isNull().alias("final"), before.alias("before"), F.nullif(after, F.lit(2**63 - 1)).alias("after_us"))
    made = map_chunks(joined(chunks.drop("x0"), durable(ends)), lambda c: cells_of(c, step_us, hold_us), CELLS, [False, True])
    made = durable(made)
    shared = made.filter("open").groupBy("k", "cell").agg(
        F.sum("n").alias("n"), F.sum("vol_n").alias("vol_n"), F.try_sum("vol_sum").alias("vol_sum"), F.max_by("known", "pid").alias("known"), F.sum("area").alias("area"), F.sum("covered").alias("covered"))
    out = made.filter("not open").drop("open", "pid").unionByName(shared)
    n, known = F.col("n"), F.col("known")
    return out.select(
        F.col("k").cast(df.schema[key].dataType).alias(key), "cell", F.timestamp_micros(F.col("cell") * step_us).cast("timestamp_ntz").alias("start"), "n",
        F.when(n == 0, F.lit(0)).when(F.col("vol_n") > 0, F.col("vol_sum")).cast("bigint").alias("total"), known.alias("level"),
        F.when(F.col("covered") > 0, F.col("area") / F.col("covered")).alias("twa"), (F.col("covered") / step_us).alias("coverage"),
        F.when(n > 0, "reading").when(known.isNotNull(), "filled").otherwise("unknown").alias("state"))


def cells_of(c: Chunk, step: int, hold: int) -> Iterator[pa.Table]:
    """A chunk's cells, source by source, or many small sources together."""
    if not len(c.us):
        return
    edge, prev = c.row["edge"], c.row.get("prev_us")
    first = np.flatnonzero(starts(c.s))
    last = np.append(first[1:], len(c.s)) - 1
    low = (c.us[first] if prev is None else np.array([prev])) // step
    size = c.us[last] // step - low + 1
    for part in sliced(size):
        a, e = first[part][0], last[part][-1] + 1
        s = c.s[a:e] - c.s[a]
        yield _cells(c, s, slice(a, e), low[part], size[part], step, hold, edge, prev)


def _cells(c: Chunk, s: np.ndarray, rows: slice, low: np.ndarray, size: np.ndarray, step: int, hold: int, edge: bool, prev: int | None) -> pa.Table:
    us, value, vol, some = c.us[rows], c.values[0][rows], c.values[1][rows], c.some[1][rows]
    base = np.cumsum(size) - size
    m = int(size.sum())
    place = lambda src, cell: base[src] + cell - low[src]
    at = place(s, us // step)
    n, vol_n = np.bincount(at, minlength=m), np.bincount(at[some], minlength=m)
    vol_sum, rough = np.zeros(m, np.int64), np.bincount(at[some], vol[some].astype(float), minlength=m)
    np.add.at(vol_sum, at[some], vol[some])
    # values, after the one before the chunk
    ok = np.flatnonzero(~np.isnan(value))
    vs, vu, v = s[ok], us[ok], value[ok]
    before = c.row.get("before")
    if before:
        vs, vu, v = np.append(0, vs), np.append(before["last_us"], vu), np.append(before["last"], v)
    # where each value's interval ends: at the next value of its source, or for the last one with its cell
    end = (vu // step + 1) * step
    if len(vu):
        same = vs[1:] == vs[:-1]
        end[:-1][same] = vu[1:][same]
        if edge and c.row.get("after_us") is not None:
            end[-1] = c.row["after_us"]
    end = np.minimum(end, vu + hold)
    begin = vu
    if edge:  # within the chunk's own span
        begin = vu if prev is None else np.maximum(vu, prev)
        end = end if c.row["final"] else np.minimum(end, us[-1])
    i, cell, length = pieces(begin, end, step)
    area, covered = np.zeros(m, np.longdouble), np.zeros(m, np.int64)
    p = place(vs[i], cell)
    np.add.at(area, p, v[i].astype(np.longdouble) * length)
    np.add.at(covered, p, length)
    # the last value known at each cell's end
    held = np.full(m, -1, np.int64)
    inside = vu // step >= low[vs] if len(vu) else np.zeros(0, bool)
    np.maximum.at(held, place(vs[inside], vu[inside] // step), np.flatnonzero(inside))
    if before and not inside[0]:
        held[0] = max(held[0], 0)
    src = np.repeat(np.arange(len(size)), size)
    floor = np.full(len(size), -1, np.int64)
    floor[vs[::-1]] = np.arange(len(vs))[::-1]  # each source's first value
    held = np.maximum.accumulate(held)
    held[(held < floor[src]) | (floor[src] < 0)] = -1
    cells = low[src] + np.arange(m) - base[src]
    opened = np.zeros(m, bool)
    if edge:
        opened[-1] = True
        opened[0] |= prev is not None
    names = [c.names[x] for x in np.unique(c.s[rows])]
    return pa.table({
        "k": pa.DictionaryArray.from_arrays(src.astype(np.int32), pa.array(names, pa.string())).cast(pa.string()), "pid": pa.array(np.full(m, c.row["pid"]), pa.int32()), "open": opened, "cell": cells, "n": n.astype(np.int64), "vol_n": vol_n.astype(np.int64),
        "vol_sum": pa.array(vol_sum, mask=np.abs(rough) >= 2.0**63), "known": pa.array(v[held] if len(v) else np.zeros(m), mask=held < 0), "area": area.astype(float), "covered": covered})
