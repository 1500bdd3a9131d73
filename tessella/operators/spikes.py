"""Implausible readings: impossible, frozen and spiking prices.

Frozen prices come from run-length detection, impossible ones from physical bounds. Spikes come
from a Hampel filter: each value's distance from the rolling medians of 3, 5 and 7 readings, held
against the window's median absolute deviation, and against the source's own scale, its median
absolute change. The deviation suits a window's noise; the source's scale makes the filter complete:
every spike of at most three readings that stands more than ``factor`` changes above or below both
its neighbours is further than half of that from one of the medians, itself or at a neighbour (where
a majority of the window lies on the run's side, the neighbour is; otherwise the run). The
filter's hits, widened by three readings, therefore hold all spikes, and the exact rule is applied
to them only.

Readings are packed in ordered chunks once (``operators.packed``). A source within one chunk is
finished there. One that goes on in other chunks gets, as columns of its chunk's row, the nearest
values around the chunk and its scale, made by windows over a bounded number of values per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ordered import starts
from tessella.operators.packed import Chunk, joined, map_chunks, packed, parts
from tessella.session import durable

PRICES = ("open", "high", "low", "close")
#: Kinds of series: each price, of all readings (0 to 3) and of the possible ones only (4 to 7).
KINDS = [(p, real) for real in (False, True) for p in range(4)]
EDGE = pa.struct([("kind", pa.int32()), ("us", pa.int64()), ("v", pa.float64()), ("head", pa.bool_())])
COUNT = pa.struct([("p", pa.int32()), ("b", pa.int64()), ("n", pa.int64())])
#: Leading bits of a change by which it is counted first, then within the bucket that holds the middle.
LEVELS = (45, 21, 0)


def impossible(c: Chunk) -> np.ndarray:
    o, h, lo, cl = c.values
    with np.errstate(invalid="ignore"):
        bad = (h < lo) | (o < lo) | (o > h) | (cl < lo) | (cl > h)
        for x in c.values:
            bad = bad | (x <= 0)
    return bad


def series(c: Chunk, bad: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, slice]:
    """Row numbers, source codes and values of a series, passing over nulls, with the values around the chunk
    if its row has them; the slice is the chunk's own."""
    p, real = KINDS[kind]
    x = c.values[p]
    rows = np.flatnonzero(~np.isnan(x) & ~(bad & real))
    before, after = [], []
    for h in c.row.get("halo") or []:
        if h["kind"] == kind:
            before, after = (h["vs"], after) if h["left"] else (before, h["vs"])
    s = np.concatenate([np.zeros(len(before), np.int64), c.s[rows], np.zeros(len(after), np.int64)])
    return rows, s, np.concatenate([before, x[rows], after]), slice(len(before), len(before) + len(rows))


def bits(x: np.ndarray) -> np.ndarray:
    """Order-preserving integers of non-negative doubles."""
    return (x + 0.0).view(np.int64)


def inner_changes(c: Chunk, bad: np.ndarray, p: int) -> np.ndarray:
    """Absolute changes of a price within an edge chunk, without those at its first reading, which may be a copy."""
    rows, _, v, _ = series(c, bad, 4 + p)
    return np.abs(np.diff(v[1:] if len(rows) and rows[0] == 0 and not c.row.get("skip") else v))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def edges(keep: int):
    """For an edge chunk: each series' first and last ``keep`` values, and counts of the changes by leading bits."""

    def run(c: Chunk) -> tuple[dict, dict]:
        bad, at, counts = impossible(c), [], []
        for kind in range(8):
            rows, _, v, _ = series(c, bad, kind)
            n = len(rows)
            i = np.arange(n) if n <= 2 * keep else np.append(np.arange(keep), np.arange(n - keep, n))
            zero = n > 0 and rows[0] == 0
            at.append((np.full(len(i), kind), c.us[rows[i]], v[i], i <= int(zero)))
        for p in range(4):
            b, n = counted(bits(inner_changes(c, bad, p)) >> LEVELS[0])
            counts.append((np.full(len(b), p), b, n))
        cat = lambda xs, names: {f: np.concatenate([x[j] for x in xs]) for j, f in enumerate(names)}
        return cat(at, ("kind", "us", "v", "head")), cat(counts, ("p", "b", "n"))

    return run


def around(ends: DataFrame, keep: int) -> DataFrame:
    """The series near the chunks' ends in order, each value with up to ``keep`` values before and after."""
    e = ends.select("k", "pid", "prev_us", F.explode("x0").alias("e")).select("k", "pid", "prev_us", "e.*")
    e = e.filter(~F.col("us").eqNullSafe(F.col("prev_us"))).drop("prev_us")
    w = W.partitionBy("k", "kind").orderBy("us")
    return e.withColumns({
        "before": F.lag("v").over(w), "first": ~F.col("pid").eqNullSafe(F.lag("pid").over(w)), "last": ~F.col("pid").eqNullSafe(F.lead("pid").over(w)),
        "lefts": F.collect_list("v").over(w.rowsBetween(-keep, -1)), "rights": F.collect_list("v").over(w.rowsBetween(1, keep))})


def halos(near: DataFrame) -> DataFrame:
    """``(k, pid, halo)``: for each series the values before and after the chunk."""
    sides = F.array(F.when(F.col("first"), F.struct("kind", F.lit(True).alias("left"), F.col("lefts").alias("vs"))), F.when(F.col("last"), F.struct("kind", F.lit(False).alias("left"), F.col("rights").alias("vs"))))
    x = near.filter("first or last").select("k", "pid", F.explode(sides).alias("h")).filter("h is not null and size(h.vs) > 0")
    return x.groupBy("k", "pid").agg(F.collect_list("h").alias("halo"))


def ranked(counts: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """Rows of ``counts`` that hold a wanted rank, as ``(k, p, r, b, n, rest)``: ``rest`` is the rank within."""
    if ranks is None:
        w = W.partitionBy("k", "p")
        both = counts.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("b")) - F.col("n"))
        middle = F.array(F.struct(F.lit(0).alias("r"), F.expr("(total - 1) div 2").alias("at")), F.struct(F.lit(1).alias("r"), F.expr("total div 2").alias("at")))
        x = both.withColumn("x", F.explode(middle)).select("k", "p", "b", "n", "before", "x.r", "x.at")
    else:
        w = W.partitionBy("k", "p", "up").orderBy("b")
        x = counts.withColumn("before", F.sum("n").over(w) - F.col("n")).join(ranks, ["k", "p", "up"])
    return x.filter("before <= at and at < before + n").select("k", "p", "r", "b", "n", (F.col("at") - F.col("before")).alias("rest"))


def within(c: Chunk, above: int, shift: int) -> pa.Table | None:
    """An edge chunk's changes in the wanted buckets, counted by finer bits."""
    bad, out = impossible(c), []
    for p in range(4):
        want = np.array(sorted({w["b"] for w in c.row["wanted"] if w["p"] == p}), np.int64)
        b = bits(inner_changes(c, bad, p))
        b, n = counted(b[np.isin(b >> above, want)] >> shift)
        out.append(pa.table({"k": pa.array([c.row["k"]] * len(b), pa.string()), "p": pa.array(np.full(len(b), p), pa.int32()), "b": b, "n": n.astype(np.int64)}))
    return pa.concat_tables(out)


def scales(chunks: DataFrame, ends: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """``(k, scale)``: the exact median changes (an array by price) of sources that may lie in several chunks, by
    radix selection: counts by leading bits, then by finer ones within the bucket that holds the middle,
    until few enough changes are left to count by value."""
    heads = near.filter("head and kind >= 4 and before is not null").select("k", (F.col("kind") - 4).alias("p"), F.abs(F.col("v") - F.col("before")).alias("d"))
    heads = heads.mapInArrow(_as_bits, "k string, p int, b bigint")
    total = lambda c: c.groupBy("k", "p", "b").agg(F.sum("n").alias("n"))
    head_counts = lambda h, shift: h.select("k", "p", F.shiftright("b", shift).alias("b"), F.lit(1).cast("bigint").alias("n"))
    counts = ends.select("k", F.explode("x1").alias("c")).select("k", "c.*").unionByName(head_counts(heads, LEVELS[0]))
    found, above = durable(ranked(total(counts), None)), LEVELS[0]
    while above:
        large = (found.agg(F.max("n")).first()[0] or 0) > most
        shift = next(x for x in LEVELS if x < above) if large else 0
        buckets = found.select("k", "p", "b").distinct()
        wanted = ends.select("k", "pid").join(buckets.groupBy("k").agg(F.collect_list(F.struct("p", "b")).alias("wanted")), "k")
        mine = joined(chunks.filter("edge").drop("x0", "x1"), durable(ends.select("k", "pid", "skip").join(wanted, ["k", "pid"]))).filter("wanted is not null")
        inside = map_chunks(mine, lambda c, a=above, s=shift: within(c, a, s), "k string, p int, b bigint, n bigint", [False] * 4)
        near_heads = heads.join(buckets.select("k", "p", F.col("b").alias("up")), ["k", "p"]).filter(F.shiftright("b", above) == F.col("up"))
        counts = total(inside.unionByName(head_counts(near_heads, shift))).withColumn("up", F.shiftright("b", above - shift))
        found = durable(ranked(counts, found.select("k", "p", F.col("b").alias("up"), "r", F.col("rest").alias("at"))))
        above = shift
    medians = found.mapInArrow(_as_doubles, "k string, p int, v double").groupBy("k", "p").agg(F.avg("v").alias("m"))
    return medians.groupBy("k").agg(F.collect_list(F.struct("p", "m")).alias("scale"))


def _as_bits(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("p"), pa.array(bits(b.column("d").to_numpy(zero_copy_only=False)))], ["k", "p", "b"])


def _as_doubles(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("p"), pa.array(b.column("b").to_numpy().view(np.float64))], ["k", "p", "v"])


def own_scale(c: Chunk, p: int, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Median absolute change of a price for each source of a chunk; NaN without changes."""
    out = np.full(len(c.names), np.nan)
    if c.row["edge"]:
        for x in c.row.get("scale") or []:
            if x["p"] == p:
                out[0] = x["m"]
        return out
    same = s[1:] == s[:-1]
    k, d = s[1:][same], np.abs(np.diff(v))[same]
    by = np.lexsort((d, k))
    k, d = k[by], d[by]
    at = np.flatnonzero(starts(k))
    n = np.diff(np.append(at, len(k)))
    out[k[at]] = (d[at + (n - 1) // 2] + d[at + n // 2]) / 2
    return out


def runs(s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each value stands in."""
    new = starts(s, v)
    at = np.flatnonzero(new)
    return np.diff(np.append(at, len(v)))[np.cumsum(new) - 1] if len(v) else np.zeros(0, int)


def middle(columns: list[np.ndarray]) -> np.ndarray:
    """Median across an odd number of equal-length arrays, by exchanging neighbours in place."""
    a, n = [x.copy() for x in columns], len(columns)
    for i in range(n):
        for j in range(i % 2, n - 1, 2):
            low = np.minimum(a[j], a[j + 1])
            np.maximum(a[j], a[j + 1], out=a[j + 1])
            a[j] = low
    return a[n // 2]


def hampel(s: np.ndarray, v: np.ndarray, scale: np.ndarray, half: Sequence[int] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """``(changes, deviations)`` of each value: its largest distance from its rolling medians in units of
    ``scale``, infinite where that is 0 or where no window fits the source; and its distance from the
    median of the widest window in units of that window's median absolute deviation, which counts as
    ``scale`` at least (NaN where no window fits, or the unit is 0)."""
    out, dev = np.zeros(len(v)), np.full(len(v), np.nan)
    for h in half:
        full = np.zeros(len(v), bool)
        if len(v) > 2 * h:
            mid = slice(h, len(v) - h)
            full[mid] = s[2 * h:] == s[:-2 * h]
            window = [v[i:len(v) - 2 * h + i] for i in range(2 * h + 1)]
            med = middle(window)
            away = np.abs(v[mid] - med)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[mid] = np.fmax(out[mid], np.nan_to_num(away / scale[mid], nan=0.0, posinf=np.inf))
                if h == max(half):
                    unit = np.fmax(middle([np.abs(x - med) for x in window]), scale[mid])
                    dev[mid] = np.where(full[mid] & (unit > 0), away / unit, np.nan)
        out[~full] = np.inf
    return out, dev


def spikes(s: np.ndarray, v: np.ndarray, scale: np.ndarray, factor: float, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of at most ``most`` readings that stand above, or below, both neighbours of
    the run by more than ``factor * scale``, looked for at the filter's hits; and their deviations."""
    n, out = len(v), np.zeros(len(v), bool)
    changes, dev = hampel(s, v, scale)
    hit = (changes > factor / 2) | (dev > factor)
    wide = hit.copy()
    for d in range(1, most + 1):
        wide[d:] |= hit[:-d]
        wide[:-d] |= hit[d:]
    for r in range(1, most + 1):
        at = np.flatnonzero(wide[1:max(n - r, 1)]) + 1
        at = at[s[at - 1] == s[at + r]]
        a, b = v[at - 1], v[at + r]
        run = np.stack([v[at + i] for i in range(r)])
        gap = factor * scale[at]
        ok = (run.min(0) - np.maximum(a, b) > gap) | (np.minimum(a, b) - run.max(0) > gap)
        for i in range(r):
            out[at[ok] + i] = True
    return out, dev


FLAGS = "k string, t_us bigint, impossible boolean, frozen int, spike int, deviation double"


def flagged_readings(df: DataFrame, factor: float = 10.0, least_run: int = 8, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid", most: int = 1_000_000) -> DataFrame:
    """Readings that are impossible, frozen or a spike:
    ``(key, stamp_us, impossible, frozen, spike, deviation)``; ``frozen`` and ``spike`` have a bit for each of
    open, high, low, close. ``deviation`` is the largest of the prices' distances from the median of the
    seven readings around, in units of those readings' median absolute deviation or the source's median
    change, if that is more; null for impossible readings and where there are no seven.

    Readings of equal source and stamp are one (the smallest ``order`` counts). Null and NaN prices
    are passed over. A source with fewer than two counted values of a price has no spikes of it.
    Where the median change is 0, any value beyond both neighbours is a spike. Empty input gives no
    rows. ``most`` is the number of equal-looking changes of one source that are told apart in one
    step. Jobs run when this is called: the chunks are stored, and read three times."""
    keep = max(least_run, 8) + 2
    chunks = packed(df, PRICES, extra=edges(keep), kinds=(EDGE, COUNT), key=key, stamp=stamp, order=order)
    ends = parts(chunks, "x0", "x1")
    near = durable(around(ends, keep))
    beside = ends.select("k", "pid", "skip").join(halos(near), ["k", "pid"], "left").join(scales(chunks, ends, near, most), "k", "left")
    out = map_chunks(joined(chunks.drop("x0", "x1"), durable(beside)), lambda c: flags(c, factor, least_run), FLAGS, [False] * 4)
    return out.select(F.col("k").cast(df.schema[key].dataType).alias(key), F.col("t_us").alias("stamp_us"), "impossible", "frozen", "spike", "deviation")


def flags(c: Chunk, factor: float, least_run: int) -> pa.Table | None:
    bad, n = impossible(c), len(c.us)
    frozen, spike, deviation = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, np.nan)
    for p in range(4):
        rows, s, v, own = series(c, bad, p)
        frozen[rows[runs(s, v)[own] >= least_run]] |= 1 << p
        rows, s, v, own = series(c, bad, 4 + p)
        hit, dev = spikes(s, v, own_scale(c, p, s, v)[s], factor)
        spike[rows[hit[own]]] |= 1 << p
        deviation[rows] = np.fmax(deviation[rows], dev[own])
    hit = np.flatnonzero(bad | (frozen > 0) | (spike > 0))
    if not len(hit):
        return None
    d = deviation[hit]
    return pa.table({"k": pa.array([c.names[x] for x in c.s[hit]], pa.string()), "t_us": c.us[hit], "impossible": bad[hit], "frozen": frozen[hit], "spike": spike[hit], "deviation": pa.array(d, mask=np.isnan(d))})
