"""Mergeable digests of large numeric columns, and percentiles with a certified rank error.

A digest is a list of centroids (mean, weight) in ascending order. Values of a day are sorted and
cut where the scale function of their quantile passes a whole number, so that centroids are light
at the ends and weigh at most ``pi / delta`` of all values in the middle. Digests are merged by
sorting their centroids together and cutting again, a bounded number at a time, in as many rounds as
the largest group needs. A second count, for each percentile, of the values below and up to the
estimate certifies its rank error whatever the digest did.

Readings are packed in ordered chunks (``operators.packed``): a source within one chunk is digested and
counted there at once; only the others are merged, and counted in a second pass over their chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import codes, floats, map_partition, starts
from tessella.operators.packed import Chunk, joined, map_chunks, packed, parts
from tessella.operators.readings import DAY_US
from tessella.session import durable

DIGEST = "k string, part bigint, metric string, n bigint, lo double, hi double, means array<double>, weights array<bigint>"
#: Digests that are merged at a time.
FAN = 100


def clustered(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of each group: ``(group, mean, weight)``. Input is sorted by group and mean."""
    if not len(mean):
        return group, mean, weight
    first = np.flatnonzero(starts(group))
    size = np.diff(np.append(first, len(group)))
    run = np.cumsum(weight)
    before = np.repeat((run - weight)[first], size)
    total = np.repeat(run[np.append(first[1:], len(group)) - 1] - (run - weight)[first], size)
    q = (run - before - weight / 2) / total
    cut = np.floor(delta / (2 * np.pi) * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2)).astype(np.int64)
    at = np.flatnonzero(starts(group, cut))
    w = np.add.reduceat(weight, at)
    low = mean[at]
    m = np.add.reduceat(mean * weight, at) / w
    high = mean[np.append(at[1:], len(mean)) - 1]
    return group[at], np.clip(m, low, high), w  # equal values keep their value exactly


def lists(group: np.ndarray, groups: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    size = np.bincount(group, minlength=groups)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values, kind))


def digests(df: DataFrame, metrics: Sequence[str] = ("volume", "close"), delta: int = 1000, part_us: int = DAY_US, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """Digests per source, part (UTC day, counted from 1970) and metric:
    ``(k, part, metric, n, lo, hi, means, weights)``. A day that lies in two ordered ranges has two.
    Null and NaN values are left out, infinite ones too; a source without values has none. A job
    runs when this is called: the chunks are stored."""
    chunks = packed(df, metrics, key=key, stamp=stamp, order=order)
    return digests_of(joined(chunks, durable(parts(chunks).select("k", "pid", "skip"))), metrics, delta, part_us)


def sorted_values(c: Chunk, i: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and values of a metric, in the order of both, without null and infinite ones."""
    v = c.values[i]
    ok = np.flatnonzero(np.isfinite(v))
    g, x = group[ok], v[ok]
    by = np.lexsort((x, g))
    return g[by], x[by]


def digests_of(chunks: DataFrame, metrics: Sequence[str], delta: int, part_us: int | None) -> DataFrame:
    """Digests of each chunk, by parts of ``part_us``, or of a source as a whole (part 0)."""

    def run(c: Chunk) -> Iterator[pa.Table]:
        part = c.us // part_us if part_us else np.zeros(len(c.us), np.int64)
        at = np.flatnonzero(starts(c.s, part))
        group = np.cumsum(starts(c.s, part)) - 1
        for i, metric in enumerate(metrics):
            g, x = sorted_values(c, i, group)
            if not len(x):
                continue
            there, new = np.unique(g, return_inverse=True)
            first = np.flatnonzero(starts(g))
            last = np.append(first[1:], len(g)) - 1
            cg, m, w = clustered(new, x, np.ones(len(x), np.int64), delta)
            yield pa.table({
                "k": pa.array([c.names[j] for j in c.s[at[there]]], pa.string()), "part": part[at[there]], "metric": pa.array([metric] * len(there), pa.string()), "n": last - first + 1,
                "lo": x[first], "hi": x[last], "means": lists(cg, len(there), m, pa.float64()), "weights": lists(cg, len(there), w, pa.int64())})

    return map_chunks(chunks, run, DIGEST, [False] * len(metrics), 2_000)


def merged(parts: DataFrame, delta: int = 1000, fan: int = FAN) -> DataFrame:
    """One digest per source and metric: ``(k, metric, n, lo, hi, means, weights)``, of any number of digests.

    ``parts`` are stored, and the largest group is counted; while it has more than ``fan``, its digests are dealt
    out and merged in shares of about ``fan``, so that no task meets more of one source at once. A
    job runs for each such round when this is called. Tables without rows give none."""
    parts = durable(parts.select("k", "metric", "n", "lo", "hi", "means", "weights"))
    largest = parts.groupBy("k", "metric").count().agg(F.max("count")).first()[0] or 0
    while largest > fan:
        largest = math.ceil(largest / fan)
        # the stored table's rows keep their numbers, whatever is computed again
        parts = durable(_merge(parts.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(largest))), ["k", "metric", "share"], delta))
    return _merge(parts, ["k", "metric"], delta)


def _merge(parts: DataFrame, by: Sequence[str], delta: int) -> DataFrame:
    """One digest for each group of ``by``; a task holds one group, or a batch of small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            at = int(np.flatnonzero(starts(*[codes(t[c])[0] if c != "share" else t[c].to_numpy() for c in by]))[-1]) if t.num_rows else 0
            if at:  # all groups but the last are complete
                yield from cluster_table(t.slice(0, at)).to_batches(max_chunksize=500)
                held = t.slice(at).to_batches()
        if sum(b.num_rows for b in held):
            yield from cluster_table(pa.Table.from_batches(held)).to_batches(max_chunksize=500)

    def cluster_table(t: pa.Table) -> pa.Table:
        k, names = codes(t["k"])
        metric, metrics = codes(t["metric"])
        new = starts(k, metric, *([t["share"].to_numpy()] if "share" in by else []))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        means = t["means"].combine_chunks()
        weights = t["weights"].combine_chunks()
        g = np.repeat(group, pc.list_value_length(means).to_numpy())
        m, w = means.flatten().to_numpy(), weights.flatten().to_numpy()
        order = np.lexsort((m, g))
        cg, m, w = clustered(g[order], m[order], w[order], delta)
        return pa.table({
            "k": pa.array([names[c] for c in k[at]], pa.string()), "metric": pa.array([metrics[c] for c in metric[at]], pa.string()), "n": np.add.reduceat(t["n"].to_numpy(), at),
            "lo": np.minimum.reduceat(floats(t["lo"]), at), "hi": np.maximum.reduceat(floats(t["hi"]), at), "means": lists(cg, len(at), m, pa.float64()), "weights": lists(cg, len(at), w, pa.int64())})

    shape = DIGEST.replace("part bigint, ", "")
    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, shape)


def estimates(group: np.ndarray, means: np.ndarray, weights: np.ndarray, groups: int, ps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each group (rows) and share (columns) the mean of the centroid in which the rank lies, so that the
    error is that centroid's weight at most, with ties as without (a line between centroids would leave
    both where values repeat). Shares 0 and 1 give the exact ends."""
    run = np.cumsum(weights)
    size = np.bincount(group, minlength=groups)
    last = np.cumsum(size) - 1
    before = np.append(0, run[last[:-1]])
    n = run[last] - before
    at = np.searchsorted(run, before[:, None] + n[:, None] * ps)
    e = means[np.minimum(at, last[:, None])]
    return np.where(ps <= 0, lo[:, None], np.where(ps >= 1, hi[:, None], e))


def quantiles(digest: DataFrame, ps: Sequence[float]) -> DataFrame:
    """``(k, metric, n, e)``: the ``estimates`` of one digest per source and metric for the shares ``ps``."""
    want = np.array(ps, float)

    def run(t: pa.Table) -> pa.Table:
        means = t["means"].combine_chunks()
        g = np.repeat(np.arange(t.num_rows), pc.list_value_length(means).to_numpy())
        e = estimates(g, means.flatten().to_numpy(), t["weights"].combine_chunks().flatten().to_numpy(), t.num_rows, want, floats(t["lo"]), floats(t["hi"]))
        return pa.table({"k": t["k"], "metric": t["metric"], "n": t["n"], "e": pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), len(want)).cast(pa.list_(pa.float64()))})

    return map_partition(digest, run, "k string, metric string, n bigint, e array<double>")


RANKS = "k string, metric string, p double, value double, n bigint, below bigint, up_to bigint"


def percentiles(df: DataFrame, ps: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), metrics: Sequence[str] = ("volume", "close"), delta: int = 1000, stated: float = 0.01, key: str = "enumstring", stamp: str = "datetime", order: str = "rowid") -> DataFrame:
    """``(key, metric, p, value, n, below, up_to, rank_error, within)`` per source, metric and share.

    ``value`` comes from the source's digest. ``below`` and ``up_to`` are the exact numbers of its
    readings below and not above ``value``; ``rank_error`` is the distance of ``p * n`` from that
    interval over ``n``, and ``within`` says whether it is no more than ``stated``, or than one reading
    (``1 / n``), if that is more. Null, NaN and infinite values are left out; empty input gives no
    rows. Jobs run when this is called: the chunks are stored."""
    metrics, ps = list(metrics), list(ps)
    chunks = packed(df, metrics, key=key, stamp=stamp, order=order)
    ends = durable(parts(chunks).select("k", "pid", "skip"))
    edge = joined(chunks.filter("edge"), ends)
    est = quantiles(merged(digests_of(edge, metrics, delta, None), delta), ps)
    est = ends.join(est.groupBy("k").agg(F.collect_list(F.struct("metric", "n", "e")).alias("est")), "k", "left")
    again = map_chunks(joined(chunks.filter("edge"), durable(est)), lambda c: ranks_of(c, metrics, ps), RANKS, [False] * len(metrics))
    again = again.groupBy("k", "metric", "p", "value", "n").agg(F.sum("below").alias("below"), F.sum("up_to").alias("up_to"))
    once = map_chunks(chunks.filter("not edge"), lambda c: ranks_at_once(c, metrics, ps, delta), RANKS, [False] * len(metrics))
    out = once.unionByName(again).withColumn("k", F.col("k").cast(df.schema[key].dataType)).withColumnRenamed("k", key)
    rank = F.col("p") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("below") - rank, rank - F.col("up_to")) / F.col("n")
    return out.withColumn("rank_error", error).withColumn("within", F.col("rank_error") <= F.greatest(F.lit(stated), 1 / F.col("n")))


def ranks_of(c: Chunk, metrics: Sequence[str], ps: Sequence[float]) -> Iterator[pa.Table]:
    """An edge chunk's counts for its source's estimates."""
    for x in c.row.get("est") or []:
        v = c.values[metrics.index(x["metric"])]
        v = np.sort(v[np.isfinite(v)])
        yield _ranks([c.row["k"]], x["metric"], ps, np.array([x["e"]]), np.array([x["n"]]), np.searchsorted(v, x["e"])[None], np.searchsorted(v, x["e"], side="right")[None])


def ranks_at_once(c: Chunk, metrics: Sequence[str], ps: Sequence[float], delta: int) -> Iterator[pa.Table]:
    """Digests, estimates and counts of sources that lie in this chunk alone."""
    for i, metric in enumerate(metrics):
        g, x = sorted_values(c, i, c.s)
        if not len(x):
            continue
        there, g = np.unique(g, return_inverse=True)
        first = np.flatnonzero(starts(g))
        n = np.diff(np.append(first, len(g)))
        cg, m, w = clustered(g, x, np.ones(len(x), np.int64), delta)
        e = estimates(cg, m, w, len(there), np.array(ps, float), x[first], x[first + n - 1])
        below, up_to = (np.stack([np.bincount(g[op(x, e[g, j])], minlength=len(there)) for j in range(len(ps))], 1) for op in (np.less, np.less_equal))
        yield _ranks([c.names[j] for j in there], metric, ps, e, n, below, up_to)


def _ranks(names: list[str], metric: str, ps: Sequence[float], e: np.ndarray, n: np.ndarray, below: np.ndarray, up_to: np.ndarray) -> pa.Table:
    q = len(ps)
    return pa.table({
        "k": pa.array(np.repeat(np.array(names, object), q), pa.string()), "metric": pa.array([metric] * (len(names) * q), pa.string()), "p": np.tile(np.array(ps, float), len(names)),
        "value": e.ravel(), "n": np.repeat(n, q).astype(np.int64), "below": below.ravel().astype(np.int64), "up_to": up_to.ravel().astype(np.int64)})
