"""Packing texts into containers of fixed capacity, balanced by cost."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import map_partition


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (sizes from 1 to ``capacity``, descending). A container's cost is the
    sum of ``n + n * n / capacity`` over its items; an item goes to the container of lowest cost with
    room for it (of the lowest number, if costs are equal), out of as many as the total needs at
    least, or to a new one where none has room.

    Containers with room stand in a heap by cost, the others in one by room: as sizes only shrink, one
    that has no room now comes back once an item is small enough."""
    used = max(1, math.ceil(int(sizes.sum()) / capacity))
    fit: list[tuple[float, int, int]] = [(0.0, j, capacity) for j in range(used)]
    full: list[tuple[int, int, float]] = []
    out = np.zeros(len(sizes), np.int64)
    for i, (size, step) in enumerate(zip(sizes.tolist(), (sizes + sizes * sizes / capacity).tolist())):
        while full and -full[0][0] >= size:
            room, j, cost = heapq.heappop(full)
            heapq.heappush(fit, (cost, j, -room))
        # an item is no larger than those before, so what stands in the heap has room but for this check
        while fit and fit[0][2] < size:
            cost, j, room = heapq.heappop(fit)
            heapq.heappush(full, (-room, j, cost))
        if fit:
            cost, j, room = heapq.heappop(fit)
        else:
            cost, j, room, used = 0.0, used, capacity, used + 1
        out[i] = j
        heapq.heappush(fit, (cost + step, j, room - size))
    return out


def packed_shard(ids: pa.Array, sizes: np.ndarray, shard: int, packs: Sequence[tuple[str, int]]) -> list[pa.Table]:
    """Rows of one shard for each capacity: whole items, and the pieces of those above the capacity."""
    out = []
    by = np.argsort(-sizes, kind="stable")
    for kind, capacity in packs:
        full = sizes // capacity
        rest = sizes - full * capacity
        # full pieces fill a container each; what is left is an item
        rows = np.repeat(np.arange(len(sizes)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        item = by[rest[by] > 0]
        item = item[np.argsort(-rest[item], kind="stable")]
        where = assign(rest[item], capacity)
        opened = int(where.max()) + 1 if len(where) else 0
        empty = np.flatnonzero(sizes == 0)
        row = np.concatenate([item, rows, empty])
        container = np.concatenate([where, opened + np.arange(len(rows)), np.zeros(len(empty), np.int64)]) + (shard << 32)
        number = np.concatenate([full[item], piece, np.zeros(len(empty), np.int64)])
        count = np.concatenate([rest[item], np.full(len(rows), capacity), np.zeros(len(empty), np.int64)])
        out.append(pa.table({
            "pack_kind": pa.array([kind] * len(row), pa.string()), "k": ids.take(pa.array(row)), "piece": pa.array(number, pa.int64()),
            "first_token": pa.array(number * capacity, pa.int64()), "n_tokens": pa.array(count, pa.int64()), "container": pa.array(container, pa.int64(), mask=count == 0)}))
    return out


def numbered(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``copy``, a number from 0 among rows that agree in all ``columns``: such rows are counted
    map-side and written out again, in blocks of bounded size, which needs no order and no window."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    blocks = counts.select(*columns, "_n", F.explode(F.expr("sequence(0L, _n - 1, 10000L)")).alias("_b"))
    return blocks.select(*columns, F.explode(F.sequence("_b", F.least(F.col("_b") + 9_999, F.col("_n") - 1))).alias("copy"))


def pack(sized: DataFrame, packs: Sequence[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens", items: int = 0, per_shard: int = 20_000) -> DataFrame:
    """``(pack_kind, key, piece, first_token, n_tokens, container)`` for every row and capacity.

    Rows are spread evenly over shards of about ``per_shard`` by a hash, and each shard is packed by
    itself, so that a container's number is unique within its kind and the space lost by sharding is
    less than a container each. ``items`` is the number of rows (0: it is counted). An item above
    the capacity is cut into full containers and one rest; others are whole. Items of size 0 or null
    have no container. Rows of equal key and size are numbered, so that copies are spread over the
    shards too; what comes out depends on keys and sizes alone, not on how the rows are split."""
    if any(c < 1 for _, c in packs):
        raise ValueError("capacities are at least 1")
    shards = max(1, math.ceil((items or sized.count()) / per_shard))
    kind = sized.schema[key].dataType.simpleString()
    rows = sized.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    rows = numbered(rows, ["k", "n"]).withColumn("shard", F.pmod(F.xxhash64("k", "n", "copy"), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        shard, n = t["shard"].to_numpy(), t["n"].to_numpy()
        ids = t["k"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        out = []
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            out += packed_shard(ids.take(pa.array(mine)), n[mine], int(s), packs)
        return pa.concat_tables(out)

    spread = rows.repartition(shards, "shard").sortWithinPartitions("shard", "n", "k")
    out = map_partition(spread, run, f"pack_kind string, k {kind}, piece bigint, first_token bigint, n_tokens bigint, container bigint")
    return out.withColumnRenamed("k", key)


def fill(packed: DataFrame, packs: Sequence[tuple[str, int]]) -> DataFrame:
    """Per kind: containers used, the fewest that could hold the tokens, and the share of space filled."""
    spark = packed.sparkSession
    sizes = spark.createDataFrame(list(packs), "pack_kind string, capacity_tokens bigint")
    used = packed.filter("container is not null").groupBy("pack_kind", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    total = used.groupBy("pack_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum("items").alias("pieces"))
    out = sizes.join(total, "pack_kind", "left")
    return out.select("pack_kind", "capacity_tokens", F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("fullest", F.lit(0)).alias("fullest"),
                      F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
