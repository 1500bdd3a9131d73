"""Readings in packed chunks: the common form of the passes over a source's readings in order of time.

Rows are range-partitioned by source *and time*, once, so that a source of any share is spread over
many ranges, and each range is stored as at most three rows: the part of its first source, the part
of its last, and all sources between, which lie in this range alone. A chunk has its times and values
as plain arrays, so that later passes move bytes rather than rows. What a pass needs of a source's
other chunks comes as a few values per chunk, by windows and joins over a table with one row for each
part of a source: nothing is collected, and nothing that grows is sent along with a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ordered import codes, floats, map_partition, range_ordered, starts
from tessella.operators.readings import denan, valid_readings, wall_us
from tessella.session import durable, range_parts

#: Readings of a range: about 20 MB of times and four values.
ROWS = 500_000


class Chunk:
    """A chunk's readings: source codes ``s`` into ``names``, times ``us``, ``values`` (doubles with NaN for
    null, or whole numbers with ``some`` for those that are not null), and the row's other columns."""

    def __init__(self, row: dict, whole: Sequence[bool]):
        self.row = row
        self.names = row["names"]
        sizes = np.asarray(row["sizes"], np.int64)
        n = int(sizes.sum())
        self.s = np.repeat(np.arange(len(sizes)), sizes)
        self.us = np.frombuffer(row["us"], np.int64)
        self.values, self.some = [], []
        for i, w in enumerate(whole):
            raw = row[f"v{i}"]
            self.values.append(np.frombuffer(raw, np.int64 if w else np.float64, n))
            self.some.append(np.frombuffer(raw, bool, n, 8 * n) if w else None)
        if row.get("skip"):  # the first reading is a copy of the last one of the chunk before
            self.s, self.us, self.values, self.some = self.s[1:], self.us[1:], [v[1:] for v in self.values], [x if x is None else x[1:] for x in self.some]


def listed(rows: Sequence[dict | None], kind: pa.StructType) -> pa.Array:
    """A column of lists of structs from one dict of arrays per row."""
    sizes = [0 if r is None else len(next(iter(r.values()))) for r in rows]
    there = [r for r in rows if r is not None]
    cols = [pa.array(np.concatenate([r[f.name] for r in there]) if there else [], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays(cols, fields=list(kind)))


def _pack(t: pa.Table, whole: Sequence[bool], extra: Callable | None, kinds: Sequence[pa.StructType]) -> pa.Table:
    k, names = codes(t["k"])
    us = t["t_us"].to_numpy()
    keep = starts(k, us)
    k, us = k[keep], us[keep]
    values, some = [], []
    for i, w in enumerate(whole):
        c = t[f"v{i}"]
        values.append((c.fill_null(0).to_numpy() if w else floats(c))[keep])
        some.append(~np.asarray(c.is_null())[keep] if w else None)
    first = np.flatnonzero(starts(k))
    m = len(first)
    cuts = np.append(first, len(k))
    parts = [(0, 1)] + ([(1, m - 1)] if m > 2 else []) + ([(m - 1, m)] if m > 1 else [])
    pid = TaskContext.get().partitionId() if TaskContext.get() else 0
    rows = []
    for a, e in parts:
        lo, hi = cuts[a], cuts[e]
        row = {"pid": pid, "edge": e == a + 1 and (a == 0 or e == m), "names": [names[k[x]] for x in first[a:e]], "sizes": np.diff(cuts[a:e + 1]).astype(np.int32), "us": us[lo:hi].tobytes()}
        row["k"] = row["names"][0] if row["edge"] else ""
        row["first_us"], row["last_us"] = (int(us[lo]), int(us[hi - 1])) if row["edge"] else (None, None)
        for i, w in enumerate(whole):
            row[f"v{i}"] = values[i][lo:hi].tobytes() + (some[i][lo:hi].tobytes() if w else b"")
        rows.append(row)
    cols = {c: [r[c] for r in rows] for c in rows[0]}
    out = {"pid": pa.array(cols["pid"], pa.int32()), "edge": pa.array(cols["edge"]), "k": pa.array(cols["k"], pa.string()), "first_us": pa.array(cols["first_us"], pa.int64()), "last_us": pa.array(cols["last_us"], pa.int64()),
           "names": pa.array(cols["names"], pa.list_(pa.string())), "sizes": pa.array(cols["sizes"], pa.list_(pa.int32())), "us": pa.array(cols["us"], pa.large_binary()).cast(pa.binary())}
    out |= {f"v{i}": pa.array(cols[f"v{i}"], pa.binary()) for i in range(len(whole))}
    if extra:
        got = [extra(Chunk(r, whole)) if r["edge"] else None for r in rows]
        for j, kind in enumerate(kinds):
            out[f"x{j}"] = listed([None if g is None else g[j] for g in got], kind)
    return pa.table(out)


def _ddl(kind: pa.StructType) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string"}
    return "array<struct<" + ", ".join(f"{f.name}: {names[f.type]}" for f in kind) + ">>"


def packed(df: DataFrame, values: Sequence[str], whole: Sequence[bool] | None = None, extra: Callable | None = None, kinds: Sequence[pa.StructType] = (), key: str = "enumstring", stamp: str = "datetime", order: str = "rowid", rows: int = ROWS) -> DataFrame:
    """The readings of ``df`` in chunks ``(pid, edge, k, first_us, last_us, names, sizes, us, v0, ...)``,
    stored in the shared folder.

    ``pid`` is the number of the range. ``edge`` chunks hold one source, ``k``, which may go on in other
    ranges; the others hold whole sources. Readings of equal source and stamp are one (the smallest
    ``order`` counts); a copy at the start of the next range is left to ``joined`` to skip. Values
    are doubles, or whole numbers where ``whole`` says so. ``extra`` gives for each edge chunk one
    dict of arrays for each of ``kinds``, stored as the columns ``x0``, ``x1``, ... Empty input gives no rows.
    Jobs run when this is called."""
    whole = list(whole or [False] * len(values))
    first = F.coalesce(F.col(order), F.lit(2**63 - 1))
    r = valid_readings(df, key, stamp).select(F.col(key).cast("string").alias("k"), wall_us(F.col(stamp)).alias("t_us"), first.alias("o"), *[denan(df, v).cast("bigint" if w else "double").alias(f"v{i}") for i, (v, w) in enumerate(zip(values, whole))])
    ranges = range_ordered(r, ["k", "t_us", "o"], range_parts(df, rows)).drop("o")
    schema = "pid int, edge boolean, k string, first_us bigint, last_us bigint, names array<string>, sizes array<int>, us binary" + "".join(f", v{i} binary" for i in range(len(values))) + "".join(f", x{j} {_ddl(k)}" for j, k in enumerate(kinds))
    return durable(map_partition(ranges, lambda t: _pack(t, whole, extra, kinds), schema))


def parts(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row for each part of a source that may lie in several ranges: ``(k, pid, prev_us, *columns)``, with
    the time of its last reading before; a copy of that reading at the start has to be skipped."""
    w = W.partitionBy("k").orderBy("pid")
    return chunks.filter("edge").select("k", "pid", "first_us", *[c for c in columns if c != "first_us"], F.lag("last_us").over(w).alias("prev_us")).withColumn("skip", F.coalesce(F.col("prev_us") == F.col("first_us"), F.lit(False))).drop(*({"first_us"} - set(columns)))


def joined(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """``chunks`` with the columns of ``table``, which has one row per ``(k, pid)`` of edge chunks: few rows, stored
    so that Spark knows their size."""
    return chunks.join(table, ["k", "pid"], "left")


def map_chunks(chunks: DataFrame, fn: Callable[[Chunk], pa.Table | Iterator[pa.Table] | None], schema: str, whole: Sequence[bool], piece: int = 20_000) -> DataFrame:
    """``fn``, which gives a table, several or none, applied to each chunk."""
    whole = list(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = fn(Chunk({c: b.column(c)[i].as_py() for c in b.schema.names}, whole))
                for t in [out] if isinstance(out, pa.Table) else out or ():
                    if t.num_rows:
                        yield from t.to_batches(max_chunksize=piece)

    return chunks.mapInArrow(run, schema)
