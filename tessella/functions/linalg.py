"""Linear algebra on long-form matrices and on tables of observations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK = 256


def _blocks(m: DataFrame, rows: str, columns: str) -> DataFrame:
    """Entries of a long-form matrix by blocks of ``BLOCK`` by ``BLOCK``: ``(rows, columns, x)``."""
    place = lambda c: F.pmod(F.col(c).cast("bigint"), F.lit(BLOCK)).cast("int")
    number = lambda c: F.floor(F.col(c).cast("bigint") / BLOCK)
    cell = F.struct((place("i") * BLOCK + place("j")).alias("at"), F.col("v").cast("double").alias("v"))
    some = m.filter("i is not null and j is not null and v is not null")
    return some.groupBy(number("i").alias(rows), number("j").alias(columns)).agg(F.collect_list(cell).alias("x"))


def _dense(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """A block's values (equal places add up) and where it has entries."""
    at = x.field("at").to_numpy()
    out = np.bincount(at, x.field("v").to_numpy(), BLOCK * BLOCK).reshape(BLOCK, BLOCK)
    there = np.zeros(BLOCK * BLOCK)
    there[at] = 1
    return out, there.reshape(BLOCK, BLOCK)


def _products(batches):
    """Products of pairs of blocks, added up as far as one task meets those of the same place."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for i in range(b.num_rows):
            (x, p), (y, q) = _dense(b.column("x")[i].values), _dense(b.column("y")[i].values)
            k = b.column("bi")[i].as_py(), b.column("bj")[i].as_py()
            new = np.stack([x @ y, p @ q])
            held[k] = held[k] + new if k in held else new
            if len(held) > 32:
                yield _packed(held)
                held = {}
    if held:
        yield _packed(held)


def _sums(batches):
    """Sums of the products of one place, which come one after the other."""
    key, total = None, None
    for b in batches:
        for i in range(b.num_rows):
            k = b.column("bi")[i].as_py(), b.column("bj")[i].as_py()
            new = np.frombuffer(b.column("x")[i].as_py()).reshape(2, BLOCK, BLOCK)
            if k != key and key is not None:
                yield _entries(key, total)
            key, total = k, new if k != key else total + new
    if key is not None:
        yield _entries(key, total)


def _packed(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["bi", "bj", "x"])


def _entries(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(total[1])
    return pa.RecordBatch.from_arrays([pa.array(i + key[0] * BLOCK), pa.array(j + key[1] * BLOCK), pa.array(total[0][i, j])], ["i", "j", "v"])


def mmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices in long form ``(i, j, v)``, whole indices from 0.

    Both are cut into square blocks, blocks meet by the inner index and are multiplied as dense
    arrays, and products of one place are added up within each task before they are shuffled. An
    entry comes out where at least one pair of entries meets; null entries count as missing."""
    x = _blocks(a, "bi", "k")
    y = _blocks(b, "k", "bj").withColumnRenamed("x", "y")
    parts = x.join(y, "k").select("bi", "bj", "x", "y").mapInArrow(_products, "bi bigint, bj bigint, x binary")
    out = parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_sums, "i bigint, j bigint, v double")
    return out.select(F.col("i").cast(a.schema["i"].dataType).alias("i"), F.col("j").cast(b.schema["j"].dataType).alias("j"), "v")


def matrix(df: DataFrame, most: int = 4_000) -> np.ndarray:
    """A small long-form matrix on the driver; a side above ``most`` (at 4,000, 128 MB) is refused."""
    n, m = df.agg(F.max("i"), F.max("j")).first()
    if n is None:
        return np.zeros((0, 0))
    if max(n, m) >= most:
        raise ValueError(f"a matrix of {n + 1} by {m + 1} is too large for the driver")
    out = np.zeros((n + 1, m + 1))
    for r in df.select("i", "j", "v").collect():
        out[r.i, r.j] = r.v
    return out


def long_form(df_of, values: np.ndarray) -> DataFrame:
    n, m = values.shape
    return df_of.createDataFrame([(i, j, float(values[i, j])) for i in range(n) for j in range(m)], "i int, j int, v double")


def minv(a: DataFrame) -> DataFrame:
    """Inverse of a small matrix, by least squares (so a singular one gives the pseudo-inverse)."""
    return long_form(a.sparkSession, np.linalg.pinv(matrix(a), rcond=1e-6))


def lsq(df: DataFrame, target: str, columns: Sequence[str], intercept: bool = False) -> list[float]:
    """Least-squares coefficients of ``target`` on the columns (intercept first).

    Each partition reduces its rows to the triangular factor of a QR decomposition, and the factors
    are reduced again; the last is solved by singular values, of which those below 1e-6 of the
    largest count as 0. One pass, and only triangles of the number of columns move. Rows with a null
    or NaN are left out; without rows all coefficients are 0."""
    names = [*columns, target]
    width = len(names) + intercept

    def triangle(blocks):
        held = np.zeros((0, width))
        for b in blocks:
            x = np.column_stack([np.asarray(b.column(i).to_pandas(), float) for i in range(len(names))]) if b.num_rows else np.zeros((0, len(names)))
            x = x[np.isfinite(x).all(axis=1)]
            if intercept:
                x = np.column_stack([np.ones(len(x)), x])
            held = np.linalg.qr(np.vstack([held, x]), mode="r")
        return held

    def run(batches):
        r = triangle(batches)
        yield pa.RecordBatch.from_arrays([pa.array(r.ravel().tolist(), pa.float64()), pa.array(np.repeat(np.arange(len(r)), width), pa.int64())], ["v", "row"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, "v double, row bigint")
    # a triangle has at most as many rows as columns: what reaches the driver is bounded by partitions
    v = np.array([r.v for r in rows.toLocalIterator()]).reshape(-1, width)
    if not len(v):
        return [0.0] * (width - 1)
    r = np.linalg.qr(v, mode="r")
    return np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=1e-6)[0].tolist()
