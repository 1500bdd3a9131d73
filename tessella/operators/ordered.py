"""Ordered passes: rows range-partitioned by source and time, processed partition by partition.

A source that holds a large share of all rows is simply spread over several partitions, because
the range includes the time (and, where copies are kept, the row id). What a row needs from its
neighbours beyond the partition's ends travels as a few values per partition edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def range_ordered(df: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``df`` in ``parts`` contiguous ranges of ``by``, each sorted. A fixed number keeps adaptive
    execution from merging partitions, so that partition numbers mean the same in each pass."""
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def map_partition(df: DataFrame, fn: Callable[[pa.Table], pa.Table | None], schema: str, chunk: int = 20_000) -> DataFrame:
    """``fn`` applied to each whole partition as one Arrow table (empty partitions are skipped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            out = fn(pa.Table.from_batches(got))
            if out is not None:
                yield from out.to_batches(max_chunksize=chunk)

    return df.mapInArrow(run, schema)


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Integer codes of a string column, and the values by code."""
    d = column.combine_chunks().dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles with null as NaN."""
    return column.cast(pa.float64()).to_numpy().astype(np.float64, copy=False)


def starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any of the keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
