"""Streams with the batch operators' semantics: bars, deduplication, upsert, as-of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.tables import upsert


def ticks(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None, files: str = "*.parquet") -> DataFrame:
    """The parquet files of a folder as a stream, with the time of arrival."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", files)
    r = r.option("maxFilesPerTrigger", per_batch) if per_batch else r
    return r.parquet(path).withColumn("arrived_at", F.current_timestamp())


def socket_ticks(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """JSON records from a socket, for trying things out; sockets can't be replayed."""
    raw = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*").withColumn("arrived_at", F.current_timestamp())


def stream_bars(df: DataFrame, stamp: str, width: str, aggs: dict[str, Column], keys: list[str] | None = None, late: str = "10 minutes", slide: str | None = None, origin: str | None = None) -> DataFrame:
    """Tumbling bars (sliding ones with ``slide``) per key; rows later than ``late`` are dropped. ``origin``
    moves the bars' start, as for batch bars with an explicit origin."""
    w = F.window(stamp, width, slide or width, origin)
    return df.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).groupBy(w.alias("w"), *(keys or [])).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("w.start").cast("timestamp_ntz").alias("bar"), *(keys or []), *aggs)


def stream_sessions(df: DataFrame, stamp: str, gap: str, aggs: dict[str, Column], keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    s = df.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return s.groupBy(F.session_window(stamp, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("w.start").cast("timestamp_ntz").alias("begins"), F.col("w.end").cast("timestamp_ntz").alias("ends"), *keys, *aggs)


def stream_distinct(df: DataFrame, stamp: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


BUCKET = "_bucket"


def upsert_into(path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each micro-batch into the stored table at ``path``, which is
    cut into ``buckets`` by a hash of the keys: only those that a batch meets are read and written
    again. A batch that is replayed gives the same table, also after a failure half-way. Read it with
    ``upserted``."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        there = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path))
        last = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last = last.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        met = [r[0] for r in last.select(BUCKET).distinct().collect()]
        if there and met:
            old = spark.read.parquet(path).filter(F.col(BUCKET).isin(met))
            out = upsert(old.select(*last.columns), last, keys, order)
        else:
            out = last
        if met:
            out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        last.unpersist()

    return run


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_into`` keeps."""
    return spark.read.parquet(path).drop(BUCKET)


ANSWER = "id long, us long, value double"
#: A row in state; side is 0 on the right, 1 on the left and 2 for a left row without id, n the right row's order or the left row's id.
ROW = pa.schema([("k", pa.string()), ("us", pa.int64()), ("side", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])
PIECE = 2_000  # rows a value of state
NEVER = -(2**62)  # the microseconds of rows without time


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ROW) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


class LastBefore(StatefulProcessor):
    """As-of join on a stream of both sides, for all keys of one bucket at once: in state are the rows not yet
    passed by the watermark, in pieces by time of which only those are read that hold a row that is due,
    and each key's latest right row before. A left row is answered once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "piece long", "rows binary")
        self.index = handle.getValueState("index", "timer long, next long, pieces array<long>, least array<long>")
        self.last = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pa.concat_tables([pa.Table.from_pandas(pdf[ROW.names], ROW, preserve_index=False) for pdf in rows])
        yield self._passed(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._passed(ROW.empty_table(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _passed(self, new: pa.Table, mark: int, fired: int = -1) -> pd.DataFrame:
        """Takes ``new`` rows into state and answers what the watermark has passed; a timer that has fired deletes itself."""
        timer, free, pieces, least = self.index.get() or (-1, 0, [], [])
        held, before = dict(zip(pieces, least)), mark * 1000
        read = [n for n, us in held.items() if us < before]
        rows = pa.concat_tables([new, *[_unpacked(self.pieces.getValue((n,))[0]) for n in read]])
        for n in read:
            self.pieces.removeKey((n,))
            del held[n]
        us = rows["us"].to_numpy()
        order = np.argsort(us, kind="stable")
        cut = int(np.searchsorted(us[order], before))
        rest, us = rows.take(order[cut:]), us[order[cut:]]
        for a in range(0, len(us), PIECE):
            self.pieces.updateValue((free,), (_packed(rest.slice(a, PIECE)),))
            held[free] = int(us[a])
            free += 1
        first = min(held.values()) // 1000 + 1 if held else -1
        if first != timer:
            if timer not in (-1, fired):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(first)
        self.index.update((first, free, list(held), list(held.values())))
        return self._answers(rows.take(order[:cut]))

    def _answers(self, due: pa.Table) -> pd.DataFrame:
        known = self.last.get() if len(due) else None
        both = pa.concat_tables([due, *([_unpacked(known[0])] if known else [])]).combine_chunks()
        k = pa.chunked_array(both["k"].chunks, pa.string()).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        us, side, n, value = (both[c].to_numpy() for c in ("us", "side", "n", "value"))
        order = np.lexsort((n, side, us, k))
        k, us, side, n, value = (x[order] for x in (k, us, side, n, value))
        at, left = np.arange(len(k)), side > 0
        change = np.append(True, k[1:] != k[:-1])[:len(k)]
        hit = np.maximum.accumulate(np.where(left, -1, at))  # the last right row up to each row
        found = hit >= np.maximum.accumulate(np.where(change, at, 0))
        seen = np.where(found, value[hit], np.nan)
        if not left.all():
            end = np.append(change[1:], True)
            self.last.update((_packed(both.take(order[hit[end & found]])),))
        return pd.DataFrame({"id": pd.arrays.IntegerArray(n[left], side[left] == 2), "us": pd.arrays.IntegerArray(us[left], us[left] == NEVER), "value": seen[left]})


def stream_asof(left: DataFrame, right: DataFrame, key: str, stamp: str, id_: str, value: str, order: str, late: str = "10 minutes", buckets: int = 512) -> DataFrame:
    """Each left row's ``id_`` and time with the last right ``value`` of the same key at or before it, emitted
    when the watermark has passed the row; of right rows of equal time the last by ``order`` counts, as in
    the batch join. A null or NaN value counts as a value and comes out as null. Rows without time are the
    smallest, and are answered in their batch. Needs the RocksDB state store.

    State is kept in ``buckets`` by a hash of the key: a bucket's rows of a batch, and the latest right
    rows of all its keys, are in memory at once, so more keys need more buckets. They can't be changed
    for a checkpoint that exists."""
    def side(df: DataFrame, n: int) -> DataFrame:
        t, number = F.col(stamp).cast("timestamp"), F.col(id_ if n else order).cast("bigint")
        return df.select(F.col(key).alias("k"), t.alias("t"), F.coalesce(F.unix_micros(t), F.lit(NEVER)).alias("us"), (F.when(number.isNull(), 2).otherwise(1) if n else F.lit(0)).cast("bigint").alias("side"), F.coalesce(number, F.lit(-(2**63) if not n else 0)).alias("n"), (F.lit(None) if n else F.col(value)).cast("double").alias("value"))

    both = side(left, 1).unionByName(side(right, 0))
    kind = both.schema["k"].dataType
    if isinstance(kind, T.NumericType | T.BooleanType | T.DatetimeType | T.BinaryType) or kind == T.StringType():
        k = F.hex("k") if isinstance(kind, T.BinaryType) else F.col("k") + F.lit(0).cast(kind) if isinstance(kind, T.FloatType | T.DoubleType) else F.col("k")  # -0.0 is 0.0
        both = both.withColumn("k", k.cast("string")).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    else:  # a bucket for each key: collated strings may be equal and differ as text; Spark has no nested keys here
        both = both.withColumnRenamed("k", "b").withColumn("k", F.lit(None).cast("string"))
    out = both.withWatermark("t", late).groupBy("b").transformWithStateInPandas(LastBefore(), ANSWER, "Append", "EventTime")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
