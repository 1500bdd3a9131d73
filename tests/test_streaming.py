"""Streams give what the batch operators give on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella import session as S
from tessella.operators.joins import asof_join
from tessella.streaming import streams
from tests.conftest import rows

KIND = "id long, k string, t timestamp_ntz, v double"


@pytest.fixture()
def feed(spark, tmp_path):
    """Three files of events in order of time, and a last one that moves the watermark on."""
    rng, data = random.Random(2), []
    for i in range(90):
        data.append((i, rng.choice("ab"), datetime(2021, 1, 1) + timedelta(seconds=60 * i + rng.randint(0, 50)), float(i)))
    for n in range(3):
        spark.createDataFrame(data[30 * n:30 * n + 30], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(900, "a", datetime(2021, 3, 1), 0.0), (901, "b", datetime(2021, 3, 1), 0.0)]
    spark.createDataFrame(end, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, 1)
    return stream, spark.createDataFrame(data, KIND)


def run(df, spark, mode="append"):
    out = S.scratch(spark)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", S.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_bars_and_sessions(spark, feed):
    stream, data = feed
    got = run(streams.stream_bars(stream, "t", "10 minutes", {"n": F.count("*"), "s": F.sum("v")}, ["k"], late="30 days"), spark)
    want = data.groupBy(F.window(F.col("t").cast("timestamp"), "10 minutes").start.cast("timestamp_ntz").alias("bar"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert rows(got.filter("bar < '2021-02-01'")) == rows(want)
    s = run(streams.stream_sessions(stream, "t", "30 days", {"n": F.count("*")}, ["k"], late="1 day"), spark)
    assert rows(s.filter("begins < '2021-02-01'"), "k", "n") == rows(data.groupBy("k").agg(F.count("*").alias("n")))


def test_distinct_and_upsert(spark, feed, tmp_path):
    stream, data = feed
    assert run(streams.stream_distinct(stream.filter("id < 900"), "t", ["k"], "90 days").select("k"), spark).count() == 2
    path = str(tmp_path / "state")
    for _ in range(2):  # the second run meets the table of the first
        q = stream.drop("arrived_at").writeStream.foreachBatch(streams.upsert_into(path, ["k"], "id")).option("checkpointLocation", S.scratch(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(streams.upserted(spark, path), "k", "id") == [("a", 900), ("b", 901)]


def test_asof_on_streams(spark, feed):
    stream, data = feed
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(streams.stream_asof(stream.filter("id % 3 = 0 or id >= 900"), stream.filter("id % 3 = 1 or id >= 900"), "k", "t", "id", "v", "id", "1 minute"), spark)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = asof_join(data.filter("id % 3 = 0").select("id", "k", "t"), data.filter("id % 3 = 1").select("k", "t", "v"), "k", "t")
    assert rows(got.filter("id < 900"), "id", "value") == rows(want, "id", "v")


def test_asof_ties_and_nulls(spark, tmp_path):
    """Right rows of equal time count by their order, null values are values; over several batches with late rows."""
    rng, t0 = random.Random(5), datetime(2021, 1, 1)
    data = [(i, rng.choice("ab"), t0 + timedelta(seconds=20 * (i // 4) + rng.choice([0, 0, -30])), rng.choice([None, float(i), -float(i)])) for i in range(120)]
    for n in range(4):
        spark.createDataFrame(data[30 * n:30 * n + 30], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(900, "a", datetime(2021, 3, 1), 0.0), (901, "b", datetime(2021, 3, 1), 0.0)], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, whole = streams.ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, 1), spark.createDataFrame(data, KIND)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(streams.stream_asof(stream.filter("id % 2 = 0 or id >= 900"), stream.filter("id % 2 = 1 or id >= 900"), "k", "t", "id", "v", "id", "2 minutes"), spark)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = asof_join(whole.filter("id % 2 = 0").select("id", "k", "t"), whole.filter("id % 2 = 1").select("k", "t", "v", F.col("id").alias("o")), "k", "t", "o")
    assert rows(got.filter("id < 900"), "id", "value") == rows(want, "id", "v")


def answered(spark, left, right, **more):
    """The answers, and the most values that were in state after a batch."""
    out = S.scratch(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = streams.stream_asof(left, right, "k", "t", "id", "v", "id", **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", S.scratch(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out), max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators)


def test_asof_of_many_keys(spark, tmp_path):
    """State has values by buckets and pieces, not by keys and rows, whose calls would take all the time."""
    rng, t0, kind = random.Random(7), datetime(2021, 1, 1), "id long, k double, t timestamp_ntz, v double"
    keys = [None, 0.0, -0.0, *map(float, range(1, 3000))]
    data = [(2**53 + i, rng.choice(keys), t0 + timedelta(seconds=i + rng.randint(-1800, 0)), float(i)) for i in range(24_000)]
    for n in range(3):
        spark.createDataFrame(data[8000 * n:8000 * n + 8000], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, 0.0, datetime(2021, 3, 1), 0.0), (1, 0.0, datetime(2021, 3, 1), 0.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, whole = streams.ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, 1), spark.createDataFrame(data, kind)
    got, most = answered(spark, stream.filter("id % 3 = 0"), stream.filter("id % 3 > 0"), late="2 hours", buckets=3)
    want = asof_join(whole.filter("id % 3 = 0").select("id", "k", "t"), whole.filter("id % 3 > 0").select("k", "t", "v", F.col("id").alias("o")), "k", "t", "o")
    assert rows(got.filter("id > 1"), "id", "value") == rows(want, "id", "v")
    assert most < 100


def test_asof_of_odd_rows(spark, tmp_path):
    """Rows without id, key or time, and keys that are stamps."""
    t, day, kind = datetime(2021, 1, 1), lambda n: datetime(2020, 1, n), "id long, k timestamp_ntz, t timestamp_ntz, v double, s int"
    data = [(1, day(1), t, 1.0, 0), (2, day(12), t, 2.0, 0), (3, None, t, 3.0, 0), (4, day(1), None, 4.0, 0), (5, day(2), None, 5.0, 0), (None, day(1), t, 6.0, 0), (None, day(7), t, 7.0, 0)]
    data += [(11, day(1), t, None, 1), (None, day(12), t, None, 1), (13, None, t, None, 1), (14, day(1), None, None, 1), (15, day(2), t, None, 1), (16, day(7), t, None, 1), (17, day(8), t, None, 1)]
    spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(900, None, datetime(2021, 3, 1), 0.0, s) for s in (0, 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, 1)
    got, _ = answered(spark, stream.filter("s = 1"), stream.filter("s = 0"))
    want = [(None, 2.0), (11, 1.0), (13, 3.0), (14, 4.0), (15, 5.0), (16, 7.0), (17, None)]
    assert rows(got.filter("id is null or id < 900"), "id", "value") == want
    assert rows(got.filter("us is null"), "id", "value") == [(14, 4.0)]
