"""Table operators: joins, order, changes and storage on literal cases and against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import atlas, joins, moving, ranges, tables
from tessella.schema import meta_table, nan_to_null, sanitise, type_of, uncollide
from tessella.sources import delimited, store
from tests.conftest import rows


def test_left_join_takes_the_first(spark):
    x = spark.createDataFrame([(i, a) for i, a in enumerate([3, 1, 6, 2, 6, 4, 6, 3, None])], "i int, a int")
    y = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(zip([6, 0, 7, 5, 2, 1, 1, 6, None], [78, 28, 20, 76, 20, 41, 67, 61, 5]))], "i int, a int, c int")
    j = joins.left_join(x, y, "a", "i")
    assert j.columns == ["i", "a", "i1", "c"]
    assert [r.c for r in j.orderBy("i").collect()] == [None, 41, 78, 20, 78, None, 78, None, 5]
    t = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (3, 40)], "a int, b int")
    u = spark.createDataFrame([(2, 1.5), (3, 1.5)], "z int, c double")
    assert [r.c for r in joins.left_join(t, u, {"a": "z"}, "c").orderBy("b").collect()] == [None, 1.5, 1.5, 1.5]
    assert joins.inner_join(t, u, {"a": "z"}, "c").count() == 3
    assert joins.semi_join(x, y, "a").count() == 6 and joins.anti_join(x, y, "a").count() == 3
    assert joins.left_join(x, y.limit(0), "a", "i").filter("c is null").count() == 9


def clock(s):
    return datetime.fromisoformat("2020-01-01T" + s)


@pytest.mark.parametrize("split", [False, True])
def test_asof_join(spark, split):
    trades = spark.createDataFrame([(clock(t), s) for t, s in zip(["07:00", "08:30", "09:59", "10:00", "12:00", "16:00"], "aaaaba")], "time timestamp_ntz, sym string")
    quotes = spark.createDataFrame([(i, clock(f"{8 + i:02}:00"), s, b) for i, (s, b) in enumerate(zip("ababbaba", [1.0, 9.0, 2.0, 8.0, 8.5, 3.0, 7.0, 4.0]))], "i int, time timestamp_ntz, sym string, bid double")
    j = joins.asof_join(trades, quotes, "sym", "time", "i", split=split)
    assert j.columns == ["time", "sym", "i", "bid"]
    assert [r.bid for r in j.orderBy("time").collect()] == [None, 1.0, 1.0, 2.0, 8.5, 4.0]
    t = spark.createDataFrame([(10,), (20,), (30,), (40,)], "b int")
    u = spark.createDataFrame([(19, "A"), (17, "B"), (32, "C"), (8, "D")], "b int, c string")
    assert [r.c for r in joins.asof_join(t, u, None, "b").orderBy("b").collect()] == ["D", "A", "A", "C"]
    assert joins.asof_join(t, u.limit(0), None, "b").filter("c is null").count() == 4
    assert joins.asof_join(t.limit(0), u, None, "b").count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_asof_against_brute_force(spark, split):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key(), rng.choice([None, rng.randint(0, 50)])) for i in range(150)]
    right = [(i, key(), rng.choice([None, rng.randint(0, 50)]), None if rng.random() < 0.1 else i) for i in range(120)]
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "o int, k string, t int, v int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = {r.id: (r.o, r.v) for r in joins.asof_join(a, b, "k", "t", "o", split=split).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    low = lambda t: -1 if t is None else t
    for i, k, t in left:
        fits = [(low(u), o, v) for o, q, u, v in right if q == k and low(u) <= low(t)]
        assert got[i] == (max(fits)[1:] if fits else (None, None))


def test_order_without_one_task(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, float("nan"), rng.randint(0, 9) / 2])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, k string, x double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert [r.rank for r in ranges.with_rank(df, ["i"]).orderBy("i").collect()] == list(range(300))
    assert [r.bucket for r in ranges.bucketed(df, 7, ["i"]).orderBy("i").collect()] == [i * 7 // 300 for i in range(300)]
    clean = lambda x: None if x is None or x != x else x
    for keys in ([], ["k"]):
        for n in (1, 4, 90):
            got = {r.i: r for r in moving.moving(df, "msum", n, "x", ["i"], keys).collect()}
            mean = {r.i: r for r in moving.moving(df, "mavg", n, "x", ["i"], keys).collect()}
            for i, k, _ in data:
                near = [clean(x) for j, q, x in data if j <= i and (not keys or q == k)][-n:]
                some = [x for x in near if x is not None]
                assert got[i].msum == pytest.approx(sum(some))
                assert mean[i].mavg == (pytest.approx(sum(some) / len(some)) if some else None)
        run = {r.i: r.rsum for r in moving.running_sum(df, "x", ["i"], keys).collect()}
        for i, k, _ in data:
            assert run[i] == pytest.approx(sum(clean(x) or 0 for j, q, x in data if j <= i and (not keys or q == k)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    none = df.limit(0)
    assert ranges.with_rank(none, ["i"]).count() == moving.moving(none, "msum", 3, "x", ["i"]).count() == moving.running_sum(none, "x", ["i"]).count() == 0


def test_changes(spark):
    t = spark.createDataFrame([(1, 3, 5), (2, 4, 6), (3, 5, 7)], "a int, b int, c int")
    assert rows(tables.delete(t, (F.col("a") >= 1) & (F.col("b") >= 4))) == [(1, 3, 5)]
    u = spark.createDataFrame([(1,), (2,), (226,)], "a int")
    assert sorted(map(tuple, tables.update(u, [("b", F.col("a") * 2), ("c", F.col("b") * 2)]).collect())) == [(1, 2, 4), (2, 4, 8), (226, 452, 904)]
    assert rows(tables.update(t, [("b", F.lit(0)), ("c", F.col("b") + 1)], F.col("b") > 3)) == [(1, 3, 5), (2, 0, 1), (3, 0, 1)]
    with pytest.raises(ValueError):
        tables.update(t, [("d", F.lit(0))], F.col("b") > 3)
    g = spark.createDataFrame([(i, 0 if i < 3 else 1, i + 1) for i in range(6)], "i int, a int, b int")
    assert [r.c for r in tables.update_by(g, ["a"], {"c": F.sum("b")}).orderBy("i").collect()] == [6, 6, 6, 15, 15, 15]
    assert rows(tables.insert(t.select("a", "b"), spark.createDataFrame([(9,)], "a int"), ["a"])) == [(1, 3), (2, 4), (3, 5), (9, None)]
    for bad in (spark.createDataFrame([(9,)], "z int"), spark.createDataFrame([(9, 9)], "a int, b int")):
        with pytest.raises(ValueError):
            tables.insert(t, bad)


def test_upsert(spark):
    old = spark.createDataFrame([("x", 0), (None, 0), ("y", 0), ("y", 1)], "k string, i int")
    new = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), (None, 7), ("z", 1), ("z", 2), ("y", 9)], "k string, i int")
    got = rows(tables.upsert(old, new, ["k"], "i", "i"))
    assert got == [(None, 7), ("x", 3), ("y", 1), ("y", 9), ("z", 1), ("z", 2)]
    assert rows(tables.upsert(old.limit(0), new.limit(2), ["k"], "i")) == [("x", 1), ("x", 2)]
    rng = random.Random(0)
    state = {i: i for i in range(50)}
    df = spark.createDataFrame(list(state.items()), "k int, v int")
    for _ in range(2):
        batch = {rng.randint(0, 80): rng.randint(100, 999) for _ in range(30)}
        state |= batch
        df = tables.upsert(df, spark.createDataFrame(list(batch.items()), "k int, v int"), ["k"], "v")
    assert {r.k: r.v for r in df.collect()} == state


def test_positions_and_sets(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "A", None, "a", "B"])], "i int, x string")
    assert [r.x for r in tables.ascend(t, "x", ["i"]).collect()] == [None, "A", "a", "B", "b"]
    assert [r.x for r in tables.descend(t, "x", ["i"]).collect()] == ["b", "B", "a", "A", None]
    assert [r.i for r in tables.take(t, -2, ["i"]).collect()] == [4, 3] and [r.i for r in tables.top(t, 2, "i", ["x"]).collect()] == [4, 3]
    assert rows(tables.drop(t, 3, ["i"]), "i") == [(3,), (4,)] and rows(tables.drop(t, -3, ["i"]), "i") == [(0,), (1,)]
    assert rows(tables.cycle(t, 7, ["i"]), "place", "i") == [(p, p % 5) for p in range(7)] and tables.cycle(t.limit(0), 7, ["i"]).count() == 0
    assert [r.i for r in tables.rows_at(t, [4, 0, 4], ["i"]).collect()] == [4, 0, 4]
    assert [r.i for r in tables.reverse(t, ["i"]).collect()] == [4, 3, 2, 1, 0] and [r.x for r in tables.sort(t, ["x", "i"]).collect()][0] is None
    assert tables.deal(t, 3).distinct().count() == 3 and tables.shuffle(t).count() == 5
    d = spark.createDataFrame([(0, "q"), (1, "p"), (2, "q")], "i int, x string")
    assert [r.x for r in tables.distinct(d, ["x"], "i").collect()] == ["q", "p"] and rows(tables.part(d, "x", "i")) == [("p", [1]), ("q", [0, 2])]
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(2,), (3,), (None,)], "x int")
    assert rows(tables.union(a, b)) == [(None,), (1,), (2,), (3,)] and rows(tables.intersect(a, b)) == [(None,), (2,)] and rows(tables.except_(a, b)) == [(1,), (1,)]
    assert tables.same_table(a, a.repartition(2)) and not tables.same_table(a, b) and not tables.same_table(a, a.distinct())
    z = joins.zip_join(d, t, ["i"], ["i"])
    assert z.columns == ["i", "x", "i1", "x1"] and [r.x1 for r in z.orderBy("i").collect()] == ["b", "A", None]


def test_selection(spark):
    t = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "a int, b int")
    assert rows(tables.where_all(t, F.col("a") < 3, lambda agg: F.col("b") == agg(F.max("b"))), "a") == [(2,)]
    assert rows(tables.group(t, {"c": F.col("b") % 2}, n=F.count("*"))) == [(None, 1), (1, 3)]
    assert tables.extract(t.filter("a = 1").select("b")) == 5 and tables.extract(t.select("a")) == [1, 2, 3, 4] and tables.extract(t.filter("a=1")) == [1, 5] and tables.extract(t.limit(0)) == [[], []]
    x = tables.table(spark, ["a", "a", ""], [[1, 2], [5], ["x", "y"]])
    assert x.columns == ["a", "a1", "col"] and rows(x) == [(1, 5, "x"), (2, 5, "y")]
    with pytest.raises(ValueError):
        tables.table(spark, ["a", "b"], [[1, 2], [1, 2, 3]])
    s = tables.table_arithmetic(t, t.withColumnRenamed("b", "c"), lambda p, q: p + q, ["a"])
    assert s.columns == ["a", "b", "c"] and s.count() == 4


def test_atlas(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":4,"c":5}',), ('{"b":{"d":6,"e":7}}',), ("broken{",), (None,)], "j string")
    a = atlas.atlas(df, "j")
    assert [r.x for r in a.filter(atlas.key("b.d", "int") == 6).select(atlas.key("b.e", "int").alias("x")).collect()] == [7]
    assert rows(atlas.keys(a)) == [("a", 1), ("b", 3), ("c", 1)] and "b" in atlas.schema(a)
    b = atlas.atlas(spark.createDataFrame([('{"c":10,"b":4,"a":1}',), ('{"b":4,"c":10,"a":2}',), ('{"c":11,"b":5,"a":3}',)], "j string"), "j")
    g = tables.group(b.filter(atlas.key("a", "int") >= 2), {"c": atlas.key("c", "int")}, a=F.sum(atlas.key("a", "int")))
    assert rows(g) == [(10, 2), (11, 3)]


def test_schema():
    assert uncollide(["a", "a", "", "a1", ""]) == ["a", "a1", "col", "a11", "col1"]
    assert sanitise(["en,umstring", "9x", "x y", "x_y"]) == ["en_umstring", "_9x", "x_y", "x_y1"]
    assert type_of("*") is None and type_of("i").simpleString() == "bigint"
    with pytest.raises(ValueError):
        type_of("?")


def test_null_mapping(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string")
    assert rows(nan_to_null(df), "x") == [(None,), (1.0,)] and rows(meta_table(df), "name", "type") == [("s", "string"), ("x", "double")]


TEXT = 'open,"en,um",n,when,skip\r\n1.5,"a,""b\\"c",12x,2003.09.14T04:03:19.025,z\r\n\r\n,,,2003.09.14T04:03:19.1,z,more\r\n'


def test_headers_are_told_by_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("a,b\n1,x\na,b\n\n2,y\n")
    (tmp_path / "in/b.csv").write_text("\nc,d\n3,z\n")
    got = delimited.read_csv(spark, str(tmp_path / "in"), "SS")
    assert got.columns == ["a", "b"] and rows(got) == [("1", "x"), ("2", "y"), ("3", "z"), ("a", "b")]
    assert rows(delimited.read_csv(spark, str(tmp_path / "in"), "SS", header_rows=2)) == [("2", "y"), ("a", "b")]
    assert delimited.read_csv(spark, str(tmp_path / "in"), "SS", header_rows=0).count() == 6
    f = tmp_path / "fixed.txt"
    f.write_text("AB CD\nAB CD\nAB EF\n")
    assert rows(delimited.read_fixed(spark, str(f), "SS", [3, 2], header_rows=1)) == [("AB", "CD"), ("AB", "EF")]
    f.write_text("AB CD AB EF ")
    assert rows(delimited.read_fixed(spark, str(f), "SS", [3, 3], header_rows=1, newline_separated=False)) == [("AB", "EF")]
    f.write_text("AB CD AB E")
    with pytest.raises(Exception, match="[Pp]artial record"):
        delimited.read_fixed(spark, str(f), "SS", [3, 3], newline_separated=False).collect()


@pytest.mark.parametrize("split", [None, "7"])
def test_quoted_line_feeds(spark, tmp_path, split):
    f = tmp_path / "q.csv"
    f.write_text('a,b\n1,"x\ny,""q"" \\"\n z"\na,b\n\n2,"y\n\nw"\n3,q\n')
    if split:  # records across the splits of a file
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows(delimited.read_csv(spark, str(f), "SS", quoted_line_feeds=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [("1", 'x\ny,"q" "\n z'), ("2", "y\n\nw"), ("3", "q"), ("a", "b")]


def test_delimited_files(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes(TEXT.encode())
    df = delimited.read_csv(spark, str(f), "FSIZ*")
    assert df.columns == ["open", "en_um", "n", "when"]
    first, second = datetime(2003, 9, 14, 4, 3, 19, 25000), datetime(2003, 9, 14, 4, 3, 19)
    assert rows(df) == [(0.0, "", 0, second), (1.5, 'a,"b"c', 12, first)]
    with pytest.raises(Exception, match="too few fields"):
        delimited.read_csv(spark, str(f), "FSIZSSS").collect()
    g = tmp_path / "b.tsv"
    g.write_text("1\t2\n3\t4\n")
    assert delimited.read_tsv(spark, str(g), "ID", header_rows=0).columns == ["col", "col1"]
    assert delimited.read_tsv(spark, str(g), "ID", header_rows=0).count() == 2
    out = str(tmp_path / "table")
    assert delimited.create_table(spark, out, str(g), "\t", "II", 0).count() == 2
    assert delimited.append_table(spark, out, str(g), "\t", "II", 0).count() == 4
    p = str(tmp_path / "w")
    w = spark.createDataFrame([(1, 'x"y,z', 2.5), (2, "", None)], "a long, b string, c double")
    delimited.write_delimited(w, p, "|", ["a"], single=True)
    assert rows(delimited.read_psv(spark, p, "ISF")) == [(1, 'x"y,z', 2.5), (2, "", 0.0)]


def test_type_codes(spark):
    one = lambda code, s, **k: spark.createDataFrame([(s,)], "s string").select(delimited.convert(code, F.col("s"), **k)).first()[0]
    assert one("D", "1.23459") .__str__() == "1.2345" and one("D", "-1.23459").__str__() == "-1.2345"
    assert one("2", "7") == 7 and one("W", "-8z") == -8 and one("3", "x" * 50) == "x" * 32 and one("V", "1e2") == 100.0
    assert one("A", "1000000000000000") == datetime(1970, 1, 12, 13, 46, 40) and one("Q", "093001250") == ((9 * 60 + 30) * 60 + 1) * 1000 + 250
    assert one("R", "BRK   A         ") == "BRK.A" and one("R", "IBM             ") == "IBM"
    assert one("Z", "bad") is None and one("G", "550e8400-e29b") == "550e8400-e29b"


def test_fixed_width(spark, tmp_path):
    f = tmp_path / "f.txt"
    f.write_text("head\nab  1.5  12\ncd 22.5   7\n\n")
    df = delimited.read_fixed(spark, str(f), "SFI", [2, 5, 5], ["s", "f", "i"], header_rows=1)
    assert rows(df) == [("ab", 1.5, 12), ("cd", 22.5, 7)]
    g = tmp_path / "g.txt"
    g.write_text("ab01cd02ef03")
    assert rows(delimited.read_fixed(spark, str(g), "S*I", [1, 1, 2], newline_separated=False)) == [("a", 1), ("c", 2), ("e", 3)]
    assert delimited.create_table_fixed(spark, str(tmp_path / "t"), str(f), {"fields": "SFI", "widths": [2, 5, 5], "header_rows": 1}).count() == 2


def test_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, datetime(2020, 1, 1) + timedelta(hours=8 * i), float(i)) for i in range(6)], "i int, t timestamp_ntz, x double")
    p = str(tmp_path / "days")
    store.write_by_day(df, p, "t")
    agg = lambda d, keys: d.groupBy(*keys).agg(F.min("x").alias("low"))
    assert rows(store.select_by_day(spark, p, None, agg, per_day=True)) == [(0.0,), (3.0,)] and rows(store.select_by_day(spark, p, None, agg)) == [(0.0,)]
    assert rows(store.select_by_day(spark, p, F.col("date") == "2020-01-02", agg)) == [(3.0,)]
    assert "PartitionFilters: [isnotnull(date" in store.read_table(spark, p).filter("date = '2020-01-02'")._jdf.queryExecution().toString()
    q = str(tmp_path / "t")
    store.write_table(df, q, ["i"])
    assert store.replace(store.read_table(spark, q).filter("i > 3"), q).count() == 2 and store.read_table(spark, q).count() == 2
    v = str(tmp_path / "v.json")
    assert store.write_value({"a": [1, 2]}, v) > 0 and store.read_value(v) == {"a": [1, 2]}
    assert store.write_text("select 1 as a;\nselect 2 as a;\n", v) == 30 and store.run_script(spark, v).first().a == 2
    assert store.lines(spark, v, 1).count() == 1 and "v.json" in store.dir_ls(str(tmp_path))
    store.mkdir(str(tmp_path / "n" / "m"))
    assert store.dir_ls(str(tmp_path / "n"), True) == [str(tmp_path / "n" / "m")]
