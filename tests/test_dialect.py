"""The query language on the manual-style literal cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.plans.dialect import DialectError, Engine
from tests.conftest import rows


@pytest.fixture()
def e(spark):
    e = Engine(spark, variables={"lim": 2, "names": ["a", "b"]})
    e.add("t", spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate([(1, 3, "a"), (2, 4, "b"), (1, 5, "c"), (2, 6, "d")])], "i int, a int, b int, c string"), ["i"])
    e.add("d", spark.createDataFrame([(i, datetime(2015, 1, 1 + i, i)) for i in range(10)], "i int, t timestamp_ntz"), ["i"])
    return e


def test_selects(e):
    assert rows(e.run("select sum b from t group by a")) == [(1, 8), (2, 10)]
    assert rows(e.run("SELECT last(c) AS z FROM t GROUP BY a")) == [(1, "c"), (2, "d")]
    assert e.run("select first(b), last(b), count(*) from t").columns == ["b", "b1", "count"]
    assert rows(e.run("select first(b), last(b), count(*) from t")) == [(3, 6, 4)]
    assert rows(e.run("select b * 2 + 1 as x from t where a = 1")) == [(15,), (9,)]  # grouped from the right
    assert rows(e.run("select (b * 2) + 1 as x from t where a = 1")) == [(11,), (7,)]
    assert rows(e.run("select i from t where a = 1, b = max(b)")) == [(2,)]
    assert rows(e.run("select i from t where b > avg(b), b < max(b)")) == [(2,)]
    assert rows(e.run("select i, max(b) as m from t where a = 2")) == [(1, 6), (3, 6)]
    assert rows(e.run("select * from t where c in ['a', 'd'], i < lim")) == [(0, 1, 3, "a")]
    assert rows(e.run("select i from t where c in names")) == [(0,), (1,)]
    assert rows(e.run("select i from t where b in (select max(b) as m from (select b from t where a = 1))")) == [(2,)]
    assert rows(e.run("select i from t where (a = 1) and (b > 3)")) == [(2,)]
    assert rows(e.run("select sum(b) as s, avg(b) as m from (select * from t where a = 2)")) == [(10, 5.0)]
    assert [r.i for r in e.run("select i from t order by b desc limit 2").collect()] == [3, 2]
    assert rows(e.run("select i, msum(2, b) as m from t")) == [(0, 3), (1, 7), (2, 9), (3, 11)]
    assert rows(e.run("select b/0 as q from t where i = 0")) == [(float("inf"),)]
    assert rows(e.run("select i from t where c > 'B'")) == [(1,), (2,), (3,)]  # upper case first, then the bytes


def test_time(e):
    assert rows(e.run("select i from d where t < 2015.01.02T00:00")) == [(0,)]
    assert rows(e.run("select i from d where t >= 2015-01-09")) == [(8,), (9,)]
    assert rows(e.run("select t + 1m1d as u from d where i = 0")) == [(datetime(2015, 2, 2),)]
    assert rows(e.run("select i from d where t > 2015y01m08d")) == []
    assert rows(e.run("select count(*) as n from d group by bars(5d, t)")) == [(datetime(2015, 1, 1), 5), (datetime(2015, 1, 6), 5)]
    assert rows(e.run("select t['day'] as x, t.hour as h from d where i = 3")) == [(4, 3)]


def test_changes(e):
    with pytest.raises(DialectError):
        e.run("update t set z = 1 where i = 0")
    assert rows(e.run("update (t) set b = 0 where a = 1"), "i", "b") == [(0, 0), (1, 4), (2, 0), (3, 6)]
    assert rows(e.run("select b from t where i = 0")) == [(3,)]  # the copy left the table as it was
    assert rows(e.run("update t set z = sum(b) group by a"), "i", "z") == [(0, 8), (1, 10), (2, 8), (3, 10)]
    assert rows(e.run("update t set z = msum(2, b) group by a"), "i", "z") == [(0, 3), (1, 4), (2, 8), (3, 10)]
    assert rows(e.run("update (t) set b: 2*b, z: 2*b"), "i", "b", "z") == [(0, 6, 12), (1, 8, 16), (2, 10, 20), (3, 12, 24)]
    assert rows(e.run("delete from t where a >= 1, b >= 5"), "i") == [(0,), (1,)]
    assert rows(e.run("insert into t (i, a) values (9, 7), (8, 7)"), "i", "a", "b") == [(0, 1, 3), (1, 2, 4), (8, 7, None), (9, 7, None)]
    assert rows(e.run("select i from t")) == [(0,), (1,), (8,), (9,)]
    assert rows(e.run("insert into t values (9, 1, 1, 'n', 0), (7, 1, 1, 'o', 0) on conflict (i) update"), "i", "c") == [(0, "a"), (1, "b"), (7, "o"), (8, None), (9, "n")]
    assert rows(e.run("delete from t")) == []


@pytest.mark.parametrize("bad", ["select", "select a from nowhere", "select zz from t", "drop t", "select a from t where", "select a from t group by b", "select nofun(a) from t", "select first(a) from (select * from t)", "select a from t ; select", "update t set a", "insert into t values (1)", "select a $ b from t", "select a from t where b in (select a, b from t)"])
def test_errors(e, bad):
    with pytest.raises(DialectError):
        e.run(bad)


def test_subselect_of_any_length(spark):
    e = Engine(spark)
    e.add("t", spark.range(20_000).withColumn("x", F.nullif(F.col("id") % 20_000, F.lit(7))))
    assert e.run("select id from t where x in (select x from t where id != 3)").count() == 19_999
    assert sorted(r.id for r in e.run("select id from t where (x in (select x from t where id > 8)) = false").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.id for r in e.run("select id from t where id = (select max(id) from t)").collect()] == [19_999]


def test_literals_and_indexing(spark):
    e = Engine(spark, order={"t": ["a"]})
    assert rows(e.run("{{a: 1 2 3, b: [4, 5, 6], c: 'x'}}")) == [(1, 4, "x"), (2, 5, "x"), (3, 6, "x")]
    assert e.run("{{a, b}}").columns == ["a", "b"] and e.run("{{a, b}}").count() == 0
    e.add("t", e.run("{{a: 1 2 3, b: 4 5 6}}"))
    assert rows(e.run("select sum(b) as s from {{b: 1 2 4}}")) == [(7,)]
    assert e.run("t[[b]]").columns == ["b"] and e.run("t[['b', 'a']]").columns == ["b", "a"] and e.run("t['b']").columns == ["b"]
    assert [tuple(r) for r in e.run("t[[2, 0, 2]]").collect()] == [(3, 6), (1, 4), (3, 6)] and rows(e.run("t[1]")) == [(2, 5)]
    e.run("insert into t values {a: 9, b: 8}")
    e.run("insert into t values {[{a: 10}, {b: 11, a: 12}]}")
    assert rows(e.run("select a, b from t where a > 3")) == [(10, None), (12, 11), (9, 8)]
    for bad in ("{{a: 1 2, b: 1 2 3}}", "insert into t values {z: 1}", "u[1]"):
        with pytest.raises(DialectError):
            e.run(bad)


def test_distinct_nested_keys_and_user_functions(spark):
    from tessella.functions import udf
    from tessella.operators.atlas import atlas

    e = Engine(spark, functions={"twice": udf.vector(lambda x: x * 2, "double")})
    e.add("t", spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "a int, s string"))
    assert rows(e.run("select distinct s from t")) == [("x",), ("y",)] and rows(e.run("select distinct s from t order by s desc limit 1")) == [("y",)]
    assert rows(e.run("select twice(a) as d from t where twice(a) > 3")) == [(4.0,), (6.0,)]
    e.add("j", atlas(spark.createDataFrame([('{"a": "x", "b": 1, "c": {"d": 5}}',), ('{"a": "y", "b": 2}',), ('{"a": "x"}',)], "json string"), "json"))
    assert rows(e.run("select count(*) as n, sum(v.b) as b from j group by v.a")) == [("x", 2, 1.0), ("y", 1, 2.0)]
    assert e.run("select v.a from j where v.a = 'x'").count() == 2 and e.run("select v.b from j where v.b > 1").count() == 1
    assert e.run("select v.a from j where v.a in ['x', 'z']").count() == 2 and rows(e.run("select toupper(v.a) as u, v.c.d + 1 as d from j where v.c.d = 5")) == [("X", 6.0)]
