"""Queries for the relational, time-series, list and matrix operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.functions import aggregates as A
from tessella.functions import arrays as L
from tessella.functions import compare as C
from tessella.functions import linalg, text, times, values
from tessella.functions import maths as M
from tessella.functions import windows as N
from tessella.operators import atlas, joins, moving, ranges, tables
from tessella.plans.dialect import Engine
from tessella.plans.tables import table
from tessella.session import scratch
from tessella.sources import delimited, store
from tessella.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def li(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def part(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part")


# scans, projections, predicates


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount > 0.05 AND l_shipdate >= TIMESTAMP '1998-01-01'")
def scan_project_filter(s, d):
    return li(s, d).filter((F.col("l_discount") > 0.05) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 30000")
def where_between(s, d):
    x = li(s, d).filter(F.col("l_quantity").between(10, 20) & F.col("l_extendedprice").between(20000, 30000))
    return x.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 5, 9, 13, 17, 21)")
def where_in(s, d):
    return orders(s, d).filter(C.in_("o_orderstatus", ["F", "P"]) & C.in_("o_custkey", [1, 5, 9, 13, 17, 21])).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 3 AND l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem WHERE l_quantity < 3)")
def where_comma_agg(s, d):
    x = tables.where_all(li(s, d), F.col("l_quantity") < 3, lambda agg: F.col("l_extendedprice") == agg(F.max("l_extendedprice")))
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, value < 10 AS lt, value >= 100 AS ge, event_type = 'click' AS eq, event_type <> 'view' AS ne, upper(event_type) < 'F' AS txt FROM events")
def comparisons(s, d):
    return ev(s, d).select("event_id", C.less("value", F.lit(10)).alias("lt"), C.greatereq("value", F.lit(100)).alias("ge"), C.equals("event_type", F.lit("click")).alias("eq"), C.noteq("event_type", F.lit("view")).alias("ne"), C.less("event_type", F.lit("F"), text=True).alias("txt"))


@query("WITH n AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id FROM n WHERE v < 20 OR v IS NULL")
def null_smallest(s, d):
    n = ev(s, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return n.filter(C.less("v", F.lit(20))).select("event_id")


# aggregates

ALL = "count(*) AS n, round(sum(v), 2) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(var_pop(v), 4) AS var, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS med, count(*) - count(v) AS nulls, count(v) AS some"
HOLES = "(SELECT event_type, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)"


def _all(v: str) -> dict:
    return dict(n=A.count(), total=F.round(A.sum_(v), 2), mean=F.round(A.avg(v), 6), low=A.min_(v), high=A.max_(v), var=F.round(A.var(v), 4), std=F.round(A.std(v), 6), med=F.round(A.median(v), 6), nulls=A.count_null(v), some=A.count_nonnull(v))


def _holes(s, d):
    """Events with a value that is sometimes NaN or null."""
    e = F.col("event_id")
    return ev(s, d).select("event_type", "event_id", F.when(e % 14 == 0, float("nan")).when(e % 7 != 0, F.col("value")).alias("v"))


@query(f"SELECT {ALL} FROM {HOLES}")
def agg_all(s, d):
    return _holes(s, d).agg(*[c.alias(n) for n, c in _all("v").items()])


@query(f"SELECT event_type, {ALL} FROM {HOLES} GROUP BY 1")
def agg_grouped(s, d):
    return tables.group(_holes(s, d), ["event_type"], **_all("v"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 8) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def agg_group_multi(s, d):
    x = li(s, d).filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return tables.group(x, ["l_returnflag", "l_linestatus"], qty=F.round(A.sum_("l_quantity"), 2), net=F.round(A.sum_(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), disc=F.round(A.avg("l_discount"), 8), n=A.count())


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def agg_first_last(s, d):
    return tables.group(ev(s, d), ["user_id"], first_type=A.first("event_type", "event_id"), last_type=A.last("event_type", "event_id"), last_value=A.last("value", "event_id"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def agg_vwap(s, d):
    return tables.group(li(s, d).filter("l_discount > 0.05"), ["l_returnflag"], mean=F.round(A.avg("l_extendedprice"), 4), vwap=F.round(A.vwap("l_extendedprice", "l_quantity"), 4))


@query("SELECT p_brand, arg_min(p_name, (upper(p_name), length(p_name), p_name)) AS low, arg_max(p_name, (upper(p_name), length(p_name), p_name)) AS high FROM part GROUP BY 1")
def agg_text_minmax(s, d):
    return tables.group(part(s, d), ["p_brand"], low=A.min_("p_name", text=True), high=A.max_("p_name", text=True))


@query("SELECT event_type, min(event_id) AS seen FROM events GROUP BY 1")
def distinct_first_seen(s, d):
    e = ev(s, d)
    kinds = tables.distinct(e, ["event_type"], "event_id")
    return joins.left_join(kinds, e.select("event_type", F.col("event_id").alias("seen")), "event_type", "seen")


@query("SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS places FROM events GROUP BY 1")
def part_groups(s, d):
    return tables.part(ev(s, d), "user_id", "event_id").select("user_id", F.size("places").cast("bigint").alias("n"), F.array_join("places", ",").alias("places"))


# windows

USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _user() -> object:
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def _by_user(s, d, **cols) -> DataFrame:
    return ev(s, d).select("event_id", *[c.alias(n) for n, c in cols.items()])


@query(f"SELECT event_id, round(sum(value) OVER ({USER} ROWS 4 PRECEDING), 4) AS x FROM events")
def msum(s, d):
    return _by_user(s, d, x=F.round(N.msum(5, "value", _user()), 4))


@query(f"SELECT event_id, count(CASE WHEN event_type = 'click' THEN 1 END) OVER ({USER} ROWS 9 PRECEDING) AS x FROM events")
def mcount(s, d):
    return _by_user(s, d, x=N.mcount(10, F.when(F.col("event_type") == "click", 1), _user()))


@query(f"SELECT event_id, round(avg(value) OVER ({USER} ROWS 20 PRECEDING), 6) AS slow, round(avg(value) OVER ({USER} ROWS 4 PRECEDING), 6) AS fast FROM events")
def mavg(s, d):
    return _by_user(s, d, slow=F.round(N.mavg(21, "value", _user()), 6), fast=F.round(N.mavg(5, "value", _user()), 6))


@query(f"SELECT event_id, max(value) OVER ({USER} ROWS 6 PRECEDING) AS x FROM events")
def mmax(s, d):
    return _by_user(s, d, x=N.mmax(7, "value", _user()))


@query(f"SELECT event_id, min(value) OVER ({USER} ROWS 6 PRECEDING) AS x FROM events")
def mmin(s, d):
    return _by_user(s, d, x=N.mmin(7, "value", _user()))


@query(f"SELECT event_id, round(sum(value) OVER ({USER} ROWS UNBOUNDED PRECEDING), 4) AS x FROM events")
def rsum(s, d):
    return _by_user(s, d, x=F.round(N.rsum("value", _user()), 4))


@query(f"SELECT event_id, lag(value, 4, 999.0) OVER ({USER}) AS x FROM events")
def shift_lag(s, d):
    return _by_user(s, d, x=N.shift(4, "value", _user(), 999.0))


@query(f"SELECT event_id, lead(value, 1, 999.0) OVER ({USER}) AS x FROM events")
def shift_lead(s, d):
    return _by_user(s, d, x=N.shift(-1, "value", _user(), 999.0))


@query(f"SELECT event_id, round(value - coalesce(lag(value) OVER ({USER}), 0), 6) AS delta, greatest(value, lag(value) OVER ({USER})) AS high, least(value, lag(value) OVER ({USER})) AS low FROM events")
def mapback_delta(s, d):
    w = _user()
    return _by_user(s, d, delta=F.round(N.mapback(lambda a, b: a - b, "value", w), 6), high=N.maxback("value", w), low=N.minback("value", w))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS 99 PRECEDING), 4) AS total, event_id AS id FROM events")
def msum_table(s, d):
    x = moving.moving(ev(s, d), "msum", 100, "value", ["ts", "event_id"], name="total")
    return x.select("event_id", F.round("total", 4).alias("total"), F.col("event_id").alias("id"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 49 PRECEDING), 9) AS x FROM events")
def mavg_split(s, d):
    return moving.moving(ev(s, d), "mavg", 50, "value", ["ts", "event_id"], ["event_type"], "x").select("event_id", F.round("x", 9).alias("x"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id), 2) AS x FROM events")
def rsum_table(s, d):
    return moving.running_sum(ev(s, d), "value", ["ts", "event_id"], name="x").select("event_id", F.round("x", 2).alias("x"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 2) AS x FROM events")
def rsum_split(s, d):
    return moving.running_sum(ev(s, d), "value", ["ts", "event_id"], ["event_type"], "x").select("event_id", F.round("x", 2).alias("x"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def order_rank(s, d):
    return ranges.with_rank(part(s, d), ["p_retailprice", "p_partkey"]).select("p_partkey", "rank")


@query("SELECT p_partkey, CAST(((row_number() OVER (ORDER BY p_size, p_partkey) - 1) * 7) // (SELECT count(*) FROM part) AS BIGINT) AS bucket FROM part")
def bucketed(s, d):
    return ranges.bucketed(part(s, d), 7, ["p_size", "p_partkey"]).select("p_partkey", "bucket")


# sorting and positions


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def bottomk(s, d):
    return tables.top(orders(s, d), 50, "o_totalprice", ["o_orderkey"], down=False).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 200")
def topk_stable(s, d):
    return tables.top(orders(s, d), 200, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, row_number() OVER (ORDER BY upper(p_name), length(p_name), p_name, p_partkey) - 1 AS place FROM part")
def sort_text(s, d):
    return ranges.with_rank(part(s, d).select("p_partkey", C.text_key("p_name").alias("name")), ["name", "p_partkey"], "place").select("p_partkey", "place")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_suppkey LIMIT 10")
def topk(s, d):
    return tables.top(tables.group(li(s, d), ["l_suppkey"], qty=F.round(A.sum_("l_quantity"), 2)), 10, "qty", ["l_suppkey"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r > 1000")
def drop_rows(s, d):
    return tables.drop(orders(s, d), 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT i AS place, n_name FROM range(60) r(i) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) ON k = i % 25")
def take_cycle(s, d):
    return tables.cycle(table(s, d, "nation"), 60, ["n_nationkey"]).select("place", "n_name")


# joins


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1)
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def left_join_first(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return joins.left_join(c, orders(s, d), {"c_custkey": "o_custkey"}, ["o_orderdate", "o_orderkey"], extra=["o_orderkey", "o_totalprice"])


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join_map_keys(s, d):
    x = joins.left_join(table(s, d, "supplier"), table(s, d, "nation"), {"s_nationkey": "n_nationkey"}, "n_name")
    return joins.left_join(x, table(s, d, "region"), {"n_regionkey": "r_regionkey"}, "r_name").select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(s, d):
    return joins.semi_join(table(s, d, "customer"), orders(s, d).filter("o_totalprice > 300000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(s, d):
    return joins.anti_join(table(s, d, "customer"), orders(s, d).filter("o_totalprice > 300000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("WITH f AS (SELECT l_partkey, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey, l_shipdate FROM part JOIN f ON p_partkey = l_partkey")
def inner_join_first(s, d):
    x = joins.inner_join(part(s, d).select("p_partkey"), li(s, d).filter("l_quantity > 45").select("l_partkey", "l_shipdate"), {"p_partkey": "l_partkey"}, "l_shipdate")
    return x.select("p_partkey", "l_shipdate")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross_lists(s, d):
    names = table(s, d, "region").agg(A.values("r_name", "r_regionkey").alias("x"))  # a list verb: both lists stand in one cell
    return names.select(F.explode(L.cross("x", "x")).alias("p")).select("p.a", "p.b")


@query("SELECT a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b ON a.i = b.i")
def positional_zip(s, d):
    return joins.zip_join(table(s, d, "nation"), table(s, d, "region"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


ASOF = """SELECT c.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts"""


def _asof(s, d, **more):
    e = ev(s, d)
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"), F.col("event_id").alias("rid"))
    return joins.asof_join(left, right, "user_id", "ts", "rid", **more).select("event_id", "seen")


@query(ASOF)
def asof_join(s, d):
    return _asof(s, d)


@query(ASOF)
def asof_join_split(s, d):
    return _asof(s, d, split=True)


@query("SELECT c.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.ts >= v.ts")
def asof_join_nokey(s, d):
    e = ev(s, d)
    left = e.filter("event_type = 'click'").select("event_id", "ts")
    right = e.filter("event_type = 'view'").select("ts", F.col("value").alias("seen"), F.col("event_id").alias("rid"))
    return joins.asof_join(left, right, None, "ts", "rid").select("event_id", "seen")


@query("""WITH r AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
j AS (SELECT l.o_orderkey, l.o_orderpriority, l.o_totalprice, r.price FROM (SELECT *, o_orderdate - INTERVAL 1 DAY AS t FROM orders) l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.t >= r.o_orderdate)
SELECT o_orderpriority, round(sum(price * o_totalprice) / sum(CASE WHEN price IS NOT NULL THEN o_totalprice END), 2) AS vwap FROM j GROUP BY 1""")
def asof_vwap(s, d):
    o = orders(s, d)
    left = o.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", times.shift_by("o_orderdate", "1d", -1).alias("t"))
    right = o.groupBy("o_custkey", F.col("o_orderdate").alias("u")).agg(F.max("o_totalprice").alias("price"))
    return tables.group(joins.asof_join(left, right, "o_custkey", ("t", "u")), ["o_orderpriority"], vwap=F.round(A.vwap("price", "o_totalprice"), 2))


@query("""WITH j AS (SELECT e.ts, e.value, c.value AS clicked FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts)
SELECT date_trunc('hour', ts) AS bar, count(*) AS errors, count(clicked) AS after_click, round(avg(value - clicked), 6) AS diff FROM j GROUP BY 1""")
def asof_bars(s, d):
    e = ev(s, d)
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("clicked"), F.col("event_id").alias("rid"))
    j = joins.asof_join(e.filter("event_type = 'error'").select("user_id", "ts", "value"), right, "user_id", "ts", "rid")
    bar = times.time_bars("1h", "ts", F.lit("1970-01-01 00:00:00"), first=False)
    return tables.group(j, {"bar": bar}, errors=A.count(), after_click=F.count("clicked"), diff=F.round(A.avg(F.col("value") - F.col("clicked")), 6))


# time


@query("SELECT CAST(5 * floor(value / 5) AS BIGINT) AS bar, count(*) AS n FROM events GROUP BY 1")
def bars_numeric(s, d):
    return tables.group(ev(s, d), {"bar": times.bars(F.lit(5), "value").cast("bigint")}, n=A.count())


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bar, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def bars_5min(s, d):
    bar = times.time_bars("5i", "ts", F.lit("2024-01-01 00:00:00"), first=False)
    return tables.group(ev(s, d), {"bar": bar}, n=A.count(), mean=F.round(A.avg("value"), 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bar, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM events GROUP BY 1")
def bars_1h_origin(s, d):
    bar = times.time_bars("1h", "ts", F.lit("2024-01-01 00:30:00"), first=False)
    return tables.group(ev(s, d), {"bar": bar}, low=A.min_("value"), high=A.max_("value"), open=A.first("value", "event_id"), close=A.last("value", "event_id"))


@query("SELECT make_timestamp(CAST(epoch_us(TIMESTAMP '2024-01-01') + 432000000000 * floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 432000000000) AS BIGINT)) AS bar, count(*) AS n FROM events GROUP BY 1")
def bars_5d_first(s, d):
    e = ev(s, d)
    first = F.lit(e.agg(F.min_by("ts", "event_id")).first()[0]).cast("timestamp_ntz")
    return tables.group(e, {"bar": times.time_bars("5d", "ts", first)}, n=A.count())


@query("SELECT make_timestamp(CAST(year(o_orderdate) AS BIGINT), CAST((month(o_orderdate) - 1) // 2 * 2 + 1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE)) AS bar, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def bars_month(s, d):
    bar = times.time_bars("2m", "o_orderdate", F.lit("1995-01-01 00:00:00"))
    return tables.group(orders(s, d), {"bar": bar}, n=A.count(), total=F.round(A.sum_("o_totalprice"), 2))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST((dayofyear(o_orderdate) - 1 + 7 - (isodow(o_orderdate) - 1)) // 7 + 1 AS BIGINT) AS w FROM orders")
def week_field(s, d):
    f = times.field
    return orders(s, d).select("o_orderkey", f("year", "o_orderdate").alias("y"), f("month", "o_orderdate").alias("m"), f("day", "o_orderdate").alias("d"), f("week", "o_orderdate").alias("w"))


@query("SELECT event_id, epoch_us(ts) % 1000000 * 1000 AS ns, CAST(epoch_us(ts) % 1000000 // 1000 AS BIGINT) AS ms, hour(ts) AS h, minute(ts) AS i, second(ts) AS sec FROM events")
def time_fields(s, d):
    f = times.field
    return ev(s, d).select("event_id", f("nanosecond", "ts").alias("ns"), f("millisecond", "ts").alias("ms"), f("hour", "ts").alias("h"), f("minute", "ts").alias("i"), f("second", "ts").alias("sec"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) + (day(o_orderdate) - 1) * INTERVAL 1 DAY AS up,
CAST(date_trunc('month', o_orderdate) - INTERVAL 1 YEAR AS TIMESTAMP) + (day(o_orderdate) - 1) * INTERVAL 1 DAY - INTERVAL 1 HOUR AS down FROM orders""")
def month_overflow(s, d):
    return orders(s, d).select("o_orderkey", times.shift_by("o_orderdate", "1m").alias("up"), times.shift_by("o_orderdate", "1y1h", -1).alias("down"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1996 AND month(o_orderdate) > 6 AND day(o_orderdate) > 15")
def relative_compare(s, d):
    return orders(s, d).filter(times.compare("o_orderdate", ">", "1996y6m15d")).select("o_orderkey")


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS a, strftime(ts, '%j|%b|%p') AS b FROM events")
def format_stamp(s, d):
    return ev(s, d).select("event_id", times.format_stamp("%Y/%m/%d %H:%M:%S.%Q", "ts").alias("a"), times.format_stamp("%j|%b|%p", "ts").alias("b"))


@query("SELECT o_orderkey, o_orderdate AS t FROM orders")
def parse_stamp(s, d):
    text_ = times.format_stamp("%d.%m.%Y %H-%M-%S", "o_orderdate")
    return orders(s, d).select("o_orderkey", times.parse_stamp("%d.%m.%Y %H-%M-%S", text_).alias("t"))


@query(f"SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER ({USER}))) * 1000 AS ns FROM events")
def stamp_diff(s, d):
    return _by_user(s, d, ns=times.stamp_diff("ts", F.lag("ts", 1).over(_user())))


# sets


@query("SELECT p_partkey AS k FROM part WHERE p_size < 10 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_union(s, d):
    return tables.union(part(s, d).filter("p_size < 10").select(F.col("p_partkey").alias("k")), li(s, d).filter("l_quantity > 48").select(F.col("l_partkey").alias("k")))


@query("SELECT p_partkey AS k FROM part WHERE p_size < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_intersect(s, d):
    return tables.intersect(part(s, d).filter("p_size < 10").select(F.col("p_partkey").alias("k")), li(s, d).filter("l_quantity > 48").select(F.col("l_partkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def set_except_keepdups(s, d):
    return tables.except_(li(s, d).select(F.col("l_partkey").alias("k")), part(s, d).filter("p_size < 25").select(F.col("p_partkey").alias("k")))


# changes


@query("SELECT p_partkey, p_size * 2 AS a, p_size * 4 AS b FROM part")
def update_seq(s, d):
    return tables.update(part(s, d).select("p_partkey", "p_size"), [("a", F.col("p_size") * 2), ("b", F.col("a") * 2)]).drop("p_size")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 1.1, 4) ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(s, d):
    return tables.update(orders(s, d), [("o_totalprice", F.round(F.col("o_totalprice") * 1.1, 4))], F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS high, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 4) AS m3 FROM orders")
def update_group(s, d):
    x = tables.update_by(orders(s, d), ["o_custkey"], {"n": F.count(F.lit(1)), "high": F.max("o_totalprice"), "m3": lambda w: F.round(N.mavg(3, "o_totalprice", w), 4)}, ["o_orderdate", "o_orderkey"])
    return x.select("o_orderkey", "n", "high", "m3")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 200000)")
def delete_where(s, d):
    return tables.delete(orders(s, d), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 200000)).select("o_orderkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation")
def insert_rows(s, d):
    n = table(s, d, "nation")
    return tables.insert(n, n.select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"), ["n_nationkey", "n_name"])


@query("""WITH n AS (SELECT o_orderkey + 10 AS o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT o.o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN n ON o.o_orderkey = n.o_orderkey UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def upsert_on_conflict(s, d):
    o = orders(s, d).select("o_orderkey", "o_totalprice")
    new = orders(s, d).filter("o_orderstatus = 'F'").select((F.col("o_orderkey") + 10).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.upsert(o, new, ["o_orderkey"], "o_totalprice")


# strings, JSON


@query("SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up FROM part")
def str_lower(s, d):
    return part(s, d).select("p_partkey", text.tolower("p_type").alias("lo"), text.toupper("p_name").alias("up"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, len(string_split(p_name, ' ')) AS n, substr(p_name, 1, 3) AS a, substr(p_name, 4) AS b FROM part")
def str_split(s, d):
    w = text.explode(" ", "p_name")
    cut = text.split_at([3], "p_name")
    return part(s, d).select("p_partkey", L.car(w).alias("head"), F.size(w).cast("bigint").alias("n"), F.get(cut, F.lit(0)).alias("a"), F.get(cut, F.lit(1)).alias("b"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS x FROM part")
def str_implode(s, d):
    return part(s, d).select("p_partkey", text.implode("-", text.explode(" ", "p_name")).alias("x"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '.{1,4}'), '|') AS x FROM part")
def str_ngram(s, d):
    return part(s, d).select("p_partkey", text.implode("|", text.ngram(4, "p_name")).alias("x"))


@query("SELECT p_partkey, nullif(instr(p_name, 'ed'), 0) - 1 AS at FROM part")
def str_search(s, d):
    return part(s, d).select("p_partkey", text.search("ed", "p_name").cast("bigint").alias("at"))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def str_trim(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.length(text.trim("text")).cast("bigint").alias("n"))


@query("SELECT o_orderkey, printf('%9.5f|%s', o_totalprice / 1000, o_orderstatus) || '|' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS x FROM orders")
def str_format(s, d):
    return orders(s, d).select("o_orderkey", text.format_("%9.5f|%s|%.8d", F.col("o_totalprice") / 1000, F.col("o_orderstatus"), F.col("o_custkey")).alias("x"))


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS dec, CAST('0x' || regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS hex FROM part")
def parse_int_radix(s, d):
    n = F.regexp_replace("p_brand", "Brand#", "")
    return part(s, d).select("p_partkey", text.parse_int(n).alias("dec"), text.parse_int(n, 16).alias("hex"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_atlas_select(s, d):
    a = atlas.atlas(ev(s, d), "props", ["event_id"])
    return a.filter(atlas.key("k", "bigint") >= 90).select("event_id", atlas.key("k", "bigint").alias("k"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_atlas_group(s, d):
    a = atlas.atlas(ev(s, d), "props", ["value"])
    return tables.group(a, {"k": atlas.key("k", "bigint")}, n=A.count(), total=F.round(A.sum_("value"), 2))


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS j FROM events")
def json_write(s, d):
    return ev(s, d).select("event_id", text.to_json(F.struct("event_type", "user_id")).alias("j"))


# maths


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(exp(p_size / 10.0), 6) AS b, round(sin(p_size), 9) AS c, round(tanh(p_size / 50.0), 9) AS d, CAST(floor(p_retailprice / 7) AS BIGINT) AS e, CAST(ceil(p_retailprice / 7) AS BIGINT) AS f, round(pow(p_size, 1.5), 6) AS g, abs(p_size - 25) AS h FROM part")
def math_scalar(s, d):
    z = F.col("p_size")
    return part(s, d).select("p_partkey", F.round(M.sqrt("p_retailprice"), 6).alias("a"), F.round(M.exp(z / 10.0), 6).alias("b"), F.round(M.sin(z), 9).alias("c"), F.round(M.tanh(z / 50.0), 9).alias("d"), M.floor(F.col("p_retailprice") / 7).alias("e"), M.ceil(F.col("p_retailprice") / 7).alias("f"), F.round(M.power(z, 1.5), 6).alias("g"), M.absolute(z - 25).alias("h"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST(p_retailprice / (p_size % 5) AS DOUBLE) ELSE 'inf'::DOUBLE END = 'inf'::DOUBLE AS infinite, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / (p_size % 5), 6) END AS q FROM part")
def ieee_divide(s, d):
    q = M.divide("p_retailprice", F.col("p_size") % 5)
    return part(s, d).select("p_partkey", (q == float("inf")).alias("infinite"), F.when(q < float("inf"), F.round(q, 6)).alias("q"))


@query("SELECT p_partkey, CAST((p_size - 25) - 7 * floor((p_size - 25) / 7.0) AS BIGINT) AS a, CAST((p_size - 25) + 7 * floor((p_size - 25) / -7.0) AS BIGINT) AS b FROM part")
def mod_floor(s, d):
    x = F.col("p_size") - 25
    return part(s, d).select("p_partkey", M.mod(x, 7).cast("bigint").alias("a"), M.mod(x, -7).cast("bigint").alias("b"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN round(ln(p_size - 25), 6) END AS v, p_size = 25 AS minus_inf FROM part")
def log_guard(s, d):
    x = M.ln(F.col("p_size") - 25)
    return part(s, d).select("p_partkey", F.when(~F.isnan(x) & (x > -float("inf")), F.round(x, 6)).alias("v"), (x == -float("inf")).alias("minus_inf"))


# the error function as the sum of positive terms exp(-x*x) * 4^k * k! * x^(2k+1) / (2k+1)! * 2 / sqrt(pi)
@query("""SELECT event_id, CASE WHEN x = 0 THEN 0.0 WHEN x > 6 THEN 1.0 ELSE round(list_sum(list_transform(range(200), lambda k: exp(2 * k * ln(2) + lgamma(k + 1) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2) - x * x))) * 2 / sqrt(pi()), 9) END AS e,
CASE WHEN x = 0 THEN 1.0 WHEN x > 6 THEN 0.0 ELSE round(1 - list_sum(list_transform(range(200), lambda k: exp(2 * k * ln(2) + lgamma(k + 1) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2) - x * x))) * 2 / sqrt(pi()), 9) END AS c
FROM (SELECT event_id, abs(value) / 100 AS x FROM events)""")
def erf(s, d):
    x = F.abs("value") / 100
    return ev(s, d).select("event_id", F.round(M.erf(x), 9).alias("e"), F.round(M.erfc(x), 9).alias("c"))


# lists

LIST = "(SELECT min(event_id) AS id, list(CAST(value AS INT) ORDER BY event_id) AS a FROM events GROUP BY user_id, CAST(ts AS DATE))"


def _lists(s, d):
    """Whole numbers of each user's events of a day, as lists; ``id`` is the first event."""
    e = ev(s, d).groupBy("user_id", F.to_date("ts"))
    return e.agg(F.min("event_id").alias("id"), A.values(F.rint("value").cast("int"), "event_id").alias("a")).select("id", "a")


@query(f"SELECT id, array_to_string(list_sort(a), ',') AS srt, array_to_string(list_reverse(a), ',') AS rev, array_to_string(a[1:3], ',') AS head, array_to_string(a[3:], ',') AS tail, len(list_distinct(a)) AS uniq FROM {LIST}")
def list_verbs(s, d):
    j = lambda c: F.array_join(c, ",")
    return _lists(s, d).select("id", j(L.sort("a")).alias("srt"), j(L.reverse("a")).alias("rev"), j(F.slice("a", 1, 3)).alias("head"), j(L.drop(2, "a")).alias("tail"), F.size(L.distinct("a")).cast("bigint").alias("uniq"))


@query(f"SELECT id, list_sum(a) AS total, list_sum(list_transform(a, lambda x: x * x)) AS squares, list_position(a, list_max(a)) - 1 AS at FROM {LIST}")
def list_folds(s, d):
    x = _lists(s, d)
    return x.select("id", L.fold(lambda p, q: p + q, "a", F.lit(0)).cast("bigint").alias("total"), L.dotp("a", "a").cast("bigint").alias("squares"), L.search(F.array_max("a"), "a").cast("bigint").alias("at"))


@query(f"SELECT id, array_to_string(list_transform(range(10), lambda i: a[i % len(a) + 1]), ',') AS x FROM {LIST}")
def list_take_cycle(s, d):
    return _lists(s, d).select("id", F.array_join(L.take(10, "a"), ",").alias("x"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x % 2 = 0))), ',') AS even, len(list_filter(a, lambda x: x NOT IN (1, 2, 3))) AS kept, len(list_intersect(a, [1, 2, 3, 4, 5])) AS both FROM {LIST}")
def list_sets(s, d):
    some = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    even = C.filter_("a", lambda x: x % 2 == 0)
    return _lists(s, d).select("id", F.array_join(L.sort(L.distinct(even)), ",").alias("even"), F.size(L.except_("a", F.slice(some, 1, 3))).cast("bigint").alias("kept"), F.size(L.intersect("a", some)).cast("bigint").alias("both"))


@query(f"SELECT id, array_to_string(list_transform(range(CAST(ceil(len(a) / 3.0) AS BIGINT)), lambda i: CAST(list_sum(a[i * 3 + 1:i * 3 + 3]) AS BIGINT)), ',') AS x FROM {LIST}")
def list_ngram(s, d):
    sums = L.mapdown(lambda c: L.fold(lambda p, q: p + q, c, F.lit(0)), L.ngram(3, "a"))
    return _lists(s, d).select("id", F.array_join(sums.cast("array<bigint>"), ",").alias("x"))


@query(f"SELECT id, array_to_string(list_transform(list_zip(a, range(len(a))), lambda p: p[1] * 2 + p[2]), ',') AS x, array_to_string(list_transform(range(len(a)), lambda i: CASE WHEN i = 0 THEN a[1] ELSE a[i + 1] - a[i] END), ',') AS d FROM {LIST}")
def list_adverbs(s, d):
    pairs = L.mapdown(lambda x, i: x * 2 + i, "a", L.enumerate_(F.size("a")))
    return _lists(s, d).select("id", F.array_join(pairs, ",").alias("x"), F.array_join(L.mapback(lambda x, y: x - y, "a"), ",").alias("d"))


@query(f"WITH x AS (SELECT id, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS i FROM {LIST}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v, i) - 1 AS r FROM x) SELECT id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY v, i) AS up, string_agg(CAST(i AS VARCHAR), ',' ORDER BY v DESC, i) AS down, string_agg(CAST(r AS VARCHAR), ',' ORDER BY i) AS rank FROM r GROUP BY 1")
def list_grades(s, d):
    j = lambda c: F.array_join(c.cast("array<bigint>"), ",")
    return _lists(s, d).select("id", j(L.ascend("a")).alias("up"), j(L.descend("a")).alias("down"), j(L.order("a")).alias("rank"))


@query("SELECT p_partkey, p_size AS size, array_to_string(list_transform(range(p_size), lambda i: i * i), ',') AS squares, repeat('ab', p_size % 4) AS rep FROM part")
def range_repeat(s, d):
    r = L.mapdown(lambda i: i * i, L.range_("p_size"))
    return part(s, d).select("p_partkey", F.col("p_size").alias("size"), F.array_join(r, ",").alias("squares"), text.implode("", L.repeat(F.col("p_size") % 4, F.lit("ab"))).alias("rep"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, max(n_nationkey) AS last_key, count(*) AS n FROM nation GROUP BY 1")
def map_verbs(s, d):
    m = table(s, d, "nation").groupBy("n_regionkey").agg(values.map_(A.values("n_nationkey", "n_nationkey"), A.values("n_name", "n_nationkey")).alias("m"))
    return m.select("n_regionkey", text.implode(",", values.vals("m")).alias("names"), F.array_max(values.keys("m")).alias("last_key"), F.size(values.keys("m")).cast("bigint").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS up FROM events")
def json_read(s, d):
    return ev(s, d).withColumn("m", text.from_json("props", "struct<k bigint>")).select("event_id", F.col("m.k").cast("string").alias("k"), (F.col("m.k") + 1).alias("up"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_keys(s, d):
    return atlas.keys(atlas.atlas(ev(s, d), "props")).select("key", F.col("count").alias("n"))


@query("SELECT p_partkey, trunc(p_retailprice)::BIGINT AS i, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s, ascii(p_name) AS code, chr(ascii(p_name)) AS back FROM part")
def casts(s, d):
    codes = text.int_("p_name", "string")
    return part(s, d).select("p_partkey", text.int_("p_retailprice").alias("i"), text.float_("p_size").alias("f"), text.string("p_size").alias("s"), L.car(codes).alias("code"), text.char(F.slice(codes, 1, 1)).alias("back"))


@query("SELECT p_partkey, coalesce(nullif(p_size, 7), 0) AS filled, p_size = 7 AS hole FROM part")
def null_verbs(s, d):
    x = F.nullif(F.col("p_size"), F.lit(7))
    return part(s, d).select("p_partkey", values.isnull(x, F.lit(0)).alias("filled"), values.isnull(x).alias("hole"))


@query("SELECT count(DISTINCT h) = count(DISTINCT event_type) AS faithful, count(DISTINCT h) AS n FROM (SELECT event_type, hash(event_type) AS h FROM events)")
def checksum(s, d):
    h = ev(s, d).select("event_type", text.checksum("event_type").alias("h"))
    return h.agg((F.countDistinct("h") == F.countDistinct("event_type")).alias("faithful"), F.countDistinct("h").alias("n"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax * 500) AS lo, greatest(l_quantity, l_tax * 500) AS hi, round(log10(l_extendedprice), 8) AS l10, round(log2(l_extendedprice), 8) AS l2, round(log10(l_extendedprice) / log10(3), 8) AS l3 FROM lineitem")
def mins_maxes_logs(s, d):
    x, t = li(s, d), F.col("l_tax") * 500
    return x.select("l_orderkey", "l_linenumber", C.mins("l_quantity", t).alias("lo"), C.maxes("l_quantity", t).alias("hi"), F.round(M.log("l_extendedprice"), 8).alias("l10"), F.round(M.lg("l_extendedprice"), 8).alias("l2"), F.round(M.log(F.lit(3), "l_extendedprice"), 8).alias("l3"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000")
def insert_select(s, d):
    x = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tables.insert(x.filter("s_acctbal < 0"), x.filter("s_acctbal > 9000")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 25")
def take_last(s, d):
    return tables.take(orders(s, d), -25, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT a.c_custkey, a.c_acctbal + b.c_acctbal AS c_acctbal FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey")
def table_add(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return tables.table_arithmetic(c, c, M.plus, ["c_custkey"])


# the query language


def _engine(s, d) -> Engine:
    e = Engine(s)
    e.add("events", ev(s, d), ["ts", "event_id"])
    e.add("orders", orders(s, d), ["o_orderkey"])
    e.add("part", part(s, d), ["p_partkey"])
    e.add("lineitem", li(s, d))
    return e


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def dialect_group(s, d):
    x = _engine(s, d).run("select sum(l_extendedprice * l_quantity) / sum(l_quantity) as vwap, count(*) as n from lineitem where l_discount > 0.05 group by l_returnflag")
    return x.withColumn("vwap", F.round("vwap", 4))


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-20' AND value > (SELECT avg(value) FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-20')")
def dialect_where(s, d):
    return _engine(s, d).run("select event_id, value from events where event_type in ['click', 'view'], ts >= 2024.01.20, value > avg(value)")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS m, max(value) OVER (PARTITION BY user_id) AS high FROM events")
def dialect_update(s, d):
    x = _engine(s, d).run("update events set m = mavg(3, value), high: max(value) group by user_id")
    return x.select("event_id", F.round("m", 6).alias("m"), "high")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, max(value) AS value FROM events GROUP BY 1")
def dialect_bars(s, d):
    return _engine(s, d).run("select max(value) from events group by bars(1h, ts)")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def dialect_delete(s, d):
    return _engine(s, d).run("delete from orders where o_orderstatus = 'F', o_totalprice > 100000").select("o_orderkey")


@query("SELECT p_partkey, CASE p_partkey WHEN 5 THEN 99 ELSE p_size END AS p_size FROM part UNION ALL SELECT -1, 98")
def dialect_upsert(s, d):
    e = _engine(s, d)
    e.add("sizes", e.run("select p_partkey, p_size from part"), ["p_partkey"])
    return e.run("insert into sizes values (5, 99), (-1, 98) on conflict (p_partkey) update")


# matrices


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT min(vec_id) FROM embeddings)")
def dot_product(s, d):
    e = table(s, d, "embeddings")
    one = e.agg(F.min_by("embedding", "vec_id")).first()[0]
    return e.select("vec_id", F.round(L.dotp("embedding", F.array(*map(F.lit, one))), 4).alias("dot"))


@query("""WITH m AS (SELECT vec_id AS k, label AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding) AS v FROM embeddings)
SELECT a.i AS i, b.j AS j, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 3) AS v FROM (SELECT k, j AS i, v FROM m) a JOIN m b ON a.k = b.k GROUP BY 1, 2""")
def matrix_multiply(s, d):
    m = table(s, d, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("j", "v"))
    x = linalg.mmul(m.select(F.col("j").alias("i"), F.col("k").alias("j"), F.col("v").cast("double").alias("v")), m.select(F.col("k").alias("i"), "j", F.col("v").cast("double").alias("v")))
    return x.select("i", "j", F.round("v", 3).alias("v"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS a, round(regr_slope(l_extendedprice, l_quantity), 5) AS b FROM lineitem")
def lsq_fit(s, d):
    a, b = linalg.lsq(li(s, d), "l_extendedprice", ["l_quantity"], intercept=True)
    return s.createDataFrame([(round(a, 3), round(b, 5))], "a double, b double")


# storage


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'")
def partition_prune(s, d):
    path = scratch(s)
    orders(s, d).withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).repartitionByRange("month").write.partitionBy("month").parquet(path)
    return store.read_table(s, path).filter("month = '1998-03'").select("o_orderkey", "o_totalprice")


@query("SELECT round(sum(value), 2) AS total, min(value) AS low FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY CAST(ts AS DATE)")
def by_day_select(s, d):
    path = scratch(s)
    store.write_by_day(ev(s, d), path, "ts")
    agg = lambda df, keys: df.groupBy(*keys).agg(F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("low"))
    return store.select_by_day(s, path, F.col("date").between("2024-01-10", "2024-01-19"), agg, per_day=True)


@query("SELECT p_partkey, p_name, p_retailprice, p_size FROM part")
def csv_roundtrip(s, d):
    path = scratch(s)
    delimited.write_delimited(part(s, d).select("p_partkey", "p_name", "p_retailprice", "p_size"), path)
    return delimited.read_csv(s, path, "ISF4")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def fixed_width(s, d):
    path = scratch(s)
    o = orders(s, d)
    o.select(F.concat(F.lpad("o_orderkey", 10, " "), F.lpad("o_custkey", 8, " "), F.rpad("o_orderstatus", 3, " "), F.lpad(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), 14, " ")).alias("value")).write.text(path)
    return delimited.read_fixed(s, path, "IIEF", [10, 8, 3, 14], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_replace(s, d):
    path = scratch(s)
    x = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    store.write_table(x.filter("s_acctbal < 0"), path, ["s_suppkey"])
    return store.replace(tables.insert(store.read_table(s, path), x.filter("s_acctbal >= 0")), path)


# random values: only counts can be held against SQL


@query("SELECT count(*) AS n, true AS inside FROM events")
def rand_values(s, d):
    x = ev(s, d).select(values.rand(10, 7).alias("r"))
    return x.agg(F.count("*").alias("n"), F.min(F.col("r").between(0, 9)).alias("inside"))


@query("SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS different")
def rand_deal(s, d):
    return tables.deal(ev(s, d), 500, 3).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("different"))


@query(f"""WITH x AS (SELECT id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM {LIST}), p AS (SELECT a.id, a.v AS v, b.v AS w, min((a.i, b.i)) AS pl FROM x a JOIN x b ON a.id = b.id AND a.i < b.i GROUP BY ALL)
SELECT id, count(*) AS pairs, string_agg(v || '-' || w, ',' ORDER BY pl) AS text FROM p GROUP BY 1""")
def combinations(s, d):
    pairs = L.combinations("a", 2)
    return _lists(s, d).filter("size(a) > 1").select("id", F.size(pairs).cast("bigint").alias("pairs"), F.array_join(F.transform(pairs, lambda p: F.array_join(p, "-")), ",").alias("text"))


# streams, run to their end over the table as one source


def _run(df: DataFrame, s: SparkSession, mode: str) -> DataFrame:
    out, where = scratch(s), scratch(s)
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", where)
    if mode == "complete":
        q = w.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
    else:
        q = w.outputMode(mode).format("parquet").option("path", out).start()
    q.awaitTermination()
    return s.read.schema(df.schema).parquet(out)


def _stream(s: SparkSession, d: str) -> DataFrame:
    return streams.ticks(s, d, table(s, d, "events").schema, files="events.parquet")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bar, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_bars(s, d):
    x = streams.stream_bars(_stream(s, d), "ts", "1 hour", {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}, ["event_type"])
    return _run(x, s, "complete")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_dedup(s, d):
    x = streams.stream_distinct(_stream(s, d), "ts", ["user_id", "event_type"], "60 days")
    return _run(x.select("user_id", "event_type"), s, "append").groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS begins, count(*) AS n FROM y GROUP BY user_id, s")
def stream_sessions(s, d):
    x = streams.stream_sessions(_stream(s, d), "ts", "1 day", {"n": F.count("*")}, ["user_id"], "60 days")
    return _run(x, s, "complete").select("user_id", "begins", "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert(s, d):
    out = scratch(s)
    q = _stream(s, d).select("user_id", "event_id", "value").writeStream.foreachBatch(streams.upsert_into(out, ["user_id"], "event_id")).option("checkpointLocation", scratch(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.upserted(s, out)


@query("""SELECT c.event_id AS id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def stream_asof(s, d):
    """The events in several files, one a batch, whose rows overlap in time by a day; a last one moves the watermark on."""
    where, e = scratch(s), ev(s, d).withColumn("event_id", F.col("event_id").cast("bigint")).select("event_id", "user_id", "ts", "event_type", "value")
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))) / (7 * 86_400_000_000))
    parts = [r[0] for r in e.select(day.alias("w")).distinct().orderBy("w").collect()]  # a few weeks
    for w in parts:
        e.filter(day == w).coalesce(1).write.mode("append").parquet(where)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    last.coalesce(1).write.mode("append").parquet(where)
    t = streams.ticks(s, where, e.schema, 1)
    x = streams.stream_asof(t.filter("event_type in ('click', 'end')"), t.filter("event_type in ('view', 'end')"), "user_id", "ts", "event_id", "value", "event_id", "2 days")
    return _run(x, s, "append").filter("id >= 0").select("id", F.col("value").alias("seen"))


# the shapes of a financial time-series benchmark on these tables


@query("""SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3""")
def hist_ranges(s, d):
    t = F.col("o_orderdate")
    x = orders(s, d).filter((t >= F.lit("1995-01-01").cast("timestamp_ntz")) & (t < F.lit("2001-01-01").cast("timestamp_ntz")))
    return tables.group(x, {"o_custkey": "o_custkey", "y": times.field("year", t), "m": times.field("month", t)}, low=A.min_("o_totalprice"), high=A.max_("o_totalprice"), mean=F.round(A.avg("o_totalprice"), 4))


@query("""WITH r AS (SELECT o_custkey, o_orderdate, arg_max(o_totalprice, o_orderkey) AS f FROM orders GROUP BY 1, 2), k AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders)
SELECT k.o_orderkey, round(k.o_totalprice * r.f, 2) AS adjusted FROM k LEFT JOIN r ON k.o_custkey = r.o_custkey AND k.o_orderdate = r.o_orderdate""")
def hist_adjusted(s, d):
    o = orders(s, d)
    r = o.select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("f"), (-F.col("o_orderkey")).alias("rid"))
    return joins.left_join(o, r, ["o_custkey", "o_orderdate"], "rid", extra=["f"]).select("o_orderkey", F.round(F.col("o_totalprice") * F.col("f"), 2).alias("adjusted"))


@query(f"""WITH m AS (SELECT event_id, user_id, ts, avg(value) OVER ({USER} ROWS 20 PRECEDING) AS slow, avg(value) OVER ({USER} ROWS 4 PRECEDING) AS fast FROM events),
g AS (SELECT *, CAST(sign(round(fast - slow, 9)) AS INT) AS s FROM m), h AS (SELECT event_id, s, lag(s) OVER ({USER}) AS p FROM g) SELECT event_id, s AS cross_sign FROM h WHERE p IS NOT NULL AND s <> p AND s <> 0""")
def hist_crossings(s, d):
    w = _user()
    m = ev(s, d).withColumns({"slow": N.mavg(21, "value", w), "fast": N.mavg(5, "value", w)})
    gap = F.round(F.col("fast") - F.col("slow"), 9)
    return m.withColumn("cross_sign", N.crossings(gap, F.lit(0.0), w)).filter("cross_sign <> 0").select("event_id", "cross_sign")


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), i AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS w FROM events GROUP BY 1)
SELECT user_id, count(*) AS days, round(corr(v, w), 6) AS r FROM x JOIN i ON x.day = i.day GROUP BY 1""")
def hist_correlation(s, d):
    """Each user's daily means against the index of all, rather than all pairs of users."""
    e = ev(s, d)
    x = tables.group(e, {"user_id": "user_id", "day": F.to_date("ts")}, v=A.avg("value"))
    index = tables.group(e, {"day": F.to_date("ts")}, w=A.avg("value"))
    return x.join(index, "day").groupBy("user_id").agg(F.count("*").alias("days"), F.round(F.corr("v", "w"), 6).alias("r"))


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 09:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def tick_window(s, d):
    t = F.col("ts")
    x = ev(s, d).filter((t >= F.lit("2024-01-10 09:00:00").cast("timestamp_ntz")) & (t < F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")))
    return joins.semi_join(x, table(s, d, "customer").filter("c_mktsegment = 'MACHINERY'"), {"user_id": "c_custkey"}).select("event_id", "ts", "value")


@query("SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 7) AS vwap FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-04-01' GROUP BY 1")
def tick_vwap(s, d):
    t = F.col("l_shipdate")
    x = li(s, d).filter((t >= F.lit("1999-01-01").cast("timestamp_ntz")) & (t < F.lit("1999-04-01").cast("timestamp_ntz")))
    return tables.group(x, ["l_partkey"], vwap=F.round(A.vwap("l_extendedprice", "l_quantity"), 7))


@query("""WITH a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1), b AS (SELECT user_id, arg_max(value, event_id) AS p FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-14' GROUP BY 1)
SELECT a.user_id, round((v - p) / p, 6) AS change FROM a JOIN b ON a.user_id = b.user_id WHERE p > 0 ORDER BY change, a.user_id LIMIT 10""")
def tick_losers(s, d):
    on = lambda day: ev(s, d).filter((F.col("ts") >= F.lit(day).cast("timestamp_ntz")) & (F.col("ts") < F.expr(f"timestamp_ntz'{day}' + interval 1 day")))
    a = tables.group(on("2024-01-15"), ["user_id"], v=A.last("value", "event_id"))
    b = tables.group(on("2024-01-14"), ["user_id"], p=A.last("value", "event_id"))
    j = joins.inner_join(a, b, "user_id", "p").filter("p > 0").select("user_id", F.round((F.col("v") - F.col("p")) / F.col("p"), 6).alias("change"))
    return tables.top(j, 10, "change", ["user_id"], down=False)


@query("SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10")
def tick_active(s, d):
    return tables.top(tables.group(ev(s, d), ["user_id"], total=F.round(A.sum_("value"), 2)), 10, "total", ["user_id"])


@query("""WITH j AS (SELECT c.event_id, c.value, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts)
SELECT event_id, round((value - seen) / seen, 6) AS spread FROM j WHERE seen > 0 ORDER BY spread DESC, event_id LIMIT 10""")
def tick_spreads(s, d):
    e = ev(s, d)
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"), F.col("event_id").alias("rid"))
    j = joins.asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value"), right, "user_id", "ts", "rid")
    return tables.top(j.filter("seen > 0").select("event_id", F.round((F.col("value") - F.col("seen")) / F.col("seen"), 6).alias("spread")), 10, "spread", ["event_id"])
