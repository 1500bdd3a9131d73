"""Queries for the single verbs, many in each, over whole tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella import system
from tessella.functions import aggregates as A
from tessella.functions import arrays as L
from tessella.functions import compare as C
from tessella.functions import linalg, text, times, udf, values
from tessella.functions import maths as M
from tessella.functions import windows as N
from tessella.operators import joins, ranges, tables
from tessella.plans.dialect import Engine, eval_
from tessella.plans.tables import table
from tessella.schema import meta_table
from tessella.session import scratch
from tessella.sources import delimited, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its oracle SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


LIST = "(SELECT min(event_id) AS id, list(CAST(value AS INT) ORDER BY event_id) AS a FROM events GROUP BY user_id, CAST(ts AS DATE))"


def lists(s: SparkSession, d: str) -> DataFrame:
    """Whole numbers of each user's events of a day, as lists; ``id`` is the first event."""
    e = table(s, d, "events").groupBy("user_id", F.to_date("ts"))
    return e.agg(F.min("event_id").alias("id"), A.values(F.rint("value").cast("int"), "event_id").alias("a")).select("id", "a")


def joined(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), ",")


# comparison, arithmetic


@query("""SELECT l_orderkey, l_linenumber, l_quantity <= 10 AS le, l_quantity BETWEEN 5 AND 15 AS btw, l_returnflag = l_linestatus AS same, CAST(l_discount = 0 AS INT) AS nought, l_quantity IN (1, 2, 3) AS member,
least(l_quantity, 7.0) AS a, greatest(l_quantity, 7.0) AS b, lower(l_returnflag) AS mixed FROM lineitem""")
def verbs_compare(s, d):
    x = table(s, d, "lineitem")
    mixed = C.xor("l_returnflag", F.lit(" "))  # exclusive or with blanks turns the case of letters
    return x.select("l_orderkey", "l_linenumber", C.lesseq("l_quantity", F.lit(10)).alias("le"), C.between("l_quantity", F.lit(5), F.lit(15)).alias("btw"), C.match("l_returnflag", "l_linestatus").alias("same"), C.not_("l_discount").alias("nought"),
                    C.in_("l_quantity", [1.0, 2.0, 3.0]).alias("member"), C.and_("l_quantity", F.lit(7.0)).alias("a"), C.or_("l_quantity", F.lit(7.0)).alias("b"), mixed.alias("mixed"))


@query(f"""SELECT id, array_to_string(list_filter(range(len(a)), lambda i: a[i + 1] % 2 = 1), ',') AS odd, array_to_string(list_filter(a, lambda v: v > 40), ',') AS large FROM {LIST}""")
def verbs_which(s, d):
    return lists(s, d).select("id", joined(C.which(F.transform("a", lambda v: (v % 2).cast("int")))).alias("odd"), joined(C.filter_("a", lambda v: v > 40)).alias("large"))


@query("""SELECT p_partkey, p_retailprice - p_size AS minus, p_size + p_retailprice AS plus, p_size * 3 AS times, -p_size AS neg, round(cos(p_size), 9) AS cos, round(tan(p_size), 6) AS tan, round(asin(p_size / 51.0), 9) AS asin, round(acos(p_size / 51.0), 9) AS acos,
round(atan(p_size), 9) AS atan, round(sinh(p_size / 20.0), 9) AS sinh, round(cosh(p_size / 20.0), 9) AS cosh FROM part""")
def verbs_numbers(s, d):
    z = F.col("p_size")
    r = lambda c, n: F.round(c, n)
    return table(s, d, "part").select(
        "p_partkey", M.subtract("p_retailprice", z).alias("minus"), M.add(z, "p_retailprice").alias("plus"), M.times(z, 3).alias("times"), M.negative(z).alias("neg"), r(M.cos(z), 9).alias("cos"), r(M.tan(z), 6).alias("tan"), r(M.asin(z / 51.0), 9).alias("asin"),
        r(M.acos(z / 51.0), 9).alias("acos"), r(M.atan(z), 9).alias("atan"), r(M.sinh(z / 20.0), 9).alias("sinh"), r(M.cosh(z / 20.0), 9).alias("cosh"))


# lists


@query(f"""SELECT id, array_to_string(a[2:], ',') AS cdr, a[1] AS car, a[len(a)] AS last, array_to_string(list_concat(a, a), ',') AS joined, array_to_string(list_concat(a[1:2], a[3:]), ',') AS flat, 1 AS one,
array_to_string(list_transform(a, lambda v: 100 - v), ',') AS rights, array_to_string(list_transform(a, lambda v: v - 100), ',') AS lefts, len(a) > 2 AS third, list_position(a, 3) - 1 AS three,
array_to_string(list_distinct(a), ',') IS NOT NULL AS some FROM {LIST}""")
def verbs_lists(s, d):
    a = F.col("a")
    three = L.search(F.lit(3), a)
    return lists(s, d).select(
        "id", joined(L.cdr(a)).alias("cdr"), L.car(a).alias("car"), L.last_of(a).alias("last"), joined(L.join(a, a)).alias("joined"), joined(L.flatten(L.split_at(F.array(F.lit(2)), a))).alias("flat"), F.size(L.enlist(a)).alias("one"),
        joined(L.mapright(lambda x, e: x - e, F.lit(100), a)).alias("rights"), joined(L.mapleft(lambda e, x: e - x, a, F.lit(100))).alias("lefts"), L.has_index(a, F.lit(2)).alias("third"), three.cast("bigint").alias("three"), L.distinct(a).isNotNull().alias("some"))


@query(f"""SELECT id, array_to_string(list_transform(range(len(a)), lambda i: list_sum(a[1:i + 1])), ',') AS sums, array_to_string(list_transform(a, lambda v: v // 2), ',') AS halves, 0 AS fix, (a[1] + 3)::BIGINT AS thrice FROM {LIST}""")
def verbs_folds(s, d):
    halves = L.mapdown(lambda v: F.floor(v / 2), "a")
    fix = L.converge(lambda v: F.floor(v / 2).cast("bigint"), F.array_max("a").cast("bigint"))
    return lists(s, d).select("id", joined(L.unfold(lambda x, y: x + y, "a")).alias("sums"), joined(halves).alias("halves"), fix.cast("int").alias("fix"), L.repeat_times(lambda v: v + 1, 3, L.car("a")).cast("bigint").alias("thrice"))


@query(f"""WITH x AS (SELECT id, a FROM {LIST} WHERE len(a) >= 2)
SELECT id, a[1] || '-' || a[2] || CASE WHEN a[1] <> a[2] THEN ',' || a[2] || '-' || a[1] ELSE '' END AS orders, '|' || a[1] || '|' || a[2] || '|' || a[1] || '-' || a[2] AS subsets, a[1] || '-' || a[2] || ',' || (a[1] + 1) || '-' || (a[2] + 1) AS turned FROM x""")
def verbs_combinatorics(s, d):
    a = F.slice("a", 1, 2).cast("array<bigint>")
    show = lambda c, sep: F.array_join(F.transform(c, lambda p: F.array_join(p.cast("array<string>"), "-")), sep)
    turned = L.transpose(L.transpose(F.array(a, F.transform(a, lambda v: v + 1))))
    return lists(s, d).filter("size(a) >= 2").select("id", show(L.permutations(a), ",").alias("orders"), show(L.powerset(a), "|").alias("subsets"), show(turned, ",").alias("turned"))


@query("SELECT a.n_name AS n_name, b.r_name AS r_name FROM nation a CROSS JOIN region b")
def cross_join(s, d):
    """Every row with every element of a list of bounded length, as the list verb has it."""
    names = table(s, d, "region").agg(A.values("r_name", "r_regionkey").alias("x")).scalar()
    return table(s, d, "nation").select("n_name", F.explode(names).alias("r_name"))


# sorting


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def sort_asc(s, d):
    return ranges.with_rank(table(s, d, "orders"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS place FROM orders")
def sort_desc_stable(s, d):
    # ranges are ascending: a descending text is ascending from the other end
    x = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    n = x.groupBy("o_orderpriority").count()
    before = n.withColumn("before", F.coalesce(F.sum("count").over(W.orderBy(F.desc("o_orderpriority")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = n.withColumn("own", F.coalesce(F.sum("count").over(W.orderBy("o_orderpriority").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("o_orderpriority", "own")
    ranked = ranges.with_rank(x, ["o_orderpriority", "o_orderkey"], "rank")
    return ranked.join(before, "o_orderpriority").join(own, "o_orderpriority").select("o_orderkey", (F.col("rank") - F.col("own") + F.col("before")).alias("place"))


@query("SELECT o_orderkey, CAST((r >= 100) AS INT) + CAST((r >= 5000) AS INT) AS piece FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)")
def table_pieces(s, d):
    return tables.pieces(table(s, d, "orders"), [100, 5000], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "piece")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS different, sum(o_orderkey) AS total FROM orders")
def verb_shuffle(s, d):
    return tables.shuffle(table(s, d, "orders"), 3).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"), F.sum("o_orderkey").alias("total"))


# text, kinds, maps


@query("""SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS f, p_size AS i, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS tail, p_name AS back, 'STAMP_2020-01-02T03:04:05.000000' AS marked, TIMESTAMP '2020-01-02 03:04:05' AS t FROM part""")
def verbs_text(s, d):
    x = table(s, d, "part")
    t = F.lit("2020-01-02 03:04:05").cast("timestamp_ntz")
    j = text.to_json(F.struct(t.alias("t")), "STAMP_")
    marked = F.get_json_object(j, "$.t")
    return x.select("p_partkey", text.parse_float(F.concat(F.col("p_retailprice").cast("string"), F.lit("x"))).alias("f"), text.parse_int(F.concat(F.col("p_size").cast("string"), F.lit(" pieces"))).cast("int").alias("i"), text.parse_float(F.regexp_replace("p_brand", "^[^0-9]*", "")).alias("tail"),
                    text.unzip_text(text.zip_text("p_name")).alias("back"), marked.alias("marked"), text.stamp_of(marked, "STAMP_").alias("t"))


@query("SELECT o_orderkey, o_custkey AS v, true AS has, false AS gone, 1 AS kept, o_orderkey IS NULL AS n, 4 AS stamp_code, -1 AS text_code, 3 AS number_code FROM orders")
def verbs_maps(s, d):
    m = values.map_(F.array(F.lit("a"), F.lit("b")), F.array("o_custkey", "o_orderkey"))
    x = table(s, d, "orders").withColumn("m", m)
    return x.select("o_orderkey", F.try_element_at(values.vals("m"), F.lit(1)).alias("v"), values.has_key("m", "a").alias("has"), values.has_key("m", "z").alias("gone"), F.size(values.delete_keys("m", ["a"])).alias("kept"), values.isnull("o_orderkey").alias("n"),
                    values.type_code("o_orderdate").alias("stamp_code"), values.type_code("o_orderpriority").alias("text_code"), values.type_code("o_totalprice").alias("number_code"))


@query("SELECT event_id, value AS x, CAST(value AS DOUBLE) AS v, CAST(NULL AS BIGINT) AS nothing, value AS right FROM events")
def verbs_values(s, d):
    return table(s, d, "events").select("event_id", values.identity("value").alias("x"), values.right(F.lit(1), "value").alias("right"), text.float_("value").alias("v"), values.type_null("bigint").alias("nothing"))


# time


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 5 MICROSECOND AS more, TIMESTAMP '2024-01-05' AS parsed, true AS later, true AS midnight, true AS first_day, CASE WHEN o_orderdate = date_trunc('day', o_orderdate) THEN 'date' ELSE 'datetime' END AS kind,
make_timestamp(CAST(epoch_us(TIMESTAMP '1994-12-31') + 604800000000 * floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1994-12-31')) / 604800000000) AS BIGINT)) AS week FROM orders""")
def verbs_times(s, d):
    # with the first of January 1995, a Sunday, as the first row: weeks start weekday + 1 days before the month's first
    week = times.time_bars("7d", "o_orderdate", F.lit("1995-01-01 00:00:00"))
    day = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return table(s, d, "orders").select(
        "o_orderkey", times.add_ns("o_orderdate", F.lit(5_000)).alias("more"), times.stamp(F.lit("2024-01-05")).alias("parsed"), (times.now() > day).alias("later"), (times.us(times.now_date()) % 86_400_000_000 == 0).alias("midnight"),
        (times.us(times.now_time()) < 86_400_000_000).alias("first_day"), times.kind("o_orderdate").alias("kind"), (week + F.expr("interval 0 days")).alias("week"))


# files


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")


@query("""SELECT o_orderkey AS i, o_totalprice AS f, o_orderstatus AS s, o_orderpriority AS e, o_orderpriority AS g, o_orderpriority AS n, o_orderdate AS a, o_orderdate AS z, TIMESTAMP '1970-01-01 10:11:12' AS y, o_custkey AS w, CAST(o_custkey AS INT) AS i4,
CAST(o_custkey % 100 AS SMALLINT) AS i2, CAST(o_custkey % 100 AS TINYINT) AS i1, o_totalprice AS v, CAST(o_custkey AS FLOAT) AS f4, CAST(o_custkey + 0.125 AS DECIMAL(18,4)) AS d, o_orderdate AS nine, left(o_orderpriority, 32) AS three, 'ABC.XY' AS r, 34201250 AS q, o_orderkey AS small FROM orders""")
def type_codes(s, d):
    """A column of each type code, written as text and read again."""
    path, o = scratch(s), _texts(s, d)
    stamp = times.format_stamp("%Y.%m.%dT%H:%M:%S.%q", "o_orderdate")
    ns = (times.us("o_orderdate") * 1000).cast("string")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    price = F.format_string("%.2f", F.col("o_totalprice").cast("double"))
    cols = [key, price, F.col("o_orderstatus"), *[F.col("o_orderpriority")] * 3, ns, stamp, F.lit("10:11:12"), cust, cust, cust % 100, cust % 100, price, cust, F.concat(cust.cast("string"), F.lit(".12509")), stamp, F.col("o_orderpriority"), F.lit("ABC   XY        "), F.lit("093001250"), F.lit("skipped"), key]
    o.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value")).write.text(path)
    names = ["i", "f", "s", "e", "g", "n", "a", "z", "y", "w", "i4", "i2", "i1", "v", "f4", "d", "nine", "three", "r", "q", "skip", "small"]
    return delimited.read_tsv(s, path, "IFSEGNAZYW421V0D93RQ*i", header_rows=0, titles=names)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, k FROM orders, (VALUES ('csv'), ('tsv'), ('psv'), ('fixed')) t(k)")
def load_tables(s, d):
    """Tables created from comma-, tab- and bar-separated and fixed-width files, and appended to."""
    o = _texts(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    low, high = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")
    got = []
    for kind, delim in (("csv", ","), ("tsv", "\t"), ("psv", "|")):
        a, b, t = scratch(s), scratch(s), scratch(s)
        delimited.write_delimited(low, a, delim)
        delimited.write_delimited(high, b, delim)
        delimited.create_table(s, t, a, delim, "ISS")
        got.append(delimited.append_table(s, t, b, delim, "ISS").withColumn("k", F.lit(kind)))
    a, b, t = scratch(s), scratch(s), scratch(s)
    for part, at in ((low, a), (high, b)):
        part.select(F.concat(F.lpad("o_orderkey", 12, " "), F.rpad("o_orderstatus", 2, " "), F.rpad("o_orderpriority", 20, " ")).alias("value")).write.text(at)
    spec = {"fields": "ISS", "widths": [12, 2, 20], "titles": ["o_orderkey", "o_orderstatus", "o_orderpriority"]}
    delimited.create_table_fixed(s, t, a, spec)
    got.append(delimited.append_table_fixed(s, t, b, spec).withColumn("k", F.lit("fixed")))
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out


HEADERS = "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 0, 'o_orderstatus'"


def _with_header(s: SparkSession, d: str, header: int) -> str:
    """A folder of files, each with ``header`` header rows; in one of them the header's text stands again as a row."""
    path = scratch(s)
    o = _texts(s, d).select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("line"), F.pmod(F.xxhash64("o_orderkey"), F.lit(5)).cast("int").alias("file"))
    again = s.createDataFrame([("o_orderkey,o_orderstatus", 3)], "line string, file int")
    head = F.lit("o_orderkey,o_orderstatus\n" * header)
    body = o.unionByName(again).groupBy("file").agg(F.array_join(F.collect_list("line"), "\n").alias("x"))
    body.select(F.concat(head, F.col("x")).alias("value"), "file").write.partitionBy("file").text(path)
    return f"{path}/*"


@query(HEADERS)
def csv_repeated_header(s, d):
    return delimited.read_csv(s, _with_header(s, d, 1), "IS")


@query(HEADERS)
def csv_many_files(s, d):
    return delimited.read_csv(s, _with_header(s, d, 3), "IS", header_rows=3)


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 0, 'o'")
def fixed_header(s, d):
    """Records of fixed width after a header row, whose text stands again as a row."""
    path, o = scratch(s), _texts(s, d)
    row = F.concat(F.lpad("o_orderkey", 10, " "), F.rpad("o_orderstatus", 2, " "))
    header = "o_orderkeyo "
    lines = o.agg(F.array_join(F.collect_list(row), "\n").alias("x")).select(F.concat(F.lit(header + "\n" + header + "\n"), F.col("x")).alias("value"))
    lines.write.text(path)
    spec = {"fields": "IS", "widths": [10, 2], "titles": ["o_orderkey", "o_orderstatus"], "header_rows": 1}
    return delimited.read_fixed(s, path, **spec)


@query("SELECT o_orderkey, o_orderstatus || chr(10) || o_orderpriority AS text FROM orders")
def csv_line_feeds(s, d):
    """Line feeds within quoted fields, in files of any size."""
    path = scratch(s)
    _texts(s, d).select(F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit("\n"), F.col("o_orderpriority"), F.lit('"')).alias("value")).write.text(path)
    return delimited.read_csv(s, path, "IS", header_rows=0, titles=["o_orderkey", "text"], quoted_line_feeds=True)


@query("SELECT p_name AS line FROM part")
def text_lines(s, d):
    path = scratch(s)
    table(s, d, "part").select("p_name").write.text(path)
    return store.lines(s, path)


# storage hints, checks


@query("SELECT p_partkey, CAST(p_size AS TINYINT) AS p_size, left(p_name, 32) AS p_name FROM part")
def verbs_storage(s, d):
    x = system.nonnull(table(s, d, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    x = system.hashed(system.indexed(system.unique(x, "p_partkey"), "p_size"))
    return system.compressed(x, p_size="INT1", p_name="STR32")


@query("SELECT * FROM (VALUES ('o_orderdate', false, true), ('o_orderkey', true, true), ('o_custkey', false, true)) t(name, sorted, on_disk)")
def verb_meta_table(s, d):
    x = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderkey")
    return meta_table(x).select("name", "sorted", "on_disk")


@query("SELECT * FROM (VALUES ('display', true), ('eval', true), ('extract', true), ('find', true), ('has_column', true), ('help', true), ('reserved', true), ('send_async', true), ('send_sync', true), ('sleep', true), ('table', true), ('tables', true)) t(verb, ok)")
def verbs_session(s, d):
    """Verbs around queries, each held against what it has to give."""
    n = table(s, d, "nation")
    n.createOrReplaceTempView("nation_seen")
    rows = tables.extract(n.orderBy("n_nationkey").select("n_name"))
    small = tables.table(s, ["a", "b"], [[1, 2], ["x"]])
    got = {
        "send_sync": system.send_sync(s, "select count(*) as n from nation_seen")[0].n == n.count(), "send_async": system.send_async(s, "select :x + 1 as y", x=2).result()[0].y == 3, "tables": "nation_seen" in system.tables(s), "sleep": system.timing(system.sleep, 5)[1] >= 4,
        "help": "nulls" in system.help_("sort"), "reserved": "select" in system.reserved(), "extract": len(rows) == n.count(), "table": tables.extract(small.orderBy("a")) == [[1, 2], ["x", "x"]], "has_column": tables.has_column(n, "n_name") and not tables.has_column(n, "x"),
        "eval": eval_(s, "3 * 2 + 1") == 9, "find": system.find("left_join") is joins.left_join, "display": system.debug(n) != "",
    }
    return s.createDataFrame(sorted(got.items()), "verb string, ok boolean")


# user functions


@query("SELECT event_type, sum(CAST(value AS DOUBLE) * 2) > 0 AS positive, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY 1")
def user_functions(s, d):
    e = table(s, d, "events")
    double = udf.vector(lambda x: x * 2, "double")
    spread = udf.aggregate(lambda x: float(x.max() - x.min()), "double")
    half = udf.parallel(e.select("event_type", "value"), lambda p: p.assign(value=p.value / 2), "event_type string, value double")
    n = udf.table_function(half, ["event_type"], lambda p: pd.DataFrame({"event_type": [p.event_type.iloc[0]], "n": [len(p)]}), "event_type string, n bigint")
    a = e.groupBy("event_type").agg((F.sum(double("value")) > 0).alias("positive"))
    b = e.groupBy("event_type").agg(spread("value").alias("spread"))
    return a.join(b, "event_type").join(n, "event_type")


# matrices, correlation


@query("SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM range(8) a(i), range(8) b(j)")
def matrix_inverse(s, d):
    """The inverse of the embeddings' second moments (their first eight places) times the moments themselves."""
    m = table(s, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("j", "v")).select("vec_id", "j", F.col("v").cast("double").alias("v"))
    moments = linalg.mmul(m.select(F.col("j").alias("i"), F.col("vec_id").alias("j"), "v"), m.select(F.col("vec_id").alias("i"), "j", "v"))
    out = linalg.mmul(moments, linalg.minv(moments))
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.abs(F.round("v", 6)).alias("v"))


@query("""WITH x AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.event_type AS a, b.event_type AS b, round(corr(a.v, b.v), 6) AS r, count(*) AS days FROM x a JOIN x b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def hist_pairwise_correlation(s, d):
    """Correlations of the daily means of each two of a chosen set of series, from one row per day."""
    e = table(s, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    days = e.groupBy(F.to_date("ts").alias("day")).pivot("event_type", kinds).agg(F.avg("value"))
    both = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1:]]
    cols = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))), 6).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("days")) for a, b in both]
    return days.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


# the language


def _engine(s, d) -> Engine:
    e = Engine(s, variables={"lim": 40, "kinds": ["click", "view"]})
    e.add("events", table(s, d, "events"), ["ts", "event_id"])
    e.add("orders", table(s, d, "orders"), ["o_orderkey"])
    e.add("customer", table(s, d, "customer"), ["c_custkey"])
    return e


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def dialect_in_select(s, d):
    return _engine(s, d).run("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0), o_totalprice > (select avg(o_totalprice) from orders)")


@query("""SELECT event_id, round(avg(value) OVER w5, 6) AS m, lag(value, 2, 0.0) OVER w AS back, lead(value, 1, 0.0) OVER w AS ahead, round(sum(value) OVER (ORDER BY ts, event_id), 2) AS total FROM events
WINDOW w AS (ORDER BY ts, event_id), w5 AS (ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def dialect_moving(s, d):
    """Moving functions over the whole table, which no single task sees."""
    x = _engine(s, d).run("select event_id, mavg(5, value) as m, shift(2, value, 0.0) as back, shift(-1, value, 0.0) as ahead, rsum(value) as total from events")
    return x.select("event_id", F.round("m", 6).alias("m"), "back", "ahead", F.round("total", 2).alias("total"))


@query("""WITH m AS (SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN value - coalesce(lag(value) OVER (PARTITION BY event_type IN ('click', 'view') ORDER BY ts, event_id), 0) END AS step, value FROM events)
SELECT event_id, coalesce(step, value) AS value FROM m""")
def dialect_update_moving(s, d):
    return _engine(s, d).run("update events set value = deltas(value) where event_type in kinds").select("event_id", "value")


@query("SELECT event_type, count(*) AS n, round(max(value) * 2, 4) AS high FROM events WHERE value > 40 GROUP BY 1 ORDER BY n DESC LIMIT 3")
def dialect_order(s, d):
    x = _engine(s, d).run("select count(*) as n, max(value) * 2 as high from events where value > lim group by event_type order by n desc limit 3")
    return x.withColumn("high", F.round("high", 4))


@query("SELECT DISTINCT event_type FROM events WHERE value > 3")
def dialect_distinct(s, d):
    return _engine(s, d).run("select distinct event_type from events where value > 3")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 20 UNION ALL SELECT -1, 5 UNION ALL SELECT -2, NULL")
def dialect_literals(s, d):
    e = _engine(s, d)
    e.add("prices", e.run("select o_orderkey, o_totalprice from orders where o_orderkey > 20"), ["o_orderkey"])
    return e.run("insert into prices values {[{o_orderkey: -1, o_totalprice: 5}, {o_orderkey: -2}]}")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY 1")
def dialect_nested_keys(s, d):
    from tessella.operators.atlas import atlas

    e = _engine(s, d)
    e.add("records", atlas(table(s, d, "events"), "props", ["event_id"]))
    return e.run("select count(*) as n, sum(v.k) as total from records group by v.k")


@query("SELECT event_id, round(value * 2, 6) AS twice FROM events WHERE value * 2 > 50")
def dialect_user_function(s, d):
    e = _engine(s, d)
    e.functions["twice"] = udf.vector(lambda x: x * 2, "double")
    return e.run("select event_id, twice(value) as twice from events where twice(value) > 50").withColumn("twice", F.round("twice", 6))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r IN (0, 7, 700)")
def dialect_places(s, d):
    return _engine(s, d).run("events[[0, 7, 700]]").select("event_id", "event_type")
