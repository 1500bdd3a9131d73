"""The general problems' queries (p1, p2, p3, p5, p6) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import grid, records, rolling, spikes, stamps
from tessella.plans.tables import table

SERIES = "simple10q"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines = records.rejected(records.parsed_lines(table(spark, d, "simple_qesc"))).select(F.lit("simple_qesc").alias("tab"), F.col("line_id").alias("row_id"))
    broken = records.rejected(records.parsed_stamps(table(spark, d, "data_stamps"))).select(F.lit("data_stamps").alias("tab"), F.col("intcol").alias("row_id"))
    return lines.unionByName(broken)


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parsed_lines(table(spark, d, "simple_qesc")))


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(records.parsed_lines(table(spark, d, "simple_qesc"))).select("line_id", "file_name", "line_no", "edits", "reason")


def p1_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Records whose quotes and delimiters are right, but not all of their fields."""
    x = records.rejected(records.parsed_lines(table(spark, d, "simple_qesc")))
    return x.filter(F.col("edits").isNull()).select("line_id", "reason")


def p1_loaded_stamps(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parsed_stamps(table(spark, d, "data_stamps")))


def p1_rejected_stamps(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(records.parsed_stamps(table(spark, d, "data_stamps"))).select("intcol", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = rolling.trailing_totals(table(spark, d, SERIES))
    return t.filter((F.col("day_no") >= 30) & (F.col("total_7") * 2 > F.col("total_30"))).select("enumstring", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    t = rolling.trailing_totals(table(spark, d, SERIES))
    return t.select("enumstring", F.col("day").cast("string").alias("day"), "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return stamps.suspicious(stamps.normalised(table(spark, d, "data_stamps")))


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    return stamps.normalised(table(spark, d, "data_stamps"))


def p3_utc(spark: SparkSession, d: str) -> DataFrame:
    """The values that denote an instant."""
    x = stamps.normalised(table(spark, d, "data_stamps")).filter("state = 'ok'")
    return x.select("intcol", "field", F.unix_micros(F.col("instant").cast("timestamp")).alias("utc_us"), "nano")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.empty_runs(table(spark, d, SERIES)).select("enumstring", F.col("first_cell").alias("first_hour"), F.col("last_cell").alias("last_hour"))


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    s = grid.regular_series(table(spark, d, SERIES))
    return s.select("enumstring", F.col("cell").alias("hour"), F.col("n").alias("readings"), F.col("total").alias("volume"), F.round("level", 6).alias("close"), F.round("twa", 6).alias("close_twa"), F.round("coverage", 9).alias("coverage"), "state")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged_readings(table(spark, d, SERIES)).select("enumstring", "stamp_us")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged_readings(table(spark, d, SERIES)).withColumn("deviation", F.round("deviation", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_rejected, p1_invalid, p1_loaded_stamps, p1_rejected_stamps, p2_found, p2_totals, p3_found, p3_instants, p3_utc, p5_found, p5_series, p6_found, p6_flags)}

READING = """
r AS (SELECT enumstring, datetime, arg_min(struct_pack(o := open, h := high, l := low, c := close, v := volume), rowid) AS x
      FROM simple10q WHERE enumstring IS NOT NULL AND datetime IS NOT NULL AND datetime <> TIMESTAMP '1970-01-01 00:00:00'
      GROUP BY 1, 2),
rd AS (SELECT enumstring, datetime, epoch_us(datetime) AS us, x.o AS open, x.h AS high, x.l AS low, x.c AS close, x.v AS volume FROM r)
"""

DAYS = f"""
WITH {READING},
d AS (SELECT enumstring, CAST(datetime AS DATE) AS day, coalesce(sum(volume), 0) AS total, count(volume) AS n FROM rd GROUP BY 1, 2),
g AS (SELECT enumstring, first_day, CAST(unnest(generate_series(CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT enumstring, min(day) AS first_day, max(day) AS last_day FROM d GROUP BY 1)),
f AS (SELECT g.enumstring, g.day, date_diff('day', first_day, g.day) + 1 AS day_no, coalesce(total, 0) AS total, coalesce(n, 0) AS n
      FROM g LEFT JOIN d ON g.enumstring = d.enumstring AND g.day = d.day),
t AS (SELECT enumstring, day, day_no, CAST(sum(total) OVER w7 AS BIGINT) AS total_7, sum(n) OVER w7 AS n_7, CAST(sum(total) OVER w30 AS BIGINT) AS total_30, sum(n) OVER w30 AS n_30
      FROM f WINDOW w7 AS (PARTITION BY enumstring ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY enumstring ORDER BY day ROWS 29 PRECEDING))
"""

P5_SERIES = f"""
WITH {READING},
c AS (SELECT enumstring, us // 3600000000 AS hour, count(*) AS readings, sum(volume) AS volume, arg_max(close, us) FILTER (close IS NOT NULL) AS close FROM rd GROUP BY 1, 2),
g AS (SELECT enumstring, unnest(generate_series(min(hour), max(hour))) AS hour FROM c GROUP BY 1),
v AS (SELECT enumstring, us, close, lead(us) OVER (PARTITION BY enumstring ORDER BY us) AS nx FROM rd WHERE close IS NOT NULL),
i AS (SELECT enumstring, us, close, least(us + 3600000000, coalesce(nx, (us // 3600000000 + 1) * 3600000000)) AS til FROM v),
h AS (SELECT enumstring, us, close, til, unnest(generate_series(us // 3600000000, (til - 1) // 3600000000)) AS hour FROM i),
a AS (SELECT enumstring, hour, sum(close * (least(til, (hour + 1) * 3600000000) - greatest(us, hour * 3600000000))) AS area,
             sum(least(til, (hour + 1) * 3600000000) - greatest(us, hour * 3600000000)) AS covered FROM h GROUP BY 1, 2),
s AS (SELECT g.enumstring, g.hour, coalesce(readings, 0) AS readings, CASE WHEN readings IS NULL THEN 0 ELSE volume END AS volume,
             last_value(c.close IGNORE NULLS) OVER (PARTITION BY g.enumstring ORDER BY g.hour) AS close
      FROM g LEFT JOIN c ON g.enumstring = c.enumstring AND g.hour = c.hour)
SELECT s.enumstring, s.hour, readings, CAST(volume AS BIGINT) AS volume, round(close, 6) AS close, round(area / covered, 6) AS close_twa, round(coalesce(covered, 0) / 3600000000, 9) AS coverage,
       CASE WHEN readings > 0 THEN 'reading' WHEN close IS NOT NULL THEN 'filled' ELSE 'unknown' END AS state
FROM s LEFT JOIN a ON s.enumstring = a.enumstring AND s.hour = a.hour
"""

FLAGS = f"""
WITH {READING},
x AS (SELECT *, coalesce(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false) OR coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)
        OR coalesce(high < low, false) OR coalesce(open < low, false) OR coalesce(open > high, false) OR coalesce(close < low, false) OR coalesce(close > high, false) AS impossible FROM rd),
l AS (SELECT enumstring, us, impossible, unnest([1, 2, 4, 8]) AS b, unnest([open, high, low, close]) AS v FROM x),
n AS (SELECT *, lag(v) OVER w IS DISTINCT FROM v AS new FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY enumstring, b ORDER BY us)),
z AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY enumstring, b ORDER BY us) AS run FROM n),
fr AS (SELECT enumstring, us, b FROM (SELECT *, count(*) OVER (PARTITION BY enumstring, b, run) AS len FROM z) WHERE len >= 8),
k AS (SELECT enumstring, us, b, v, row_number() OVER (PARTITION BY enumstring, b ORDER BY us) AS i, abs(v - lag(v) OVER (PARTITION BY enumstring, b ORDER BY us)) AS change FROM l WHERE v IS NOT NULL AND NOT impossible),
md AS (SELECT enumstring, b, median(change) AS m FROM k GROUP BY 1, 2),
y AS (SELECT enumstring, b, i, lag(v) OVER w AS p, v AS v1, lead(v, 1) OVER w AS v2, lead(v, 2) OVER w AS v3, lead(v, 3) OVER w AS v4, m FROM k JOIN md USING (enumstring, b) WINDOW w AS (PARTITION BY enumstring, b ORDER BY i)),
st AS (SELECT enumstring, b, i, 1 AS r FROM y WHERE v1 - greatest(p, v2) > 10 * m AND p IS NOT NULL AND v2 IS NOT NULL OR least(p, v2) - v1 > 10 * m AND p IS NOT NULL AND v2 IS NOT NULL
       UNION ALL SELECT enumstring, b, i, 2 FROM y WHERE p IS NOT NULL AND v3 IS NOT NULL AND (least(v1, v2) - greatest(p, v3) > 10 * m OR least(p, v3) - greatest(v1, v2) > 10 * m)
       UNION ALL SELECT enumstring, b, i, 3 FROM y WHERE p IS NOT NULL AND v4 IS NOT NULL AND (least(v1, v2, v3) - greatest(p, v4) > 10 * m OR least(p, v4) - greatest(v1, v2, v3) > 10 * m)),
sp AS (SELECT DISTINCT k.enumstring, k.us, k.b FROM (SELECT enumstring, b, unnest(range(i, i + r)) AS i FROM st) s JOIN k USING (enumstring, b, i)),
fl AS (SELECT enumstring, us, CAST(sum(f) AS INT) AS frozen, CAST(sum(s) AS INT) AS spike FROM (SELECT enumstring, us, b AS f, 0 AS s FROM fr UNION ALL SELECT enumstring, us, 0, b FROM sp) GROUP BY 1, 2),
hd AS (SELECT enumstring, us, b, v, count(*) OVER w AS n, median(v) OVER w AS med, mad(v) OVER w AS mad FROM k WINDOW w AS (PARTITION BY enumstring, b ORDER BY us ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
dv AS (SELECT enumstring, us, max(abs(v - med) / greatest(mad, m)) AS deviation FROM hd JOIN md USING (enumstring, b) WHERE n = 7 AND greatest(mad, m) > 0 GROUP BY 1, 2),
flags AS (SELECT x.enumstring, x.us AS stamp_us, impossible, coalesce(frozen, 0) AS frozen, coalesce(spike, 0) AS spike, round(deviation, 6) AS deviation
          FROM x LEFT JOIN dv ON x.enumstring = dv.enumstring AND x.us = dv.us LEFT JOIN fl ON x.enumstring = fl.enumstring AND x.us = fl.us WHERE impossible OR frozen > 0 OR spike > 0)
"""

FIELD = r'''("(?:[^"\\]|""|\\.)*"|[^DELIM"\n]*)'''


def _record(inside: str, between: str) -> str:
    """Pattern of a record of eight fields; the delimiter as it stands within brackets and between fields."""
    return between.join([FIELD.replace("DELIM", inside)] * 8)


# an escaped character stands for itself; doubled quotes need no decoding, as no typed value has a quote
P1 = r"""
WITH a AS (SELECT line_id, file_name, line_no, CASE WHEN line LIKE '%' || chr(13) THEN left(line, -1) ELSE line END AS line, delim FROM simple_qesc WHERE line_no > 1),
b AS (SELECT line_id, file_name, line_no, line, CASE delim WHEN ',' THEN 'COMMA' WHEN ';' THEN 'SEMICOLON' WHEN '|' THEN 'PIPE' ELSE 'TAB' END AS p FROM a WHERE trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
c AS (SELECT line_id, file_name, line_no, regexp_full_match(line, p, 's') AS ok, [GROUPS] AS f FROM b),
d AS (SELECT line_id, file_name, line_no, ok, f AS raw, list_transform(f, lambda x: CASE WHEN x LIKE '"%' THEN regexp_replace(substr(x, 2, length(x) - 2), '\\(.)', '\1', 'gs') ELSE x END) AS f FROM c),
bad AS (SELECT 'simple_qesc' AS tab, line_id AS row_id FROM d WHERE NOT ok
  OR len(list_filter(f[1:4], lambda x: x <> '' AND NOT regexp_full_match(x, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)([eE][+-]?[0-9]+)?'))) > 0
  OR (f[5] <> '' AND (NOT regexp_full_match(f[5], '[+-]?[0-9]+') OR try_cast(f[5] AS BIGINT) IS NULL))
  OR (f[8] <> '' AND NOT (regexp_full_match(f[8], 'STAMP[.][0-9]{3}') AND try_cast(replace(left(f[8], 10), '.', '-') AS DATE) IS NOT NULL))),
st AS (SELECT intcol, unnest([brokenmillis, brokennanos]) AS x, unnest([3, 9]) AS n FROM data_stamps)
SELECT * FROM bad UNION ALL
SELECT DISTINCT 'data_stamps', intcol FROM st
WHERE x <> '' AND NOT (regexp_full_match(x, 'STAMP([.][0-9]+)?') AND length(x) IN (19, 20 + n) AND try_cast(replace(left(x, 10), '.', '-') AS DATE) IS NOT NULL)
"""
for _name, _text in {
    "COMMA": _record(",", ","), "SEMICOLON": _record(";", ";"), "PIPE": _record("|", "[|]"), "TAB": _record(r"\t", r"\t"), "GROUPS": ", ".join(f"regexp_extract(line, p, {i}, 's')" for i in range(1, 9)),
    "STAMP": "[0-9]{4}[.][0-9]{2}[.][0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]",
}.items():
    P1 = P1.replace(_name, _text)
P1_LOADED = P1[:P1.index("st AS (SELECT")].rstrip(" ,\n") + r"""
SELECT line_id, file_name, line_no, CAST(nullif(f[1], '') AS DOUBLE) AS open, CAST(nullif(f[2], '') AS DOUBLE) AS close, CAST(nullif(f[3], '') AS DOUBLE) AS high, CAST(nullif(f[4], '') AS DOUBLE) AS low, CAST(nullif(f[5], '') AS BIGINT) AS volume,
  CASE WHEN raw[6] LIKE '"%' THEN regexp_replace(replace(substr(raw[6], 2, length(raw[6]) - 2), '""', '"'), '\\(.)', '\1', 'gs') ELSE raw[6] END AS astring,
  CASE WHEN raw[7] LIKE '"%' THEN regexp_replace(replace(substr(raw[7], 2, length(raw[7]) - 2), '""', '"'), '\\(.)', '\1', 'gs') ELSE raw[7] END AS en_umstring,
  try_strptime(f[8], '%Y.%m.%dT%H:%M:%S.%g') AS datetime
FROM d WHERE ok AND line_id NOT IN (SELECT row_id FROM bad)
"""
P1_INVALID = P1[:P1.index("bad AS (SELECT")].rstrip(" ,\n") + r""",
e AS (SELECT line_id, unnest(['open', 'close', 'high', 'low', 'volume', 'datetime']) AS name, unnest(['F', 'F', 'F', 'F', 'I', 'Z']) AS code, unnest([1, 2, 3, 4, 5, 8]) AS i, unnest(f[1:5] || f[8:8]) AS x FROM d WHERE ok),
w AS (SELECT * FROM e WHERE x <> '' AND NOT CASE code WHEN 'F' THEN regexp_full_match(x, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)([eE][+-]?[0-9]+)?') WHEN 'I' THEN regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL
  ELSE regexp_full_match(x, '[0-9]{4}[.][0-9]{2}[.][0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][.][0-9]{3}') AND try_cast(replace(left(x, 10), '.', '-') AS DATE) IS NOT NULL END)
SELECT line_id, string_agg(name || ' is not valid for ' || code, '; ' ORDER BY i) AS reason FROM w GROUP BY 1
"""
BROKEN = r"""
WITH s AS (SELECT *, [brokenmillis, brokennanos] AS x FROM data_stamps),
t AS (SELECT *, list_transform([1, 2], lambda i: x[i] IS NULL OR x[i] = '' OR (regexp_full_match(x[i], '[0-9]{4}[.][0-9]{2}[.][0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?') AND length(x[i]) IN (19, 20 + CASE i WHEN 1 THEN 3 ELSE 9 END) AND try_cast(replace(left(x[i], 10), '.', '-') AS DATE) IS NOT NULL)) AS ok FROM s)
"""
WHEN = "CASE WHEN NAME <> '' THEN strptime(left(NAME, 19), '%Y.%m.%dT%H:%M:%S') + CAST(rpad(substr(NAME, 21, 6), 6, '0') AS BIGINT) * INTERVAL 1 MICROSECOND END AS NAME, CASE WHEN NAME <> '' THEN CAST(rpad(substr(NAME, 21, 9), 9, '0') AS BIGINT) END AS NAME_ns"

# local times are tried at every quarter-hour offset; a time that fits once is read
P3 = r"""
WITH v AS (SELECT intcol, zone, unnest(['millis', 'micros', 'nanos', 'seminanos']) AS field, unnest([millis, micros, nanos, seminanos]) AS x FROM data_stamps),
m AS (SELECT *, regexp_extract(x, '^(.*?)(?:[.,]([0-9]{1,9}))?( [AP]M)?(Z| [A-Z]{3,4}| ?[+-][0-9]{2}(?::?[0-9]{2})?(?:\[[A-Za-z_/]+\])?| [A-Za-z]+/[A-Za-z_]+)?$', ['head', 'frac', 'half', 'tail']) AS m FROM v WHERE x IS NOT NULL),
t AS (SELECT *, trim(m.tail) AS tail, epoch(try_strptime(m.head || m.half, ['%Y.%m.%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d-%b-%Y %H:%M:%S', '%Y%m%dT%H%M%S', '%b %d %Y %I:%M:%S %p']))::BIGINT AS local FROM m),
k AS (SELECT *, CASE WHEN tail = 'Z' THEN 0
  WHEN regexp_matches(tail, '^[+-]') THEN (CASE WHEN tail LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(tail, 2, 2) AS BIGINT) * 3600 + coalesce(try_cast(regexp_extract(tail, '^.[0-9]{2}:?([0-9]{2})', 1) AS BIGINT), 0) * 60)
  ELSE CAST(map {'GMT': 0, 'UTC': 0, 'EST': -18000, 'EDT': -14400, 'CET': 3600, 'CEST': 7200, 'AEST': 36000, 'AEDT': 39600}[tail] AS BIGINT) END AS off,
  CASE WHEN tail LIKE '%/%' AND tail NOT LIKE '%[%' THEN tail WHEN tail = '' THEN zone END AS place FROM t),
z AS (SELECT intcol, field, list(local - o * 900) AS us FROM k, range(-56, 60) r(o)
  WHERE local IS NOT NULL AND place IS NOT NULL AND epoch(timezone(place, to_timestamp(local - o * 900)))::BIGINT = local GROUP BY 1, 2),
s AS (SELECT k.intcol, k.field, CASE WHEN regexp_full_match(x, '[0-9]{10}|[0-9]{13}|[0-9]{16}|[0-9]{19}') THEN CAST(left(x, 10) AS BIGINT)
  WHEN off IS NOT NULL THEN local - off WHEN len(z.us) = 1 THEN z.us[1] END AS sec FROM k LEFT JOIN z ON k.intcol = z.intcol AND k.field = z.field),
o AS (SELECT a.intcol, a.field, any_value(a.sec) AS sec, list(b.sec) AS others FROM s a LEFT JOIN s b ON a.intcol = b.intcol AND a.field <> b.field AND b.sec IS NOT NULL GROUP BY 1, 2)
SELECT intcol, field FROM o WHERE sec IS NULL OR len(list_filter(others, lambda y: y <> sec AND 2 * len(list_filter(others, lambda w: w = y)) > len(list_filter(others, lambda w: w IS NOT NULL)))) > 0
"""

P3_UTC = P3[:P3.index("o AS (SELECT a.intcol")].rstrip(" ,\n").replace("s AS (SELECT k.intcol, k.field,", "s AS (SELECT k.intcol, k.field, CAST(rpad(CASE WHEN regexp_full_match(x, '[0-9]+') THEN substr(x, 11) ELSE m.frac END, 9, '0') AS BIGINT) AS nano,")

ORACLE = {
    "p1_found": P1,
    "p1_loaded": P1_LOADED,
    "p1_invalid": P1_INVALID,
    "p1_rejected_stamps": BROKEN + "SELECT intcol, concat_ws('; ', CASE WHEN NOT ok[1] THEN 'brokenmillis is not a stamp with 3 or no fraction digits' END, CASE WHEN NOT ok[2] THEN 'brokennanos is not a stamp with 9 or no fraction digits' END) AS reason FROM t WHERE NOT (ok[1] AND ok[2])",
    "p1_loaded_stamps": BROKEN + f"SELECT intcol, millis, micros, nanos, seminanos, zone, {WHEN.replace('NAME', 'brokenmillis')}, {WHEN.replace('NAME', 'brokennanos')} FROM t WHERE ok[1] AND ok[2]",
    "p3_utc": P3_UTC + " SELECT intcol, field, sec * 1000000 + nano // 1000 AS utc_us, nano FROM s WHERE sec IS NOT NULL",
    "p3_found": P3,
    "p2_found": DAYS + "SELECT enumstring, strftime(day, '%Y-%m-%d') AS day FROM t WHERE day_no >= 30 AND total_7 * 2 > total_30",
    "p2_totals": DAYS + "SELECT enumstring, strftime(day, '%Y-%m-%d') AS day, total_7, round(total_7 / nullif(n_7, 0), 6) AS avg_7, total_30, round(total_30 / nullif(n_30, 0), 6) AS avg_30 FROM t",
    "p5_found": f"WITH {READING}, c AS (SELECT DISTINCT enumstring, us // 3600000000 AS h FROM rd), n AS (SELECT enumstring, h, lead(h) OVER (PARTITION BY enumstring ORDER BY h) AS nx FROM c) SELECT enumstring, h + 1 AS first_hour, nx - 1 AS last_hour FROM n WHERE nx > h + 1",
    "p5_series": P5_SERIES,
    "p6_found": FLAGS + "SELECT enumstring, stamp_us FROM flags",
    "p6_flags": FLAGS + "SELECT * FROM flags",
}
