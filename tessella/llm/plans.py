"""The training-data problems' queries (p4, p7, p8, p9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import digest, mixing, packing, repetition
from tessella.llm.tokens import count_tokens
from tessella.plans.tables import table
from tessella.session import durable, spread


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.percentiles(table(spark, d, "simple10q"))


def p4_certified(spark: SparkSession, d: str) -> DataFrame:
    """Number of values, and whether the exact ranks certify the stated error."""
    return digest.percentiles(table(spark, d, "simple10q")).select("enumstring", "metric", "p", "n", "within")


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    """What the days' digests say of number and range."""
    x = digest.digests(table(spark, d, "simple10q"))
    weights = F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return x.groupBy(F.col("k").alias("enumstring"), "metric", F.col("part").alias("day")).agg(F.sum("n").alias("n"), F.sum(weights).alias("weight"), F.min("lo").alias("low"), F.max("hi").alias("high"))


def p4_digests(spark: SparkSession, d: str) -> DataFrame:
    return digest.digests(table(spark, d, "simple10q"))


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The capacities; the table has a handful of rows by contract."""
    return [(r.pack_kind, r.capacity_tokens) for r in table(spark, d, "pack_sizes").collect()]


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(spread(docs.select("doc_id", "text")).select("doc_id", count_tokens(F.col("text")).alias("n_tokens")), _packs(spark, d), items=docs.count())


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packing(spark, d), _packs(spark, d))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is packed, and whether it has a container."""
    x = p7_packing(spark, d).groupBy("pack_kind", "doc_id")
    return x.agg(F.max(F.col("container").isNotNull()).alias("placed"), F.count_if(F.col("first_token") == 0).alias("n"))


def p7_broken(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: containers too full, documents cut that fit, or with gaps between their pieces."""
    x = p7_packing(spark, d).join(table(spark, d, "pack_sizes"), "pack_kind")
    full = x.filter("container is not null").groupBy("pack_kind", F.col("container").alias("id")).agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("cap")).filter("n > cap").select("pack_kind", F.lit("too full").alias("what"), "id")
    docs = x.groupBy("pack_kind", F.col("doc_id").alias("id")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("capacity_tokens").alias("cap"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("first_token").alias("starts"))
    cut = docs.filter("pieces > greatest(1, ceil(n / cap))").select("pack_kind", F.lit("cut").alias("what"), "id")
    gaps = docs.filter("end != n or starts != pieces").select("pack_kind", F.lit("gaps").alias("what"), "id")
    return full.unionByName(cut).unionByName(gaps)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return durable(spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sized(spark, d), mixing.targets_of(table(spark, d, "source_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, goal = _sized(spark, d), mixing.targets_of(table(spark, d, "source_targets"))
    return mixing.shares(mixing.mixture(sized, goal), sized, goal)


def p8_reached(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source has its share, to a thousandth or the size of one document (they are used whole), and
    no document is used too often."""
    sized, goal = _sized(spark, d), mixing.targets_of(table(spark, d, "source_targets"))
    mixed = durable(mixing.mixture(sized, goal))
    one = mixed.agg((F.max("n_tokens") / F.sum("n_tokens")).alias("x")).scalar()
    x = mixing.shares(mixed, sized, goal)
    return x.select("source", "target_share", (F.abs(F.col("share") - F.col("target_share")) <= F.greatest(F.lit(0.001), one)).alias("reached"), (F.col("used_at_most") <= F.col("max_repeats")).alias("allowed"))


def p8_broken(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: documents used more often than their source allows, or twice in one epoch, or none of a source's."""
    x = p8_mixture(spark, d).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("epoch").alias("epochs"))
    bad = x.join(table(spark, d, "source_targets"), "source").filter("n > max_repeats or epochs != n")
    return bad.select("source", "doc_id", "n")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    judged = repetition.verdicts(table(spark, d, "documents"), limits={"phrase": 0.25})
    return judged.filter(F.col("verdict") == "repetitive").select("doc_id")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(repetition.verdicts(table(spark, d, "documents")))


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    measured = durable(repetition.repetition(table(spark, d, "documents"), keep=("source",)))
    return _rounded(repetition.host_rates(measured, "source", repetition.LIMITS))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_digests, p4_certified, p4_days, p7_packing, p7_fill, p7_documents, p7_broken, p8_mixture, p8_shares, p8_reached, p8_broken, p9_found, p9_documents, p9_hosts)}
P4 = """
WITH r AS (SELECT enumstring, datetime, arg_min(struct_pack(v := volume, c := close), rowid) AS x FROM simple10q
  WHERE enumstring IS NOT NULL AND datetime IS NOT NULL AND datetime <> TIMESTAMP '1970-01-01 00:00:00' GROUP BY 1, 2),
v AS (SELECT enumstring, datetime, unnest(['volume', 'close']) AS metric, unnest([CAST(x.v AS DOUBLE), x.c]) AS v FROM r)
"""
P9 = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS total FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, total, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM w),
r AS (SELECT doc_id, i, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS n FROM g WHERE i <= total - 7) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, total, i + k AS i FROM r, range(8) t(k))
"""
# sentences and lines as their words; the prior's parameters by moments
P9_HOSTS = r""",
u AS (SELECT doc_id, 'sentence' AS rule, unnest(regexp_split_to_array(lower(text), '[.!?]+[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|\n')) AS u FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'line', unnest(string_split(lower(text), chr(10))) FROM documents WHERE text <> ''),
un AS (SELECT doc_id, rule, array_to_string(regexp_extract_all(u, '[\p{L}\p{N}_]+'), ' ') AS u FROM u),
us AS (SELECT doc_id, rule, u, count(*) AS n FROM un WHERE u <> '' GROUP BY ALL),
sh AS (SELECT doc_id, rule, sum((n - 1) * length(u)) / sum(n * length(u)) AS x FROM us GROUP BY ALL),
cw AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1), ww AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
ms AS (SELECT d.doc_id, d.source, coalesce(ww.n, 0) AS words, coalesce(cw.n, 0) AS repeated_words, coalesce(cw.n / ww.n, 0) AS phrase, coalesce(s.x, 0) AS sentence, coalesce(l.x, 0) AS line
  FROM documents d LEFT JOIN ww USING (doc_id) LEFT JOIN cw USING (doc_id) LEFT JOIN sh s ON s.doc_id = d.doc_id AND s.rule = 'sentence' LEFT JOIN sh l ON l.doc_id = d.doc_id AND l.rule = 'line'),
ho AS (SELECT source, count(*) AS docs, count_if(phrase >= 0.25) AS phrase_fails, count_if(sentence >= 0.3) AS sentence_fails, count_if(line >= 0.3) AS line_fails, count_if(phrase >= 0.25 OR sentence >= 0.3 OR line >= 0.3) AS fails FROM ms GROUP BY 1),
mo AS (SELECT sum(docs) AS n, sum(fails) AS x, count(*) AS h, avg(fails / docs) AS m, var_samp(fails / docs) AS v, avg(1 / docs) AS inv FROM ho),
we AS (SELECT *, h < 2 OR m IS NULL OR m = 0 OR m >= 1 OR v IS NULL OR v = 0 AS few, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-9) - 1, 1), 1e6) AS weight FROM mo),
ab AS (SELECT CASE WHEN few THEN (x + 0.5) / (n + 1) ELSE m * weight END AS a, CASE WHEN few THEN 1 - (x + 0.5) / (n + 1) ELSE (1 - m) * weight END AS b FROM we),
hr AS (SELECT *, fails / docs AS rate, (fails + a) / (docs + a + b) AS shrunk FROM ho, ab),
hv AS (SELECT *, shrunk > 0.1 AS suspect, CASE WHEN fails = 0 THEN 'clean' WHEN shrunk > 0.1 THEN 'suspect' ELSE 'mixed' END AS host_verdict,
  CASE WHEN phrase_fails > 0 THEN 0.25::DOUBLE END AS phrase_limit, CASE WHEN sentence_fails > 0 THEN 0.3::DOUBLE END AS sentence_limit, CASE WHEN line_fails > 0 THEN 0.3::DOUBLE END AS line_limit FROM hr)
"""
ORACLE = {
    "p4_certified": P4 + "SELECT enumstring, metric, CAST(p AS DOUBLE) AS p, count(*) AS n, true AS within FROM v, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) q(p) WHERE v IS NOT NULL GROUP BY ALL",
    "p4_days": P4 + "SELECT enumstring, metric, epoch_us(datetime) // 86400000000 AS day, count(*) AS n, count(*) AS weight, min(v) AS low, max(v) AS high FROM v WHERE v IS NOT NULL GROUP BY ALL",
    "p7_documents": "SELECT pack_kind, doc_id, coalesce(text, '') <> '' AS placed, 1 AS n FROM documents, pack_sizes",
    "p7_broken": "SELECT pack_kind, '' AS what, CAST(0 AS BIGINT) AS id FROM pack_sizes WHERE false",
    "p8_reached": "SELECT source, target_share, true AS reached, true AS allowed FROM source_targets",
    "p8_broken": "SELECT source, doc_id, CAST(0 AS BIGINT) AS n FROM documents WHERE false",
    "p9_found": P9 + "SELECT doc_id FROM c GROUP BY doc_id, total HAVING count(*) >= 0.25 * total",
    "p9_hosts": P9 + P9_HOSTS + "SELECT source, docs, phrase_fails, sentence_fails, line_fails, fails, round(rate, 9) AS rate, round(shrunk, 9) AS shrunk, suspect, host_verdict, phrase_limit, sentence_limit, line_limit FROM hv",
    "p9_documents": P9 + P9_HOSTS + """SELECT m.doc_id, m.source, words, repeated_words, round(phrase, 9) AS phrase, round(sentence, 9) AS sentence, round(line, 9) AS line, round(shrunk, 9) AS host_shrunk, suspect AS host_suspect, host_verdict,
  CASE WHEN phrase >= 0.25 THEN 'repetitive' WHEN sentence >= 0.3 OR line >= 0.3 OR suspect THEN 'doubtful' ELSE 'clean' END AS verdict FROM ms m JOIN hv h ON m.source IS NOT DISTINCT FROM h.source""",
}
