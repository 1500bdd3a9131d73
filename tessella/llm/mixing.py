"""A mixture of sources by target shares, ordered by a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.packing import numbered


def targets_of(table: DataFrame, most: int = 100_000) -> list[tuple[str, float, int]]:
    """``(source, target_share, max_repeats)``. The plan is made on the driver from one row per source; more than
    ``most`` are an error."""
    rows = table.select("source", "target_share", "max_repeats").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} target sources")
    out = [(r.source, float(r.target_share), int(r.max_repeats)) for r in rows if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0]
    if len({s for s, _, _ in out}) < len(out):
        raise ValueError("a source has two targets")
    return out


def plan(targets: list[tuple[str, float, int]], supply: dict[str, int], budget: int | None = None, drift: float = 0.5) -> list[tuple]:
    """For each source with tokens: ``(source, share, supply, demand, epochs, slope)``.

    Shares are relative to the sources that have tokens. The budget is the most that lets each have
    its share without exceeding its repeats, or ``budget``, if that is less. A source's weight at
    time t in [0, 1] is ``share * (1 + slope * (2t - 1))``: sources that may be repeated (the scarce
    ones) grow over time, others shrink, by at most ``drift``; the weights sum to 1 at all times."""
    there = [(s, w, r) for s, w, r in targets if supply.get(s, 0) > 0]
    if not there:
        return []
    norm = sum(w for _, w, _ in there)
    there = [(s, w / norm, r) for s, w, r in there]
    total = min(supply[s] * r / w for s, w, r in there)
    if budget is not None:
        total = min(total, budget)
    most = max(r for _, _, r in there)
    wish = {s: (r - 1) / (most - 1) if most > 1 else 0.0 for s, _, r in there}
    mean = sum(w * wish[s] for s, w, _ in there)
    # slopes weighted by share sum to 0; a difference of wishes is within [-1, 1]
    return [(s, w, supply[s], total * w, max(1, math.ceil(total * w / supply[s] - 1e-12)), drift * (wish[s] - mean)) for s, w, _ in there]


def position(used: Column, slope: Column) -> Column:
    """Time at which a source's cumulative weight reaches the share ``used`` of its own total: the
    inverse of ``t + slope * (t * t - t)`` on [0, 1]."""
    b = 1 - slope
    root = (F.sqrt(b * b + 4 * slope * used) - b) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, used).otherwise(root)


def supply_of(sized: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    return sized.groupBy(source).agg(F.sum(size).alias("supply"), F.count("*").alias("docs"))


def mixture(sized: DataFrame, targets: list[tuple[str, float, int]], budget: int | None = None, drift: float = 0.5, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 1, per_bucket: int = 2_000) -> DataFrame:
    """``(position, source, key, epoch, n_tokens)``, sorted by position in [0, 1).

    ``sized`` should be a stored table: it is read three times. Each source's rows are shuffled by a
    hash in every epoch and laid end to end; a row's place is the middle of its tokens, turned into a
    position through the inverse of the source's demand. Rows beyond the demand are not used. The
    running sums are taken within hash buckets of about ``per_bucket`` rows, and the buckets' sums
    are added up separately, so that a source of any share is spread. Rows without a target source
    or without tokens are not used. The order depends on keys, sources and sizes alone, not on how the
    rows are split. No target, or none with tokens: no rows."""
    names = [s for s, _, _ in targets]
    rows = sized.filter(F.col(size) > 0).select(F.col(source).alias("source"), F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")).filter(F.col("source").isin(names))
    stats = {r.source: (r.supply, r.docs) for r in supply_of(rows, size="n").collect()}
    made = plan(targets, {s: x for s, (x, _) in stats.items()}, budget, drift)
    spark = sized.sparkSession
    bits = max(4, math.ceil(math.log2(max(1, sum(d for _, d in stats.values()) / per_bucket))))
    table = spark.createDataFrame(made, "source string, share double, supply bigint, demand double, epochs int, slope double")
    copies = numbered(rows, ["source", "k", "n"]).join(table, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    copies = copies.withColumn("h", F.xxhash64("k", "n", "copy", "epoch", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    by = ["source", "epoch", "bucket"]
    sums = copies.groupBy(*by).agg(F.sum("n").alias("total"))
    before = sums.withColumn("before", F.sum("total").over(W.partitionBy("source", "epoch").orderBy("bucket")) - F.col("total")).drop("total")
    within = F.sum("n").over(W.partitionBy(*by).orderBy("h", "k", "n", "copy").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = copies.withColumn("within", within).join(before, by)
    middle = F.col("epoch") * F.col("supply") + F.col("before") + F.col("within") + F.col("n") / 2
    used = placed.withColumn("u", middle / F.col("demand")).filter("u < 1")
    kind = sized.schema[key].dataType.simpleString()
    out = used.select(position(F.col("u"), F.col("slope")).alias("position"), "source", F.col("k").cast(kind).alias(key), "epoch", F.col("n").alias("n_tokens"))
    return out.orderBy("position", "source", key, "epoch")


def shares(mixed: DataFrame, sized: DataFrame, targets: list[tuple[str, float, int]], key: str = "doc_id", source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per target source: its target and actual share of the tokens, the tokens it has and gives, and
    how often one document is used at most."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int") if targets else spark.createDataFrame([], "source string, target_share double, max_repeats int")
    given = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("epoch") + 1).alias("used_at_most"))
    total = W.partitionBy(F.lit(1))  # one row per target source
    out = goal.join(supply_of(sized.select(F.col(source).alias("source"), F.col(size).alias("n")), size="n").drop("docs"), "source", "left").join(given, "source", "left")
    out = out.fillna(0, ["supply", "tokens", "rows", "used_at_most"])
    return out.select("source", "target_share", (F.col("tokens") / F.sum("tokens").over(total)).alias("share"), "supply", "tokens", "rows", "max_repeats", "used_at_most")
