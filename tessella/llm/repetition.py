"""Repetition inside single documents, and what it says about the hosts they come from."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import starts
from tessella.session import durable, spread

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]+\s+")
RULES = ("phrase", "sentence", "line")
LIMITS = {"phrase": 0.25, "sentence": 0.3, "line": 0.3}
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: ASCII characters that stand in words as they are, others as blanks; bytes beyond ASCII stay.
BLANKS = bytes(i if i > 127 or chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))


def words_of(texts: list[str]) -> list[list[bytes]]:
    """The words of lower-case texts, encoded. Other characters become blanks: those beyond ASCII one by one,
    as few occur, the rest by a table."""
    seen = np.bincount(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), minlength=1)
    other = [c for c in map(chr, np.flatnonzero(seen).tolist()) if not c.isascii() and not c.isalnum()]
    out = []
    for t in texts:
        for c in other:
            t = t.replace(c, " ")
        out.append(t.encode().translate(BLANKS).split())
    return out


def said_before(doc: np.ndarray, words: list, n: int) -> np.ndarray:
    """Places where a sequence of ``n`` words begins that began earlier in the same document.

    Sequences are sorted by a hash; those that share theirs with another one are compared word by
    word, so that the result is exact."""
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (doc[:m].astype(np.uint64) + np.uint64(1)) * FACTOR
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * FACTOR + w[j:j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    if not len(at):
        return at
    by = at[np.argsort(h[at])]
    first = np.flatnonzero(starts(h[by]))
    size = np.diff(np.append(first, len(by)))
    groups = np.repeat(np.minimum.reduceat(by, first), size)
    later = np.flatnonzero(by != groups)
    out, clash = [], set()
    for p, q in zip(by[later].tolist(), groups[later].tolist()):
        if doc[p] == doc[q] and words[p:p + n] == words[q:q + n]:
            out.append(p)
        else:
            clash.add(q)
    if clash:  # different sequences of equal hash
        seen = set()
        mine = np.isin(groups, list(clash))
        out = [p for p, q in zip(by[later].tolist(), groups[later].tolist()) if q not in clash]
        for p in np.sort(by[mine]).tolist():
            k = (doc[p], *words[p:p + n])
            if k in seen:
                out.append(p)
            seen.add(k)
    return np.array(out, np.int64)


def covered_words(doc: np.ndarray, words: list, n: int) -> np.ndarray:
    """Which words stand in a sequence of ``n`` words that began earlier in the same document."""
    change = np.zeros(len(words) + 1, np.int64)
    start = said_before(doc, words, n)
    np.add.at(change, start, 1)
    np.add.at(change, start + n, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_units(units: list[list[str]]) -> float:
    """Share of the characters that stand in units (sentences, lines) said before."""
    seen: set[str] = set()
    total = again = 0
    for u in units:
        if u:
            x = " ".join(u)
            total += len(x)
            if x in seen:
                again += len(x)
            seen.add(x)
    return again / total if total else 0.0


def measure(texts: list[str | None], n: int, rules: Sequence[str] = RULES) -> dict[str, np.ndarray]:
    """Words, repeated words, and the shares asked for, of each text; each text is cut into words once."""
    words, count, unit = [], [], {r: [] for r in rules if r != "phrase"}
    lower = [t.lower() if t else "" for t in texts]
    for t in lower if unit else words_of(lower):
        before = len(words)
        if unit:
            lines = [[WORD.findall(x) for x in SENTENCE_END.split(row)] for row in t.split("\n")]
            for row in lines:
                for x in row:
                    words += x
            if "sentence" in unit:
                unit["sentence"].append(repeated_units([x for row in lines for x in row]))
            if "line" in unit:
                unit["line"].append(repeated_units([[w for x in row for w in x] for row in lines]))
        else:
            words += t
        count.append(len(words) - before)
    count = np.array(count, np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    again = np.bincount(doc[covered_words(doc, words, n)], minlength=len(texts)).astype(np.int64)
    out = {"words": count, "repeated_words": again, "phrase": again / np.maximum(count, 1)}
    return {k: v for k, v in out.items() if k != "phrase" or "phrase" in rules} | {k: np.array(v, float) for k, v in unit.items()}


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 8, keep: tuple[str, ...] = (), chars: int = 1_000_000, rules: Sequence[str] = RULES) -> DataFrame:
    """``(key, *keep, words, repeated_words, *rules)`` for every row of ``df``.

    ``phrase`` is the share of the words that stand in a sequence of ``n`` words that began earlier
    in the same text; ``sentence`` and ``line`` the shares of characters in sentences and lines said
    before. Words are runs of letters, digits or underscores in lower case. Whole texts are read,
    in pieces of about ``chars`` characters of whole documents. Null and empty texts have 0 words
    and shares of 0; rows of equal key are measured one by one. Map-only; rows
    are dealt out first where there are fewer partitions than cores."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}
    names = [f"c{i}" for i in range(len(kinds))]
    rules = [r for r in RULES if r in rules]
    shape = {"words": "bigint", "repeated_words": "bigint"} | dict.fromkeys(rules, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < b.num_rows:
                base = sizes[a - 1] if a else 0
                e = max(a + 1, int(np.searchsorted(sizes, base + chars)))
                part = b.slice(a, e - a)
                got = measure(part.column("text").to_pylist(), n, rules)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(got[c]) for c in shape]], names=[*names, *shape])
                a = e

    picked = spread(df.select(*[F.col(c).alias(x) for c, x in zip(kinds, names)], F.col(text).cast("string").alias("text")))
    out = picked.mapInArrow(run, ", ".join(f"{x} {k}" for x, k in zip([*names, *shape], [*kinds.values(), *shape.values()])))
    return out.withColumnsRenamed(dict(zip(names, kinds)))


def host_rates(measured: DataFrame, host: str, limits: dict[str, float], worst: float = 0.1) -> DataFrame:
    """Per host: documents, failures of each rule, failures of any, its raw and shrunk rate, whether it is
    ``suspect``, and its verdict: ``clean`` without any failure, ``suspect``, or ``mixed``. ``<rule>_limit`` is the limit
    that the host's documents have to meet: null at a host without failures of that rule.

    Rates are shrunk towards the mean of all hosts with a beta prior fitted by moments: the spread of
    the hosts' rates beyond what their sizes explain gives the prior's weight. A host is suspect if
    its shrunk rate exceeds ``worst``. Counts are taken map-side first; only three sums of the hosts'
    table reach the driver."""
    fails = {r: (F.col(r) >= F.lit(x)) for r, x in limits.items()}
    any_fail = F.greatest(*[f.cast("int") for f in fails.values()]) if len(fails) > 1 else next(iter(fails.values())).cast("int")
    g = measured.groupBy(host).agg(F.count("*").alias("docs"), *[F.sum(f.cast("int")).alias(f"{r}_fails") for r, f in fails.items()], F.sum(any_fail).alias("fails"))
    s = g.agg(F.sum("docs").alias("n"), F.sum("fails").alias("x"), F.count("*").alias("h"), F.avg(F.col("fails") / F.col("docs")).alias("m"), F.var_samp(F.col("fails") / F.col("docs")).alias("v"), F.avg(1 / F.col("docs")).alias("inv")).first()
    a, b = beta_prior(s.n or 0, s.x or 0, s.h or 0, s.m, s.v, s.inv)
    shrunk = (F.col("fails") + a) / (F.col("docs") + a + b)
    return g.withColumn("rate", F.col("fails") / F.col("docs")).withColumn("shrunk", shrunk).withColumn("suspect", F.col("shrunk") > worst).withColumns(
        {"host_verdict": F.when(F.col("fails") == 0, "clean").when(F.col("suspect"), "suspect").otherwise("mixed")} | {f"{r}_limit": F.when(F.col(f"{r}_fails") > 0, F.lit(float(x))) for r, x in limits.items()})


def beta_prior(n: int, x: int, hosts: int, mean: float | None, var: float | None, inverse: float | None) -> tuple[float, float]:
    """Parameters of the beta prior by moments; one document's worth where the hosts don't differ or are too few."""
    p = (x + 0.5) / (n + 1)
    if hosts < 2 or not mean or mean >= 1 or not var:
        return p, 1 - p
    extra = max(var - mean * (1 - mean) * (inverse or 0), 1e-9)
    weight = min(max(mean * (1 - mean) / extra - 1, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def verdicts(df: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", n: int = 8, limits: dict[str, float] | None = None, worst: float = 0.1) -> DataFrame:
    """Each document's measures and verdict, with its host's: ``(key, host, words, repeated_words,
    *limits, host_shrunk, host_suspect, host_verdict, verdict)``.

    Failures are added up by host first, and each document is judged by its host's row: it is
    ``repetitive`` if it reaches the host's limit for ``phrase``, ``doubtful`` if it reaches another of the
    host's limits or comes from a suspect host, else ``clean``. Only the rules in ``limits`` are measured.
    Documents without host form one host of their own. The measures are stored once, when this is
    called; hosts are joined back by a table with one row each, which Spark broadcasts if small and
    otherwise joins with skewed partitions split."""
    limits = limits or LIMITS
    measured = durable(repetition(df, key, text, n, (host,), rules=tuple(limits)))
    rates = host_rates(measured, host, limits, worst).select(F.col(host).alias("_h"), F.col("shrunk").alias("host_shrunk"), F.col("suspect").alias("host_suspect"), "host_verdict", *[F.col(f"{r}_limit").alias(f"_{r}") for r in limits])
    out = measured.join(rates, F.col(host).eqNullSafe(F.col("_h")), "left").drop("_h")
    fails = {r: F.coalesce(F.col(r) >= F.col(f"_{r}"), F.lit(False)) for r in limits}
    other = reduce(or_, [f for r, f in fails.items() if r != "phrase"], F.col("host_suspect"))
    verdict = F.when(fails.get("phrase", F.lit(False)), "repetitive").when(other, "doubtful").otherwise("clean")
    return out.withColumn("verdict", verdict).drop(*[f"_{r}" for r in limits])
