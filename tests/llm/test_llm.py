"""Training-data operators: brute force, invariants and held counts on small tables."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import digest, mixing, packing, repetition, tokens
from tests.conftest import rows

# tokens


def test_counts_are_those_of_the_tokenizer(spark):
    texts = ["", None, "a", "Das Gericht hat entschieden.", "x" * 100_000, "<|endoftext|> ok", "é\n\n  tab\t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = dict(df.select("id", tokens.count_tokens(F.col("text"))).collect())
    enc = tokens.encoding(tokens.vocabulary_path())
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


# digests


def clusters(values, delta):
    v = np.sort(np.asarray(values, float))
    g = np.zeros(len(v), np.int64)
    return digest.clustered(g, v, np.ones(len(v), np.int64), delta)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.sampled_from([20, 100, 1000]))
def test_centroids_are_light_and_sorted(values, delta):
    _, m, w = clusters(values, delta)
    assert w.sum() == len(values) and (np.diff(m) >= 0).all() and len(m) <= delta / 2 + 2
    assert m.min() >= min(values) and m.max() <= max(values)
    assert w.max() <= max(1, math.pi / delta * len(values) + 2)


def test_merging_keeps_the_rank_error(spark):
    rng = np.random.default_rng(1)
    data, at = [], datetime(2021, 1, 1)
    values = {"a": rng.lognormal(0, 2, 6000), "b": rng.integers(0, 4, 3000).astype(float), "c": np.array([7.0]), "d": np.full(500, 3.5)}
    for k, vs in values.items():
        for i, v in enumerate(vs):
            data.append((len(data), float(v), int(v), k, at + timedelta(seconds=60 * i)))
    data += [(len(data) + 1, None, None, "a", at), (len(data) + 2, float("nan"), None, "e", at), (len(data) + 3, float("inf"), 2, "e", at + timedelta(days=1)), (len(data) + 4, 1.0, 2, None, at)]
    df = spark.createDataFrame(data, "rowid long, close double, volume long, enumstring string, datetime timestamp_ntz").withColumns({"k": F.lit(1), "metric": F.lit(2), "n": F.lit(3)})
    got = digest.percentiles(df, (0.0, 0.1, 0.5, 0.99, 1.0), delta=500, stated=2 * math.pi / 500).collect()
    assert {(r.enumstring, r.metric) for r in got} == {(k, m) for k in "abcd" for m in ("close", "volume")} | {("e", "volume")}
    for r in got:
        if r.metric == "close":
            v = values[r.enumstring]
            assert r.n == len(v) and r.below == (v < r.value).sum() and r.up_to == (v <= r.value).sum()
            assert r.within, r
            if r.p in (0.0, 1.0):
                assert r.value == (v.min() if r.p == 0 else v.max())
    parts = digest.digests(df, delta=500)
    whole = {(r.k, r.metric): r for r in digest.merged(parts, 500).collect()}
    assert whole["a", "close"].n == 6000 and sum(whole["a", "close"].weights) == 6000
    assert parts.filter("k = 'a' and metric = 'close'").count() >= 5
    # days merged in two steps give digests within the same error
    half = [digest.merged(parts.filter(c), 500).withColumn("part", F.lit(0)) for c in ("part % 2 = 0", "part % 2 = 1")]
    twice = {(r.k, r.metric): r for r in digest.merged(half[0].unionByName(half[1]), 500).collect()}
    v = np.sort(values["a"])
    m, w = np.array(twice["a", "close"].means), np.array(twice["a", "close"].weights)
    median = np.interp(3000, np.cumsum(w) - w / 2, m)
    assert abs(np.searchsorted(v, median) - 3000) <= 2 * math.pi / 500 * 6000
    # many digests of a source are merged in rounds, and ranges cut sources where they like
    rounds = {(r.k, r.metric): r for r in digest.merged(parts, 500, fan=2).collect()}
    assert {k: (r.n, sum(r.weights), r.lo, r.hi) for k, r in rounds.items()} == {k: (r.n, sum(r.weights), r.lo, r.hi) for k, r in whole.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    cut = {(r.enumstring, r.metric, r.p): r for r in digest.percentiles(df, (0.0, 0.1, 0.5, 0.99, 1.0), delta=500, stated=2 * math.pi / 500).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(cut) == len(got) and all(r.within for r in cut.values())
    for r in cut.values():
        if r.metric == "close":
            v = values[r.enumstring]
            assert (r.n, r.below, r.up_to) == (len(v), (v < r.value).sum(), (v <= r.value).sum())
    assert digest.percentiles(df.limit(0)).count() == 0


def test_percentiles_of_whole_table(spark, sf):
    r = digest.percentiles(spark.read.parquet(f"{sf}/simple10q.parquet"))
    assert r.filter("not within").count() == 0 and r.count() > 50


# packing

PACKS = [("s", 64), ("l", 300)]


def check_packing(got, sizes, packs):
    """Every token is placed once, containers are within capacity, only long items are cut."""
    for kind, cap in packs:
        mine = [r for r in got if r.pack_kind == kind]
        load, pieces = Counter(), {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
            if r.container is not None:
                load[r.container] += r.n_tokens
            assert (r.container is None) == (r.n_tokens == 0)
        assert not load or max(load.values()) <= cap
        assert Counter(i for i, _ in sizes) == Counter({i: sum(1 for a, _ in p if a == 0) for i, p in pieces.items()})
        for i, n in sizes:
            if sum(1 for j, _ in sizes if j == i) == 1:
                p = sorted(pieces[i])
                assert sum(b for _, b in p) == (n or 0) and len(p) == max(1, math.ceil((n or 0) / cap))
                assert [a for a, _ in p] == [k * cap for k in range(len(p))]
        yield kind, sum(load.values()) / max(1, len(load) * cap)


@pytest.mark.parametrize("per_shard", [40, 20_000])
def test_packing(spark, per_shard):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, None, 1, 5, 64, 65, 300, 301, 3000]) if i % 5 == 0 else rng.randint(1, 120)) for i in range(400)] + [(7, 33)] * 30
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumns({"k": F.lit(1), "shard": F.lit(2)})
    got = packing.pack(df, PACKS, per_shard=per_shard).collect()
    for kind, filled in check_packing(got, sizes, PACKS):
        assert filled > (0.75 if per_shard == 40 else 0.9), (kind, filled)
    assert packing.pack(df.limit(0), PACKS).count() == 0
    assert packing.fill(packing.pack(df.limit(0), PACKS), PACKS).count() == 2
    with pytest.raises(ValueError):
        packing.pack(df, [("x", 0)])


def test_assignment_takes_the_cheapest_with_room():
    sizes = np.array([9, 8, 7, 3, 3, 2, 1])
    where = packing.assign(sizes, 10)
    # 33 tokens need 4 containers; each item goes to the least cost with room
    assert where.tolist() == [0, 1, 2, 3, 3, 3, 3]


# mixing


def test_curriculum_weights():
    made = mixing.plan([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("none", 0.4, 3)], {"a": 1000, "b": 400, "c": 100})
    assert sum(w for _, w, *_ in made) == pytest.approx(1) and [s for s, *_ in made] == ["a", "b", "c"]
    for t in np.linspace(0, 1, 11):
        w = [w * (1 + slope * (2 * t - 1)) for _, w, _, _, _, slope in made]
        assert sum(w) == pytest.approx(1) and min(w) > 0
    for s, w, supply, demand, epochs, _ in made:
        assert demand <= supply * {"a": 1, "b": 2, "c": 5}[s] + 1e-6 and epochs <= {"a": 1, "b": 2, "c": 5}[s]
    assert mixing.plan([("x", 1.0, 1)], {}) == []


def test_position_inverts_the_demand(spark):
    u = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(x, g) for x in u for g in (-0.5, -1e-12, 0.0, 0.3, 0.5)], "u double, g double")
    for r in df.withColumn("t", mixing.position(F.col("u"), F.col("g"))).collect():
        assert r.t + r.g * (r.t * r.t - r.t) == pytest.approx(r.u, abs=1e-6) and -1e-9 <= r.t <= 1 + 1e-9


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choices(["big", "mid", "small", None, "other"], [60, 25, 8, 4, 3])[0], rng.choice([0, None]) if i % 40 == 0 else rng.randint(1, 200)) for i in range(3000)] + [(5, "big", 100)] * 50
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumns({"k": F.lit(1), "bucket": F.lit(1)})
    goal = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 2)]
    got = mixing.mixture(sized, goal, per_bucket=50).collect()
    total = sum(r.n_tokens for r in got)
    assert [r.position for r in got] == sorted(r.position for r in got) and 0 <= got[0].position and got[-1].position < 1
    by, uses = Counter(), Counter()
    for r in got:
        by[r.source] += r.n_tokens
        uses[r.source, r.doc_id] += 1
    for s, w, most in goal[:3]:
        assert by[s] / total == pytest.approx(w / 1.0, abs=0.01)
        assert max(n for (src, i), n in uses.items() if src == s and i != 5) <= most
    assert set(by) == {"big", "mid", "small"}
    supply = Counter()
    for _, s, n in docs:
        supply[s] += n or 0
    # the budget is as large as shares and repeats allow
    assert total == pytest.approx(min(supply[s] * m / w for s, w, m in goal[:3]), rel=0.02)
    # weights over time: the scarce source has more of the second half
    half = Counter(r.source for r in got if r.position >= 0.5)
    assert half["small"] > sum(1 for r in got if r.source == "small") / 2
    told = {r.source: r for r in mixing.shares(spark.createDataFrame(got), sized, goal).collect()}
    assert told["absent"].tokens == 0 and told["small"].tokens == by["small"] and told["small"].used_at_most <= 4
    assert sum(r.share for r in told.values()) == pytest.approx(1)
    assert rows(mixing.mixture(sized, goal, per_bucket=50)) == rows(spark.createDataFrame(got))  # the same again
    assert mixing.mixture(sized, []).count() == 0
    assert mixing.mixture(sized.limit(0), goal).count() == 0
    small = mixing.mixture(sized, goal, budget=2000).agg(F.sum("n_tokens")).first()[0]
    assert 1500 < small <= 2400


# repetition


def plain_share(text, n=8):
    """Words in sequences said before, over all words; written from the definition."""
    import re

    w = re.findall(r"\w+", (text or "").lower())
    seen, cover = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i:i + n])
        if g in seen:
            cover.update(range(i, i + n))
        seen.add(g)
    return len(cover), len(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=5), st.integers(1, 9))
def test_covered_words(docs, n):
    got = repetition.measure([" ".join(d) for d in docs], n)
    assert list(zip(got["repeated_words"].tolist(), got["words"].tolist())) == [plain_share(" ".join(d), n) for d in docs]


def test_equal_hashes_are_compared(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abc"), 60)) for _ in range(5)]
    want = repetition.measure(texts, 3)["repeated_words"].tolist()
    monkeypatch.setattr(repetition, "FACTOR", np.uint64(0))  # hashes that often agree
    monkeypatch.setattr(repetition, "hash", lambda w: 1, raising=False)
    assert repetition.measure(texts, 3)["repeated_words"].tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_words_are_runs_of_letters_digits_and_underscores(texts):
    texts = [t.encode("utf-8", "ignore").decode().lower() for t in texts]
    assert [[w.decode() for w in ws] for ws in repetition.words_of(texts)] == [repetition.WORD.findall(t) for t in texts]


def test_units_of_a_text():
    text = "One two. Three?\nOne two! Four five six. One two.\nThree"
    got = repetition.measure([text], 8)
    units = ["one two", "three", "one two", "four five six", "one two", "three"]
    lines = ["one two three", "one two four five six one two", "three"]
    total = sum(map(len, units))
    assert got["sentence"][0] == (len("one two") * 2 + len("three")) / total and got["line"][0] == 0.0 and len(lines) == 3
    assert set(repetition.measure([text], 8, ("phrase",))) == {"words", "repeated_words", "phrase"}


def test_documents_are_judged_by_their_hosts(spark, monkeypatch):
    said = "the court finds that the claim must be dismissed. " * 3
    df = spark.createDataFrame([(1, said, "a"), (2, "nothing to see here", "a"), (3, said, "b"), (4, "quiet", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.verdict, r.host_verdict) for r in repetition.verdicts(df, limits={"phrase": 0.25}).collect()}
    assert got[1][0] == got[3][0] == "repetitive" and got[2][0] != "repetitive" and got[4] [1] == "clean"
    rates = repetition.host_rates
    # a host's limit decides on its documents: take it away from host b
    monkeypatch.setattr(repetition, "host_rates", lambda *a: rates(*a).withColumn("phrase_limit", F.when(F.col("source") != "b", F.col("phrase_limit"))))
    got = {r.doc_id: r.verdict for r in repetition.verdicts(df, limits={"phrase": 0.25}).collect()}
    assert got[1] == "repetitive" and got[3] != "repetitive"


def test_repetition_of_texts(spark):
    said = "the court finds that the claim must be dismissed. "
    texts = [None, "", "   ", said, said * 2, said.upper() + "\n" + said, "Ünïcode wörter " * 8, "x" * 3_000_000, "a b " * 300_000, "one, two! three? four; five: six\nseven_8 9 ten " + "filler words here " * 1]
    df = spark.createDataFrame([(i, t, "h" if i % 2 else None) for i, t in enumerate(texts)] + [(4, said * 2, "h")], "doc_id long, text string, source string").withColumns({"words": F.lit(1), "c0": F.lit(2), "phrase": F.lit("z")})
    got = repetition.repetition(df, chars=1000)
    for r in got.collect():
        again, n = plain_share(texts[r.doc_id])
        assert (r.repeated_words, r.words) == (again, n)
        assert r.phrase == pytest.approx(again / n if n else 0)
    v = {r.doc_id: r for r in repetition.verdicts(df).collect()}
    assert v[4].verdict == v[5].verdict == "repetitive" and v[4].sentence == pytest.approx(0.5, abs=0.02) and v[0].phrase == 0
    assert repetition.verdicts(df).count() == len(texts) + 1
    assert repetition.verdicts(df.limit(0)).count() == 0


def test_host_rates(spark):
    data = [(h, 0.5 if i < bad else 0.0) for h, n, bad in (("a", 1000, 10), ("b", 500, 200), ("c", 1, 1), (None, 40, 0)) for i in range(n)]
    df = spark.createDataFrame(data, "host string, phrase double")
    r = {x.host: x for x in repetition.host_rates(df, "host", {"phrase": 0.25}).collect()}
    assert (r["b"].docs, r["b"].fails, r["b"].phrase_fails) == (500, 200, 200) and r["b"].suspect and not r["a"].suspect
    assert abs(r["a"].shrunk - 0.01) < 0.01 and r["c"].shrunk < 1 and r[None].fails == 0
    assert repetition.beta_prior(0, 0, 0, None, None, None) == (0.5, 0.5)
    a, b = repetition.beta_prior(1000, 100, 5, 0.1, 0.001, 0.005)
    assert a / (a + b) == pytest.approx(0.1)


def test_found_documents_of_whole_table(spark, sf):
    t = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in t.collect() if r.text and (x := plain_share(r.text))[1] and x[0] / x[1] >= 0.25}
    assert {r.doc_id for r in repetition.verdicts(t).filter("verdict = 'repetitive'").collect()} == want and want
