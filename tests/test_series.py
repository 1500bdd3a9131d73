"""Rolling totals, regular grids and implausible readings against brute force on small tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tessella.operators import grid, ordered, rolling, spikes
from tessella.operators.readings import HOUR_US, distinct_readings
from tests.conftest import rows

SCHEMA = "rowid long, open double, close double, high double, low double, volume long, enumstring string, datetime timestamp_ntz, extra string, k string, t_us int, total int, day int"
EPOCH = datetime(1970, 1, 1)


def make(spark, n=1500, seed=0, sources=5, hot=0.5):
    """Readings of a few sources, one with half of all rows, with nulls, NaN, ties and rows sent again."""
    rng, out = random.Random(seed), []
    for i in range(n):
        src = "s0" if rng.random() < hot else rng.choice([None, *(f"s{j}" for j in range(1, sources))])
        t = datetime(2021, 2, 1) + timedelta(seconds=rng.randint(0, 50 * 86_400))
        p = [None if rng.random() < 0.08 else float("nan") if rng.random() < 0.02 else round(100.0 + rng.choice([0, 0, 0, 0.01, 0.02, 5, -5, -200]), 2) for _ in range(4)]
        v = None if rng.random() < 0.1 else rng.randint(0, 1000)
        stamp = rng.choice([None, EPOCH]) if rng.random() < 0.03 else t
        out.append((i, *p, v, src, stamp, "x", "y", 1, 2, 3))
    out += [(n + i, *r[1:]) for i, r in enumerate(rng.sample(out, n // 10))]
    rng.shuffle(out)
    return spark.createDataFrame(out, SCHEMA).repartition(3), out


def readings(data):
    """First rows per source and stamp, in order: {source: [(us, open, close, high, low, volume)]}."""
    first = {}
    for r in sorted(data):
        if r[6] is not None and r[7] is not None and r[7] != EPOCH:
            us = int((r[7] - EPOCH).total_seconds() * 1_000_000)
            first.setdefault((r[6], us), tuple(None if x is None or x != x else x for x in r[1:6]))
    out = {}
    for (src, us), v in sorted(first.items()):
        out.setdefault(src, []).append((us, *v))
    return out


@pytest.mark.parametrize("periods", [(7, 30), (1,), (13, 2)])
def test_trailing_totals(spark, periods):
    df, data = make(spark)
    got = {(r.enumstring, r.day.toordinal()): r for r in rolling.trailing_totals(df, periods=periods).collect()}
    n = 0
    for src, rs in readings(data).items():
        by = {}
        for us, *_, v in rs:
            by.setdefault(us // 86_400_000_000, []).append(v)
        first, last = min(by), max(by)
        for day in range(first, last + 1):
            r = got[src, day + 719_163]
            assert r.day_no == day - first + 1
            for p in periods:
                some = [v for d in range(day - p + 1, day + 1) for v in by.get(d, []) if v is not None]
                assert r[f"total_{p}"] == sum(some)
                assert r[f"avg_{p}"] == (pytest.approx(sum(some) / len(some)) if some else None)
            n += 1
    assert n == len(got)


def test_totals_beyond_bigint(spark):
    d = datetime(2021, 1, 1)
    df = spark.createDataFrame([(1, 2**62, "a", d), (2, 2**62, "a", d + timedelta(days=1)), (3, 5, "a", d + timedelta(days=3))], "rowid long, volume long, enumstring string, datetime timestamp_ntz")
    got = rows(rolling.trailing_totals(df, periods=(2,)), "day_no", "total_2")
    assert got == [(1, 2**62), (2, None), (3, 2**62), (4, 5)]
    assert rolling.trailing_totals(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rolling.trailing_totals(df, periods=())


@pytest.mark.parametrize("hold,ranges", [(HOUR_US, "4"), (HOUR_US // 3, "40"), (5 * HOUR_US + 7, "90"), (HOUR_US, "150")])
def test_regular_series(spark, hold, ranges):
    df, data = make(spark, 400)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    made = grid.regular_series(df, hold_us=hold)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.enumstring, r.cell): r for r in made.collect()}
    assert len(got) == made.count()
    n = 0
    for src, rs in readings(data).items():
        values = [(r[0], r[2]) for r in rs if r[2] is not None]
        held = []
        for i, (t, v) in enumerate(values):
            end = min(values[i + 1][0], t + hold) if i + 1 < len(values) else min(t + hold, (t // HOUR_US + 1) * HOUR_US)
            held.append((t, end, v))
        for cell in range(rs[0][0] // HOUR_US, rs[-1][0] // HOUR_US + 1):
            a, b = cell * HOUR_US, (cell + 1) * HOUR_US
            inside = [r for r in rs if a <= r[0] < b]
            parts = [(min(e, b) - max(t, a), v) for t, e, v in held if min(e, b) > max(t, a)]
            covered = sum(x for x, _ in parts)
            r, known = got[src, cell], [v for t, v in values if t < b]
            vols = [x[5] for x in inside if x[5] is not None]
            assert r.n == len(inside)
            assert r.total == (0 if not inside else sum(vols) if vols else None)
            assert r.level == (known[-1] if known else None)
            assert r.coverage == pytest.approx(covered / HOUR_US)
            assert r.twa == (pytest.approx(sum(x * v for x, v in parts) / covered) if covered else None)
            assert r.state == ("reading" if inside else "filled" if known else "unknown")
            n += 1
    assert n == len(got)


def test_empty_runs(spark):
    df, data = make(spark, 300)
    want = []
    for src, rs in readings(data).items():
        cells = sorted({r[0] // HOUR_US for r in rs})
        want += [(src, a + 1, b - 1) for a, b in zip(cells, cells[1:]) if b > a + 1]
    assert rows(grid.empty_runs(df)) == sorted(want, key=lambda r: tuple((True, str(x)) for x in r))
    assert grid.empty_runs(df.limit(0)).count() == 0 and grid.regular_series(df.limit(0)).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    assert rows(grid.empty_runs(df)) == sorted(want, key=lambda r: tuple((True, str(x)) for x in r))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def flags(data, factor=10, least=8):
    """The definitions, applied one by one."""
    out = {}
    for src, rs in readings(data).items():
        bad = []
        for _, o, c, h, lo, _ in rs:
            some = [x for x in (o, c, h, lo) if x is not None]
            bad.append(any(x <= 0 for x in some) or (h is not None and lo is not None and h < lo) or any(x is not None and (lo is not None and x < lo or h is not None and x > h) for x in (o, c)))
        frozen, spike = [0] * len(rs), [0] * len(rs)
        for bit, col in enumerate((1, 3, 4, 2)):  # open, high, low, close
            seq = [i for i, r in enumerate(rs) if r[col] is not None]
            i = 0
            while i < len(seq):
                j = i
                while j + 1 < len(seq) and rs[seq[j + 1]][col] == rs[seq[i]][col]:
                    j += 1
                if j - i + 1 >= least:
                    for x in seq[i:j + 1]:
                        frozen[x] |= 1 << bit
                i = j + 1
            seq = [i for i in seq if not bad[i]]
            v = [rs[i][col] for i in seq]
            if len(v) < 2:
                continue
            m = float(np.median(np.abs(np.diff(v))))
            for r in (1, 2, 3):
                for i in range(1, len(v) - r):
                    a, b, run = v[i - 1], v[i + r], v[i:i + r]
                    if min(run) - max(a, b) > factor * m or min(a, b) - max(run) > factor * m:
                        for x in seq[i:i + r]:
                            spike[x] |= 1 << bit
        for i, r in enumerate(rs):
            if bad[i] or frozen[i] or spike[i]:
                out[src, r[0]] = (bad[i], frozen[i], spike[i])
    return out


@pytest.mark.parametrize("seed,factor,least", [(1, 10, 8), (2, 0.5, 2), (3, 2, 3), (4, 1, 12)])
def test_flagged_readings(spark, seed, factor, least):
    df, data = make(spark, 900, seed)
    got = {(r.enumstring, r.stamp_us): (r.impossible, r.frozen, r.spike) for r in spikes.flagged_readings(df, factor, least).collect()}
    assert got == flags(data, factor, least) and len(got) > 50


def test_flags_of_smooth_prices_and_edges(spark):
    """Quiet prices with planted runs, also across the ends of ranges and in sources of one or two rows."""
    rng, data = random.Random(9), []
    for src, n in (("big", 700), ("one", 1), ("two", 2), ("flat", 40)):
        p, t = 50.0, datetime(2021, 1, 1)
        for i in range(n):
            p += 0 if src == "flat" else rng.choice([-0.02, -0.01, 0.01, 0.02])
            t += timedelta(seconds=rng.randint(1, 300))
            x = round(p + (4 if i % 50 in (20, 21, 22)[:1 + i // 50 % 3] else 0), 4)
            if src == "flat" and i == 20:
                x += 0.01
            data.append((len(data), x, x, x + 1, x - 1, 5, src, t, "", "", 0, 0, 0))
    data += [(len(data) + i, *r[1:]) for i, r in enumerate(data[::3])]
    df = spark.createDataFrame(data, SCHEMA)
    want = flags(data)
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.enumstring, r.stamp_us): (r.impossible, r.frozen, r.spike) for r in spikes.flagged_readings(df).collect()}
        assert got == want and any(x[2] for x in want.values()) and any(x[1] for x in want.values())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert spikes.flagged_readings(df.limit(0)).count() == 0
    got = {(r.enumstring, r.stamp_us): (r.impossible, r.frozen, r.spike) for r in spikes.flagged_readings(df, least_run=14).collect()}
    assert got == flags(data, least=14)


def test_medians_by_several_levels(spark):
    """Radix selection with a tiny bound runs through all its levels."""
    df, data = make(spark, 600, 7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = {(r.enumstring, r.stamp_us): (r.impossible, r.frozen, r.spike) for r in spikes.flagged_readings(df, most=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == flags(data)


def test_deviations():
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 60).round(1)
    s = np.array([0] * 25 + [1] * 3 + [2] * 32)
    scale = np.array([0.3, 0.0, np.nan])[s]
    got = spikes.hampel(s, v, scale)[1]
    for i in range(len(v)):
        lo, hi = i - 3, i + 4
        if lo < 0 or hi > len(v) or s[lo] != s[hi - 1]:
            assert np.isnan(got[i])
            continue
        w = v[lo:hi]
        unit = np.fmax(np.median(np.abs(w - np.median(w))), scale[i])
        assert got[i] == abs(v[i] - np.median(w)) / unit if unit > 0 else np.isnan(got[i])


def test_hampel_holds_every_spike():
    """The filter's hits, widened, hold all runs: on made-up series of few levels, where windows tie."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        v = rng.choice([0.0, 0.0, 1.0, 30.0, 31.0, -30.0], rng.integers(5, 60))
        s, scale = np.zeros(len(v), np.int64), np.full(len(v), rng.choice([0.0, 1.0, 2.5]))
        want = np.zeros(len(v), bool)
        for r in (1, 2, 3):
            for i in range(1, len(v) - r):
                run, a, b = v[i:i + r], v[i - 1], v[i + r]
                if run.min() - max(a, b) > 10 * scale[0] or min(a, b) - run.max() > 10 * scale[0]:
                    want[i:i + r] = True
        assert (spikes.spikes(s, v, scale, 10.0)[0] == want).all()


def test_distinct_readings_keeps_first(spark):
    df = spark.createDataFrame([(2, 5.0, "a", datetime(2021, 1, 1)), (1, 4.0, "a", datetime(2021, 1, 1)), (None, 3.0, "a", datetime(2021, 1, 1)), (3, 1.0, None, datetime(2021, 1, 1)), (4, 1.0, "a", None), (5, 1.0, "a", EPOCH)], "rowid long, x double, enumstring string, datetime timestamp_ntz")
    assert rows(distinct_readings(df, ["x"]), "x") == [(4.0,)]


def test_starts():
    assert ordered.starts(np.array([1, 1, 2]), np.array([0, 1, 1])).tolist() == [True, True, True]
    assert ordered.starts(np.array([], int)).tolist() == []
