"""The error parse against a plain state machine, exact round trips and made-up breakage."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import records
from tessella.operators.records import Parser, counter_bits, describe, solve


def plain(line, delim, fields=8):
    """Fields of a well-formed record, or None: written without the operator's grammar tables."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == "\\":
                    if i + 1 >= n:
                        return None
                    text, i = text + line[i + 1], i + 2
                elif line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        text, i = text + '"', i + 2
                    else:
                        i += 1
                        break
                else:
                    text, i = text + line[i], i + 1
            if i < n and line[i] != delim:
                return None
            out.append(text)
        else:
            j = i
            while j < n and line[j] != delim:
                if line[j] in '"\n':
                    return None
                j += 1
            out.append(line[i:j])
            i = j
        if i >= n:
            return out if len(out) == fields else None
        i += 1


LINE = st.text(alphabet='ab,"\\\n', max_size=14)


@settings(max_examples=600, deadline=None)
@given(LINE, st.integers(1, 4))
def test_zero_cost_is_well_formed(line, fields):
    (cost, edits, got), = Parser(fields)([line], [","])
    if not line.strip():
        assert cost is None
        return
    want = plain(line, ",", fields)
    assert (cost == 0) == (want is not None)
    assert got == want
    assert (edits is None) == (cost == 0)


def edited(line):
    """All lines one edit away."""
    for i in range(len(line) + 1):
        for c in '",':
            yield line[:i] + c + line[i:]
        if i < len(line) and line[i] in '",':
            yield line[:i] + line[i + 1:]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet='a,"\\\n', min_size=1, max_size=6).filter(str.strip))
def test_cost_is_least_number_of_edits(line):
    """Brute force: breadth-first search over edited lines."""
    (cost, _, _), = Parser(2)([line], [","])
    seen, front, n = {line}, [line], 0
    while n <= 2 and not any(plain(x, ",", 2) is not None for x in front):
        front = [y for y in {y for x in front for y in edited(x)} - seen]
        seen.update(front)
        n += 1
    if n <= 2:
        assert cost == n
    else:
        assert cost > 2


def test_edits_are_named():
    lines = ["a,b", "a,b,c,d", 'a,b"b,c', "a,b,c", 'a,"b",c"']
    said = [e for _, e, _ in Parser(3)(lines, [","] * 5)]
    assert said == ["insert delimiter x1", "delete delimiter x1", "delete quote x1", None, "insert quote x1"]


def test_very_long_records():
    p = Parser(3)
    ok, many, quotes = "x" * 1_000_000 + ",y,z", 'a"' * 3000 + ",b,c", '"' + '""' * 4000 + '",a,b'
    got = list(p([ok, many, quotes, 'a,' + '"' * 5001 + ",c"], [","] * 4))
    assert got[0][0] == 0 and got[2][0] == 0 and got[2][2][0] == '"' * 4000
    assert got[1][0] == 3000 and got[1][1] in ("insert quote x2998, delete quote x2", "delete quote x3000", "insert quote x3000")
    assert sum(int(x.rsplit("x", 1)[1]) for x in got[1][1].split(", ")) == 3000
    assert got[3][0] > 0


def test_weights_agree_with_costs():
    rng = random.Random(5)
    shapes = ["".join(rng.choice("odqbn") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    bits = counter_bits(max(map(len, shapes)), 8)
    packed = [describe(w, bits) for w in solve(shapes, 8)]
    alone = [describe(solve([s], 8)[0], counter_bits(len(s), 8)) for s in shapes]
    assert packed == alone


def test_counts_are_exact_at_any_length():
    # in 64 bits, and in Python's whole numbers, where the batch holds a long shape
    shapes = ["oq" * 40 + "d" * 9, "dq" * 30, "oqd" * 20]
    long = "oqd" * 1500
    for s in shapes:
        alone = describe(solve([s], 8)[0], counter_bits(len(s), 8))
        beside = describe(solve([s, long], 8)[0], counter_bits(len(long), 8))
        assert alone == beside
    cost, edits = describe(solve([long], 8)[0], counter_bits(len(long), 8))
    assert cost == sum(int(x.rsplit("x", 1)[1]) for x in edits.split(", "))


GOOD = "1.5,-.5,+2e3,1E-2,-17,abc,\"x,y\",2021.02.28T23:59:59.999"
CASES = {
    GOOD: True, GOOD + "\r": True, "": None, " \t": None, "\r": None, ",,,,,,,": True, GOOD.replace("02.28", "02.29"): False, GOOD.replace("2021.02.28", "2020.02.29"): True,
    GOOD.replace("23:59:59", "24:00:00"): False, GOOD.replace("59.999", "60.999"): False, GOOD.replace(".999", ".99"): False, GOOD.replace(".999", ""): False, GOOD.replace("-17", "1.7"): False,
    GOOD.replace("-17", "+17"): True, GOOD.replace("-17", '"+17"'): True, GOOD.replace("-17", " 17"): False, GOOD.replace("1.5", "1."): False, GOOD.replace("1.5", "nan"): False, GOOD.replace("1.5", "1,5"): False,
    GOOD.replace("abc", 'a"b'): False, GOOD.replace("abc", '"a""b\\"c\n"'): True, GOOD.replace("abc", "a\\b"): True, GOOD.replace("abc", "a\nb"): False, GOOD.replace("abc", '"a"b'): False, GOOD.replace("abc", '"a\\'): False,
    GOOD.replace("-17", "9" * 25): False,
}


def test_lines(spark):
    data = [(i, "f", i + 2, ",", x) for i, x in enumerate(CASES)] + [(100, "f", 1, ",", "open,close"), (101, "f", 9, None, GOOD), (102, "f", 9, ",", None), (103, "f", 9, '"', GOOD), (104, "f", None, ",", GOOD)]
    df = spark.createDataFrame(data, "line_id long, file_name string, line_no long, delim string, line string").selectExpr("*", "1 as volume", "'mine' as reason")
    p = records.parsed_lines(df)
    ok = {r.line_id for r in records.loaded(p).collect()}
    bad = {r.line_id: r.reason for r in records.rejected(p).collect()}
    assert ok == {i for i, x in enumerate(CASES.values()) if x} | {104}
    assert set(bad) == {i for i, x in enumerate(CASES.values()) if x is False} | {101, 103}
    assert all(bad.values()) and bad[101] == "unusable delimiter"
    first = records.loaded(p).filter("line_id = 0").first()
    assert (first.open, first.close, first.high, first.low, first.volume, first.astring, first.en_umstring, first.datetime) == (1.5, -0.5, 2000.0, 0.01, -17, "abc", "x,y", datetime(2021, 2, 28, 23, 59, 59, 999000))
    empty = records.loaded(p).filter(f"line_id = {list(CASES).index(',,,,,,,')}").first()
    assert empty.open is None and empty.datetime is None and empty.astring == ""
    none = records.parsed_lines(df.limit(0))
    assert records.loaded(none).count() == records.rejected(none).count() == 0


def test_stamps(spark):
    cases = [("2021.01.02T03:04:05.678", None, True), ("2021.01.02T03:04:05", "2021.01.02T03:04:05.123456789", True), ("", "", True), ("2021.01.02T03:04:05.6", "", False), (None, "2021.01.02T03:04:05.678", False), ("2021.13.02T03:04:05", None, False), ("x", None, False), ("2021.01.02T03:04:05.678Z", None, False), ("2021.01.02T03:04:05.678\n", None, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "intcol long, brokenmillis string, brokennanos string")
    p = records.parsed_stamps(df)
    assert {r.intcol for r in records.rejected(p).collect()} == {i for i, c in enumerate(cases) if not c[2]}
    r = records.loaded(p).filter("intcol = 1").first()
    assert r.brokennanos == datetime(2021, 1, 2, 3, 4, 5, 123456) and r.brokennanos_ns == 123456789 and r.brokenmillis_ns == 0


def test_real_dates(spark):
    days = [f"{y:04}.{m:02}.{d:02}" for y in (0, 1, 4, 1900, 1999, 2000, 2023, 2024, 9999) for m in range(14) for d in range(33)]

    def real(s):
        try:
            return bool(datetime.strptime(s, "%Y.%m.%d"))
        except ValueError:
            return False

    df = spark.createDataFrame([(s, s + "T00:00:00.000") for s in days], "s string, t string")
    from pyspark.sql import functions as F

    got = dict(df.select("s", records.is_stamp(F.col("t"))).collect())
    assert got == {s: real(s) for s in days}


def test_whole_table_against_plain_parser(spark, sf):
    import re

    t = spark.read.parquet(f"{sf}/simple_qesc.parquet")
    number, stamp = re.compile(r"[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?", re.A), re.compile(r"\d{4}\.\d\d\.\d\dT\d\d:\d\d:\d\d\.\d{3}", re.A)

    def valid(f):
        if any(x and not number.fullmatch(x) for x in f[:4]) or (f[4] and not re.fullmatch(r"[+-]?\d+", f[4], re.A)):
            return False
        if not f[7]:
            return True
        try:
            return bool(stamp.fullmatch(f[7]) and datetime.strptime(f[7], "%Y.%m.%dT%H:%M:%S.%f"))
        except ValueError:
            return False

    want = set()
    for r in t.collect():
        line = r.line[:-1] if r.line.endswith("\r") else r.line
        if r.line_no > 1 and line.strip():
            f = plain(line, r.delim)
            if f is None or not valid(f):
                want.add(r.line_id)
    assert {r.line_id for r in records.rejected(records.parsed_lines(t)).collect()} == want and want
