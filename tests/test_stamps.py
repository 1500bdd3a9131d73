"""Stamp normalisation against the standard library's zones, and fixed cases."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tessella.operators import stamps
from tessella.operators.stamps import NEVER, OK, TWICE, Zones


@pytest.mark.parametrize("name", ["America/New_York", "Europe/London", "Europe/Berlin", "Australia/Sydney", "America/St_Johns", "Asia/Kolkata", "Asia/Tokyo", "America/Phoenix", "UTC", "Africa/Casablanca", "Australia/Lord_Howe", "Pacific/Apia"])
def test_zone_tables(name):
    z, lib, rng = Zones.read().get(name), ZoneInfo(name), random.Random(name)
    near = [int(t) + rng.randint(-7200, 7200) for t in z.at if 0 < t < 4_000_000_000 for _ in range(3)] + [rng.randint(0, 4_000_000_000) for _ in range(300)]
    got = z.offset_at(np.array(near))
    assert [int(x) for x in got] == [int(datetime.fromtimestamp(t, lib).utcoffset().total_seconds()) for t in near]
    local = np.array([t for t in near if 86_400 * 3 < t < 4_000_000_000])
    utc, state = z.to_utc(local)
    epoch = datetime(1970, 1, 1)
    for x, u, s in zip(local.tolist(), utc.tolist(), state.tolist()):
        naive = epoch + timedelta(seconds=x)
        both = {t for fold in (0, 1) if (t := int(naive.replace(tzinfo=lib, fold=fold).timestamp())) + int(datetime.fromtimestamp(t, lib).utcoffset().total_seconds()) == x}
        assert s == {0: NEVER, 1: OK, 2: TWICE}[len(both)], (name, naive)
        if s == OK:
            assert {u} == both


@pytest.mark.parametrize("name", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Tokyo", "America/Nuuk"])
def test_rules_hold_for_any_year(name):
    z, lib, rng = Zones.read().get(name), ZoneInfo(name), random.Random(name)
    at = [rng.randint(4_000_000_000, 250_000_000_000) for _ in range(2000)]
    assert z.offset_at(np.array(at)).tolist() == [int(datetime.fromtimestamp(t, lib).utcoffset().total_seconds()) for t in at]


CASES = [
    ("2021-07-01 12:00:00.5", "Europe/Berlin", "2021-07-01 10:00:00.5", "ok"), ("2021.07.01T12:00:00", "Europe/Berlin", "2021-07-01 10:00:00", "ok"), ("20210701T120000.250Z", None, "2021-07-01 12:00:00.25", "ok"),
    ("01-Jul-2021 12:00:00", "UTC", "2021-07-01 12:00:00", "ok"), ("Jul 01 2021 12:00:00 AM", "UTC", "2021-07-01 00:00:00", "ok"), ("Jul 01 2021 12:00:00.1 PM", "UTC", "2021-07-01 12:00:00.1", "ok"), ("Jul 01 2021 13:00:00 PM", "UTC", None, "unreadable"),
    ("2021-07-01T12:00:00+05:30", None, "2021-07-01 06:30:00", "ok"), ("2021-07-01 12:00:00 -0330", None, "2021-07-01 15:30:00", "ok"), ("2021.07.01T12:00:00,123-04", None, "2021-07-01 16:00:00.123", "ok"),
    ("2021-07-01T12:00:00-04:00[America/New_York]", None, "2021-07-01 16:00:00", "ok"), ("2021-07-01T12:00:00-05:00[America/New_York]", None, None, "offset is not the zone's"), ("2021-07-01T12:00:00-04:00[Nowhere/Land]", None, None, "unknown zone"),
    ("2021-07-01 12:00:00 EDT", "America/New_York", "2021-07-01 16:00:00", "ok"), ("2021-07-01 12:00:00 CEST", None, "2021-07-01 10:00:00", "ok"), ("2021-07-01 12:00:00 IST", "Asia/Kolkata", "2021-07-01 06:30:00", "ok"), ("2021-07-01 12:00:00 IST", None, None, "unknown zone"), ("2021-07-01 12:00:00 BST", "Europe/London", "2021-07-01 11:00:00", "ok"),
    ("2021-07-01 12:00:00 Asia/Tokyo", "Europe/Berlin", "2021-07-01 03:00:00", "ok"), ("2021-11-07 01:30:00", "America/New_York", None, "local time occurs twice"), ("2021-11-07 01:30:00 EST", "America/New_York", "2021-11-07 06:30:00", "ok"), ("2021-03-14 02:30:00", "America/New_York", None, "local time does not occur"),
    ("2021-07-01 12:00:00", None, None, "unknown zone"), ("2021-07-01 12:00:00", "Mars/Base", None, "unknown zone"), ("1625140800", None, "2021-07-01 12:00:00", "ok"), ("1625140800123", None, "2021-07-01 12:00:00.123", "ok"), ("1625140800123456", None, "2021-07-01 12:00:00.123456", "ok"), ("1625140800123456789", None, "2021-07-01 12:00:00.123456", "ok"), ("9999999999999999999", None, "2286-11-20 17:46:39.999999", "ok"), ("16251408001", None, None, "unreadable"),
    ("2021-02-29 12:00:00", "UTC", None, "unreadable"), ("2021-07-01 24:00:00", "UTC", None, "unreadable"), ("2021-07-01 12:00:60", "UTC", None, "unreadable"), ("2021-07.01 12:00:00", "UTC", None, "unreadable"), ("2021-07-01X12:00:00", "UTC", None, "unreadable"), ("", "UTC", None, "unreadable"), (None, "UTC", None, "null"), ("unset", "UTC", None, "unreadable"), ("2021-07-01 12:00:00é", "UTC", None, "unreadable"), ("９９", "UTC", None, "unreadable"), ("x" * 100_000, "UTC", None, "unreadable"), ("01-Abc-2021 12:00:00", "UTC", None, "unreadable"), ("2021-07-01T12:00:00A", "UTC", None, "unreadable"),
    ("2150-07-01 12:00:00", "Europe/Berlin", "2150-07-01 10:00:00", "ok"), ("9150.01.01T12:00:00", "Europe/Berlin", "9150-01-01 11:00:00", "ok"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _, _) in enumerate(CASES)], "id long, v string, z string").selectExpr("*", "1 as k", "2 as f0", "'x' as state")
    got = {r.id: r for r in stamps.normalised(df, ["v"], "id", "z").collect()}
    for i, (v, z, want, state) in enumerate(CASES):
        assert got[i].state == state, (v, z, got[i])
        assert got[i].instant == (datetime.fromisoformat(want) if want else None), (v, z)
    assert got[27].nano == 123456789
    assert stamps.normalised(df.limit(0), ["v"], "id", "z").count() == 0


def test_contradictions(spark):
    u = "2021-07-01 12:00:0%dZ".replace(" ", "T")
    rows = [(1, u % 1, u % 1, u % 1, u % 2), (2, u % 1, u % 2, None, ""), (3, u % 1, u % 1, u % 2, u % 2), (4, u % 1, u % 1, u % 2, None), (5, u % 1, None, None, None)]
    df = spark.createDataFrame(rows, "intcol long, millis string, micros string, nanos string, seminanos string").selectExpr("*", "cast(null as string) as zone")
    got = {(r.intcol, r.field) for r in stamps.suspicious(stamps.normalised(df)).collect()}
    assert got == {(1, "seminanos"), (2, "millis"), (2, "micros"), (2, "seminanos"), (3, "millis"), (3, "micros"), (3, "nanos"), (3, "seminanos"), (4, "nanos")}


def test_whole_table_against_standard_library(spark, sf):
    """Another reading of every value: datetime.strptime by a list of formats, zones by zoneinfo."""
    import re

    formats = ["%Y.%m.%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d-%b-%Y %H:%M:%S", "%Y%m%dT%H%M%S", "%b %d %Y %I:%M:%S %p"]
    # offsets that the test data's abbreviations stand for
    abbr = {"GMT": 0, "UTC": 0, "EST": -5, "EDT": -4, "CET": 1, "CEST": 2, "AEST": 10, "AEDT": 11}

    def second(v, zone):
        if re.fullmatch(r"\d{10}|\d{13}|\d{16}|\d{19}", v):
            return int(v[:10])
        m = re.fullmatch(r"(.*?)(?:[.,](\d{1,9}))?( [AP]M)?(Z| [A-Z]{3,4}| ?[+-]\d\d(?::?\d\d)?(?:\[.*\])?| \w+/\w+)?", v)
        if not m:
            return None
        for f in formats:
            try:
                t = datetime.strptime(m[1] + (m[3] or ""), f)
                break
            except ValueError:
                continue
        else:
            return None
        tail = (m[4] or "").strip()
        if tail == "Z":
            return int(t.replace(tzinfo=timezone.utc).timestamp())
        if tail in abbr:
            return int(t.replace(tzinfo=timezone.utc).timestamp()) - abbr[tail] * 3600
        o = re.match(r"([+-])(\d\d):?(\d\d)?", tail)
        if o:
            return int(t.replace(tzinfo=timezone.utc).timestamp()) - int(o[1] + "1") * (int(o[2]) * 3600 + int(o[3] or 0) * 60)
        zone = tail or zone
        if zone is None:
            return None
        lib = ZoneInfo(zone)
        both = {x for fold in (0, 1) if datetime.fromtimestamp(x := t.replace(tzinfo=lib, fold=fold).timestamp(), lib).replace(tzinfo=None) == t}
        return int(both.pop()) if len(both) == 1 else None

    table = spark.read.parquet(f"{sf}/data_stamps.parquet")
    got = {(r.intcol, r.field): r for r in stamps.normalised(table).collect()}
    n = 0
    for r in table.collect():
        for f in stamps.FIELDS:
            if r[f] is not None:
                want = second(r[f], r["zone"])
                x = got[r.intcol, f]
                assert (x.state == "ok") == (want is not None), (r[f], r["zone"], x)
                if want is not None:
                    assert int((x.instant - datetime(1970, 1, 1)).total_seconds() // 1) == want
                    n += 1
    assert n > 100
