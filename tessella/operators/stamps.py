"""Stamps in mixed notations and zones, normalised to UTC instants.

A value is reduced to its shape: digits to 9, letters to A or a, the rest as it is. Each distinct
shape is mapped to a parser (the places of its fields) once, and all values of a shape are converted
together. Zones are looked up in transition tables of one version of the zone database: the driver
reads it and ships it with the plan, so that all machines convert by the same tables. Map-only: one
pass, no shuffle.
"""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("millis", "micros", "nanos", "seminanos")
OK, NULL, UNREADABLE, NO_ZONE, TWICE, NEVER, CLASH = range(7)
STATES = ("ok", "null", "unreadable", "unknown zone", "local time occurs twice", "local time does not occur", "offset is not the zone's")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Rules are written out up to this year; later instants fall back by whole cycles of the calendar, of
#: 400 years each, into the written years, which is exact for any year.
WRITTEN_YEAR = 2500
CYCLE = 146_097 * 86_400
END = ((WRITTEN_YEAR - 1970) * 365 + 129) * 86_400


# zone tables


class Zone:
    """Transitions of one zone: UTC seconds, the offsets before, between and after, and the offsets
    that each of its abbreviations has had since 1970 and since 2000."""

    def __init__(self, data: bytes):
        v2 = self._block(data, 0, 4)[1]
        (at, kinds, types, names), end = self._block(data, v2, 8)
        name = lambda x: names[x[2]:].split(b"\0")[0].decode()
        self.rule = data[end:].strip(b"\n").decode()
        first = next((x for x in types if not x[1]), types[0])
        self.at = np.array(at, np.int64)
        self.offset = np.array([first[0], *[types[k][0] for k in kinds]], np.int64)
        spans = [(first[0], name(first)), *[(types[k][0], name(types[k])) for k in kinds]]
        ends = [*at, 2**62]
        when, offsets, ruled = posix_transitions(self.rule)
        if len(when):
            later = when > (self.at[-1] if len(self.at) else -(2**40))
            self.at, self.offset = np.append(self.at, when[later]), np.append(self.offset, offsets[later])
            spans, ends = spans + ruled, ends + [2**62] * len(ruled)
        self.abbr: dict[str, set[int]] = defaultdict(set)
        self.recent: dict[str, set[int]] = defaultdict(set)
        for (off, word), end_at in zip(spans, ends):
            for least, out in ((0, self.abbr), (946_684_800, self.recent)):
                if end_at > least and word.isalpha():
                    out[word].add(off)

    @staticmethod
    def _block(data: bytes, at: int, wide: int) -> tuple:
        if data[at:at + 4] != b"TZif":
            raise ValueError("not a zone file")
        isut, isstd, leap, n, kinds, chars = struct.unpack(">6l", data[at + 20:at + 44])
        p = at + 44
        when = struct.unpack(f">{n}{'q' if wide == 8 else 'l'}", data[p:p + wide * n])
        p += wide * n
        index = data[p:p + n]
        p += n
        types = [struct.unpack(">lBB", data[p + 6 * i:p + 6 * i + 6]) for i in range(kinds)]
        p += 6 * kinds
        names = data[p:p + chars]
        end = p + chars + leap * (wide + 4) + isstd + isut
        return ((when, index, types, names), end)

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        beyond = np.maximum(-((END - 1 - utc) // CYCLE), 0)
        return self.offset[np.searchsorted(self.at, utc - beyond * CYCLE, side="right")]

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of local seconds, and the state: read once, twice or never."""
        a, b = self.offset_at(local - 86_400), self.offset_at(local + 86_400)
        ua, ub = local - a, local - b
        at_a, at_b = self.offset_at(ua) == a, self.offset_at(ub) == b
        state = np.where(at_a & at_b & (a != b), TWICE, np.where(at_a | at_b, OK, NEVER))
        return np.where(at_a, ua, ub), state


def posix_transitions(rule: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Transitions from 1970 to ``WRITTEN_YEAR`` by a POSIX zone rule such as ``EST5EDT,M3.2.0,M11.1.0``:
    their instants in order, the offsets after them, and both offsets with their names."""
    name, num = r"(<[^>]+>|[A-Za-z]+)", r"([+-]?\d+(?::\d+){0,2})"
    m = re.fullmatch(rf"{name}{num}(?:{name}{num}?,([^,]+),([^,]+))?", rule)
    if not m or not m.group(3):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def seconds(t: str) -> int:
        sign = -1 if t.startswith("-") else 1
        return sign * sum(int(x) * y for x, y in zip(t.lstrip("+-").split(":"), (3600, 60, 1)))

    years = np.arange(1970, WRITTEN_YEAR + 1)
    first_of = lambda month: ((years - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)

    def when(spec: str) -> np.ndarray:
        day, _, time = spec.partition("/")
        if day[0] == "M":
            mon, week, dow = map(int, day[1:].split("."))
            first = first_of(mon)
            d = first + (dow - first - 4) % 7 + 7 * (week - 1)
            d = np.where(d >= first_of(mon + 1), d - 7, d)
        elif day[0] == "J":
            n = int(day[1:])
            leap = first_of(13) - first_of(1) == 366
            d = first_of(1) + n - 1 + (leap & (n >= 60))
        else:
            d = first_of(1) + int(day)
        return d * 86_400 + (seconds(time) if time else 7200)

    std = -seconds(m.group(2))
    dst = -seconds(m.group(4)) if m.group(4) else std + 3600
    at = np.concatenate([when(m.group(5)) - std, when(m.group(6)) - dst])
    by = np.argsort(at, kind="stable")
    return at[by], np.repeat([dst, std], len(years))[by], [(std, m.group(1).strip("<>")), (dst, m.group(3).strip("<>"))]


AREAS = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")


class Zones:
    """One version of the zone database; tables are made when first asked for."""

    def __init__(self, files: dict[str, bytes], version: str = "unknown"):
        self.files, self.version = files, version
        self.held: dict[str, Zone | None] = {}
        self._global: dict[str, int] | None = None

    @classmethod
    def read(cls, folder: str | None = None) -> Zones:
        """The database of a folder (default: the system's, else the package ``tzdata``)."""
        place = Path(folder) if folder else default_folder()
        version = "unknown"
        for name in ("tzdata.zi", "+VERSION", "version"):
            if version == "unknown" and (place / name).exists():
                version = (place / name).open().readline().strip("# \n").removeprefix("version ")
        files = {}
        for path in place.rglob("*"):
            name = str(path.relative_to(place))
            if re.fullmatch(r"[A-Za-z][A-Za-z0-9_+/-]*", name) and not name.startswith(("posix/", "right/")) and path.is_file():
                data = path.read_bytes()
                if data[:4] == b"TZif":
                    files[name] = data
        return cls(files, version)

    def get(self, name: str) -> Zone | None:
        if name not in self.held:
            try:
                self.held[name] = Zone(self.files[name]) if name in self.files else None
            except (ValueError, struct.error):
                self.held[name] = None
        return self.held[name]

    def abbreviation(self, name: str, zone: str | None) -> int | None:
        """Offset of an abbreviation: as the row's zone uses it, else if all zones since 2000 agree on it."""
        z = self.get(zone) if zone else None
        if z and len(z.abbr.get(name, ())) == 1:
            return next(iter(z.abbr[name]))
        if self._global is None:
            seen: dict[str, set[int]] = defaultdict(set)
            for place in self.files:
                z = self.get(place) if place.startswith(AREAS) else None
                for k, v in (z.recent if z else {}).items():
                    seen[k] |= v
            self._global = {k: next(iter(v)) for k, v in seen.items() if len(v) == 1}
        return self._global.get(name)


def default_folder() -> Path:
    import importlib.util
    import zoneinfo

    for p in map(Path, zoneinfo.TZPATH):
        if (p / "UTC").exists():
            return p
    spec = importlib.util.find_spec("tzdata")
    if spec is None or spec.origin is None:
        raise FileNotFoundError("no zone database; name its folder")
    return Path(spec.origin).parent / "zoneinfo"


@lru_cache(8)
def packed(folder: str | None) -> bytes:
    """The database of a folder, small enough to travel with a plan (a few hundred kilobytes)."""
    db = Zones.read(folder)
    return zlib.compress(pickle.dumps((db.files, db.version)))


@lru_cache(2)
def unpacked(data: bytes) -> Zones:
    return Zones(*pickle.loads(zlib.decompress(data)))


# shapes

SHAPE = re.compile(
    r"(?:(?P<ymd>9{4}([-./])99\2(?:99))|(?P<basic>9{8})|(?P<dmy>99-A[Aa][Aa]-9999)|(?P<mdy>A[Aa][Aa] 99 9999))"
    r"(?P<sep>[A ])(?:(?P<clock>99:99:99)|(?P<packed>999999))(?:[.,](?P<frac>9{1,9}))?(?P<half> AA(?![A-Za-z/]))?"
    r"(?:(?P<z>A)|(?P<off> ?[+-]99(?::?99)?)(?:\[(?P<at>[^\]]+)\])?| (?P<name>[A-Za-z][A-Za-z0-9_+/-]*))?")
EPOCH = {10: 1, 13: 1_000, 16: 1_000_000, 19: 1_000_000_000}
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[48:58] = ord("9")
CLASSES[65:91] = ord("A")
CLASSES[97:123] = ord("a")
MONTH_CODES = {int.from_bytes(m.encode(), "big"): i + 1 for i, m in enumerate(MONTHS)}


@lru_cache(100_000)
def plan(shape: str) -> dict | None:
    """The places of a shape's fields; null if no parser reads it. Only ASCII shapes are read."""
    if not shape.isascii():
        return None
    if shape == "9" * len(shape) and len(shape) in EPOCH:
        return {"epoch": EPOCH[len(shape)]}
    m = SHAPE.fullmatch(shape)
    if not m or bool(m["clock"]) != (m["basic"] is None):
        return None
    at = lambda g, a, b: (m.start(g) + a, m.start(g) + b)
    if m["ymd"]:
        day = at("ymd", 0, 4), at("ymd", 5, 7), at("ymd", 8, 10)
    elif m["basic"]:
        day = at("basic", 0, 4), at("basic", 4, 6), at("basic", 6, 8)
    elif m["dmy"]:
        day = at("dmy", 7, 11), at("dmy", 3, 6), at("dmy", 0, 2)
    else:
        day = at("mdy", 7, 11), at("mdy", 0, 3), at("mdy", 4, 6)
    clock = [at("clock", a, a + 2) for a in (0, 3, 6)] if m["clock"] else [at("packed", a, a + 2) for a in (0, 2, 4)]
    span = lambda g: m.span(g) if m[g] else None
    return {"day": day, "named": bool(m["dmy"] or m["mdy"]), "sep": m.start("sep"), "t": m["sep"] == "A", "clock": clock} | {g: span(g) for g in ("frac", "half", "z", "off", "at", "name")}


def number(b: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(b), np.int64)
    for i in range(*span):
        out = out * 10 + b[:, i].astype(np.int64) - 48
    return out


def words(b: np.ndarray, span: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """The distinct words at a place, and each row's index into them."""
    part = np.ascontiguousarray(b[:, span[0]:span[1]]).view(f"S{span[1] - span[0]}").ravel()
    distinct, index = np.unique(part, return_inverse=True)
    return [w.decode("ascii") for w in distinct], index


def days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which dates exist."""
    ok = (m >= 1) & (m <= 12) & (y >= 1)
    mm, yy = np.where(ok, m, 1), np.where(ok, y, 1970)
    months = (yy - 1970) * 12 + mm - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    last = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d >= 1) & (d <= last - first)


def read_shape(p: dict, b: np.ndarray, row_zone: tuple[list, np.ndarray], db: Zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds, nanoseconds and state of the values (bytes ``b``) of one shape."""
    n = len(b)
    if "epoch" in p:
        width = b.shape[1]
        scale = p["epoch"]
        head = number(b, (0, width - len(str(scale)) + 1))
        rest = number(b, (width - len(str(scale)) + 1, width)) if scale > 1 else np.zeros(n, np.int64)
        return head, rest * (1_000_000_000 // scale), np.full(n, OK)
    y, d = number(b, p["day"][0]), number(b, p["day"][2])
    if p["named"]:
        x = (b[:, slice(*p["day"][1])] | 32).astype(np.int64)
        code = (x[:, 0] << 16) | (x[:, 1] << 8) | x[:, 2]
        m = np.zeros(n, np.int64)
        for c in np.unique(code):
            m[code == c] = MONTH_CODES.get(int(c), 0)
    else:
        m = number(b, p["day"][1])
    h, mi, s = (number(b, c) for c in p["clock"])
    day, ok = days(y, m, d)
    if p["t"]:
        ok &= b[:, p["sep"]] == ord("T")
    if p["half"]:
        letter = b[:, p["half"][0] + 1]
        ok &= np.isin(letter, (65, 80)) & (b[:, p["half"][0] + 2] == 77) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (letter == 80)
    ok &= (h < 24) & (mi < 60) & (s < 60)
    local = day * 86_400 + h * 3600 + mi * 60 + s
    nano = np.zeros(n, np.int64)
    if p["frac"]:
        nano = number(b, p["frac"]) * 10 ** (9 - (p["frac"][1] - p["frac"][0]))
    state, utc = np.where(ok, OK, UNREADABLE), local.copy()

    def place(name: str | None, mine: np.ndarray) -> None:
        z = db.get(name) if name else None
        if z is None:
            state[mine] = NO_ZONE
        else:
            utc[mine], state[mine] = z.to_utc(local[mine])

    if p["z"]:
        state[b[:, p["z"][0]] != ord("Z")] = UNREADABLE
    elif p["off"]:
        names, index = words(b, p["off"])
        for i, w in enumerate(names):
            digits = w.strip().replace(":", "")
            hh, mm = int(digits[1:3]), int(digits[3:] or 0)
            mine = index == i
            utc[mine] -= (hh * 3600 + mm * 60) * (-1 if digits[0] == "-" else 1)
            if hh > 18 or mm > 59:
                state[mine] = UNREADABLE
        if p["at"]:
            names, index = words(b, p["at"])
            for i, name in enumerate(names):
                mine, z = np.flatnonzero((index == i) & (state == OK)), db.get(name)
                if z is None:
                    state[mine] = NO_ZONE
                else:  # offset and zone must agree
                    state[mine[z.offset_at(utc[mine]) != local[mine] - utc[mine]]] = CLASH
    elif p["name"]:
        names, index = words(b, p["name"])
        for i, name in enumerate(names):
            if "/" in name or not name.isupper() or name == "UTC":
                place(name, np.flatnonzero((index == i) & ok))
                continue
            for j, zone in enumerate(row_zone[0]):
                mine = np.flatnonzero((index == i) & (row_zone[1] == j) & ok)
                off = db.abbreviation(name, zone) if len(mine) else None
                if off is None:
                    state[mine] = NO_ZONE
                else:
                    utc[mine] -= off
    else:
        for j, zone in enumerate(row_zone[0]):
            place(zone, np.flatnonzero((row_zone[1] == j) & ok))
    return utc, nano, state


def read(column: pa.Array, zone: pa.Array, db: Zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds, nanoseconds and state of each value."""
    n = len(column)
    sec, nano, state = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, UNREADABLE)
    state[np.asarray(column.is_null())] = NULL
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    shapes = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(at).tobytes()), pa.py_buffer(CLASSES[raw].tobytes())).dictionary_encode()
    index = shapes.indices.to_numpy(zero_copy_only=False)
    zoned = zone.dictionary_encode()
    znames = [*zoned.dictionary.to_pylist(), None]
    zindex = zoned.indices.fill_null(len(znames) - 1).to_numpy(zero_copy_only=False)
    order = np.argsort(index, kind="stable")
    cuts = np.searchsorted(index[order], np.arange(len(shapes.dictionary) + 1))
    for i, shape in enumerate(shapes.dictionary.to_pylist()):
        p = plan(shape)
        if p is None:
            continue
        rows = order[cuts[i]:cuts[i + 1]]
        rows = rows[state[rows] != NULL]
        b = raw[at[rows][:, None] + np.arange(len(shape))]
        sec[rows], nano[rows], state[rows] = read_shape(p, b, (znames, zindex[rows]), db)
    return sec, nano, state


def contradicting(sec: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Values (rows by fields) in another second than the one that more than half of the row's other
    readable values share."""
    out = np.zeros_like(ok)
    for i in range(sec.shape[1]):
        others = [j for j in range(sec.shape[1]) if j != i]
        k = ok[:, others].sum(1)
        for j in others:
            same = (ok[:, others] & (sec[:, others] == sec[:, [j]])).sum(1)
            out[:, i] |= ok[:, i] & ok[:, j] & (2 * same > k) & (sec[:, j] != sec[:, i])
    return out


def normalised(df: DataFrame, fields: Sequence[str] = FIELDS, key: str = "intcol", zone: str = "zone", folder: str | None = None, rows: int = 50_000) -> DataFrame:
    """One row per row of ``df`` and field: ``(key, field, instant, nano, state, contradicts, zones)``.

    ``instant`` is the UTC time (microseconds; ``nano`` the nanoseconds of its second), null unless
    ``state`` is ``ok``; the other states say why a value denotes no single instant. Values without
    zone are read in the row's ``zone`` (an IANA name), abbreviations as that zone uses them, else
    as all zones do. ``contradicts`` marks an instant in another second than the one shared by most
    of the row's other instants. Null values have state ``null``; empty ones are unreadable.
    ``folder`` names the zone database's folder on the driver, ``zones`` is its version; rules hold for
    any year. Empty input gives no rows; other columns are dropped."""
    fields, shipped = list(fields), packed(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, held = unpacked(shipped), []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= rows:
                yield from convert(held, db)
                held = []
        if held:
            yield from convert(held, db)

    def convert(held: list[pa.RecordBatch], db: Zones) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        got = [read(one(f"f{i}"), one("z"), db) for i in range(len(fields))]
        sec, nano, state = (np.stack([g[i] for g in got], 1) for i in range(3))
        against = contradicting(sec, state == OK).ravel()
        n, m = state.shape
        state, sec, nano = state.ravel(), sec.ravel(), nano.ravel()
        none = state != OK
        yield pa.RecordBatch.from_arrays([
            one("k").take(pa.array(np.repeat(np.arange(n), m))),
            pa.DictionaryArray.from_arrays(np.tile(np.arange(m), n), pa.array(fields)).cast(pa.string()),
            pa.array(sec * 1_000_000 + nano // 1000, mask=none).cast(pa.timestamp("us")),
            pa.array(nano, mask=none).cast(pa.int32()),
            pa.DictionaryArray.from_arrays(state, pa.array(STATES)).cast(pa.string()),
            pa.array(against),
        ], names=["k", "field", "instant", "nano", "state", "contradicts"])

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(F.col(key).alias("k"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)], F.col(zone).alias("z"))
    return picked.mapInArrow(run, f"k {kind}, field string, instant timestamp_ntz, nano int, state string, contradicts boolean").withColumn("zones", F.lit(unpacked(shipped).version)).withColumnRenamed("k", key)


def suspicious(instants: DataFrame, key: str = "intcol") -> DataFrame:
    """Keys and fields of non-null values that denote no single instant, or contradict their row."""
    return instants.filter(~F.col("state").isin("ok", "null") | F.col("contradicts")).select(key, "field")
