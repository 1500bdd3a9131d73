"""Stamps: fields, relative times, bars, formatting.

Stamps are zone-less UTC timestamps; the session's zone must be UTC.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compare import as_col

UNIT_US = {"d": 86_400_000_000, "h": 3_600_000_000, "i": 60_000_000, "s": 1_000_000}
UP = {"s": "minute", "i": "hour", "h": "day", "d": "month", "m": "year"}
OWN = {"s": "second", "i": "minute", "h": "hour", "d": "day", "m": "month", "y": "year"}


@dataclass(frozen=True)
class Relative:
    """A relative time such as 1y2m3d4h5i6s (i: minutes). Unnamed components are null."""

    y: int | None = None
    m: int | None = None
    d: int | None = None
    h: int | None = None
    i: int | None = None
    s: int | None = None

    @classmethod
    def of(cls, text: str) -> Relative:
        parts = re.findall(r"(-?\d+)([ymdhis])", text)
        if not parts or "".join(a + b for a, b in parts) != text:
            raise ValueError(f"not a relative time: {text!r}")
        return cls(**{u: int(n) for n, u in parts})

    @property
    def named(self) -> dict[str, int]:
        return {u: n for u in "ymdhis" if (n := getattr(self, u)) is not None}


def relative(r: Relative | str) -> Relative:
    return Relative.of(r) if isinstance(r, str) else r


def us(t) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(as_col(t).cast("timestamp"))


def from_us(n) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def field(name: str, t) -> Column:
    """year, month, day, hour, minute, second, week, date, time, or millisecond, microsecond and
    nanosecond, each a subdivision of the second."""
    t = as_col(t)
    below = F.pmod(us(t), F.lit(1_000_000))
    if name == "week":
        return F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7) + 1
    if name == "date":
        return F.date_trunc("day", t).cast("timestamp_ntz")
    if name == "time":
        return from_us(F.pmod(us(t), F.lit(UNIT_US["d"])))
    if name in ("millisecond", "microsecond", "nanosecond"):
        return {"millisecond": F.floor(below / 1000), "microsecond": below, "nanosecond": below * 1000}[name]
    return {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}[name](t)


def shift_by(t, r: Relative | str, sign: int = 1) -> Column:
    """Stamp plus (or minus) a relative time, each component added to the broken-down time before it
    is normalised: a month after January 31 is March 3 (or 2)."""
    t, r = as_col(t), relative(r).named
    months = sign * (r.get("y", 0) * 12 + r.get("m", 0))
    out = us(t)
    if months:
        index = F.year(t) * 12 + F.month(t) - 1 + months
        first = F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
        days = F.unix_date(F.date_add(first, F.day(t) - 1))
        out = days.cast("bigint") * UNIT_US["d"] + F.pmod(us(t), F.lit(UNIT_US["d"]))
    fixed = sign * sum(r.get(u, 0) * n for u, n in UNIT_US.items())
    return from_us(out + fixed)


def add_ns(t, n) -> Column:
    """Stamp plus nanoseconds; digits below a microsecond are cut."""
    return from_us(us(t) + F.floor(as_col(n) / 1000))


def stamp_diff(a, b) -> Column:
    """a - b in nanoseconds."""
    return (us(a) - us(b)) * 1000


def compare(t, op: str, r: Relative | str) -> Column:
    """Comparison with a relative time: every named component must meet it by itself, so
    ``t < 2015y05m`` wants a year below 2015 and a month below 5."""
    fields = {"y": "year", "m": "month", "d": "day", "h": "hour", "i": "minute", "s": "second"}
    out = F.lit(True)
    for u, n in relative(r).named.items():
        f = field(fields[u], t)
        out = out & {"<": f < n, "<=": f <= n, ">": f > n, ">=": f >= n, "=": f == n, "!=": f != n}[op]
    return out


def bars(width, x) -> Column:
    """Numbers rounded down to multiples of ``width``."""
    w = as_col(width)
    return w * F.floor(as_col(x) / w)


def time_bars(width: Relative | str, t, origin: Column, first: bool = True) -> Column:
    """Stamps rounded down to bars of one unit.

    ``origin`` is a stamp: with ``first`` that of the table's first row, whose own and smaller units
    are zeroed (for seconds the start of its minute, ..., for days the first of its month); multiples
    of 7 days start ``weekday + 1`` days before that, Sunday being 0. Without ``first`` it is a
    reference of which only smaller units are zeroed. Months and years step by the calendar."""
    named = relative(width).named
    if len(named) != 1:
        raise ValueError("bars take a relative time of one unit")
    (u, n), = named.items()
    if n < 1:
        raise ValueError("a bar is at least one unit wide")
    t, origin = as_col(t), origin.cast("timestamp_ntz")
    if u in "ym":
        months = n * (12 if u == "y" else 1)
        zero = (F.lit(1970 * 12) if u == "y" else F.year(origin) * 12) if first else F.year(origin) * 12 + (F.month(origin) - 1 if u == "m" else 0)
        index = zero + months * F.floor((F.year(t) * 12 + F.month(t) - 1 - zero) / months)
        return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    start = F.date_trunc(UP[u] if first else OWN[u], origin)
    zero = us(start)
    if first and u == "d" and n % 7 == 0:
        zero = zero - (F.dayofweek(origin).cast("bigint")) * UNIT_US["d"]
    w = n * UNIT_US[u]
    return from_us(zero + F.lit(w) * F.floor((us(t) - zero) / w))


# formats

#: strftime codes and the date_format pattern of each.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "h": "MMM",
    "a": "EEE", "A": "EEEE", "q": "SSS", "Q": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}


def _pieces(fmt: str):
    for lit, code in re.findall(r"([^%]+)|%(.)", fmt):
        yield lit, code


def format_stamp(fmt: str, t) -> Column:
    """strftime with ``%q`` milli-, ``%Q`` micro- and ``%N`` nanoseconds; ``%j %u %w %U %W %e %n %t %%`` too."""
    t, out = as_col(t), []
    yday, wday = F.dayofyear(t), F.weekday(t)
    special = {
        "N": F.lpad((F.pmod(us(t), F.lit(1_000_000)) * 1000).cast("string"), 9, "0"), "j": F.lpad(yday.cast("string"), 3, "0"), "u": (wday + 1).cast("string"), "w": F.pmod(wday + 1, F.lit(7)).cast("string"),
        "U": F.lpad(F.floor((yday + 6 - F.pmod(wday + 1, F.lit(7))) / 7).cast("string"), 2, "0"), "W": F.lpad(F.floor((yday + 6 - wday) / 7).cast("string"), 2, "0"),
        "e": F.lpad(F.day(t).cast("string"), 2, " "), "n": F.lit("\n"), "t": F.lit("\t"), "%": F.lit("%"), "C": F.lpad(F.floor(F.year(t) / 100).cast("string"), 2, "0"),
    }
    for lit, code in _pieces(fmt):
        if lit:
            out.append(F.lit(lit))
        elif code in special:
            out.append(special[code])
        elif code in CODES:
            out.append(F.date_format(t, CODES[code]))
        else:
            raise ValueError(f"%{code} is not supported")
    return F.concat(*out) if out else F.lit("")


def java_pattern(fmt: str) -> str:
    out = ""
    for lit, code in _pieces(fmt):
        if lit:
            out += re.sub(r"[A-Za-z]+", r"'\g<0>'", lit.replace("'", "''"))
        elif code == "N":
            out += "SSSSSSSSS"
        elif code in CODES:
            out += CODES[code]
        else:
            raise ValueError(f"%{code} is not supported")
    return out


def parse_stamp(fmt: str, s) -> Column:
    """Strings in the format to stamps; null where they don't fit."""
    return F.try_to_timestamp(as_col(s), F.lit(java_pattern(fmt))).cast("timestamp_ntz")


def stamp(s) -> Column:
    """Strings in ISO notation to stamps; others give null."""
    return as_col(s).try_cast("timestamp_ntz")


def kind(t) -> Column:
    """How a stamp shows by default: ``time`` within the first day of 1970, ``date`` at midnight, else ``datetime``;
    null for null."""
    n = us(t)
    return F.when(n.isNull(), None).when((n >= 0) & (n < UNIT_US["d"]) & (n != 0), "time").when(F.pmod(n, F.lit(UNIT_US["d"])) == 0, "date").otherwise("datetime")


def now() -> Column:
    return F.localtimestamp()


def now_date() -> Column:
    return F.date_trunc("day", F.localtimestamp()).cast("timestamp_ntz")


def now_time() -> Column:
    return field("time", F.localtimestamp())
