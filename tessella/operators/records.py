"""Delimited records that may not parse: minimum-cost error parse.

A record is a word over delimiters, quotes, backslashes, line feeds and ordinary characters. A
dynamic program over the states of the record grammar (field number, and start of field, unquoted,
quoted, escaped, after a closing quote) finds the cheapest parse into the wanted number of fields,
where inserting or deleting a quote or a delimiter costs one. Cost 0 means the record is well
formed; otherwise the edits say what is wrong. Runs of ordinary characters are equivalent to one,
so a record is reduced to its shape, and each distinct shape is solved once, all shapes of a batch
together. Typed checks then run as column expressions.

Everything is map-only, whatever the share of one file; rows are moved only where there are fewer
input partitions than cores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.schema import sanitise
from tessella.session import spread

TITLES = ("open", "close", "high", "low", "volume", "astring", "en,umstring", "datetime")
CODES = "FFFFIEEZ"

NUMBER = r"\A[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DIGITS = r"\A[+-]?[0-9]+\z"
#: A real date and time: months by their length, February 29 in leap years only, no year 0000.
STAMP = (
    r"\A(?!0000)(?:[0-9]{4}\.(?:(?:0[13578]|1[02])\.(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)\.(?:0[1-9]|[12][0-9]|30)|02\.(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)\.02\.29)"
    r"T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]")

START, PLAIN, QUOTED, ESCAPED, CLOSED = range(5)
EDITS = ("insert quote", "delete quote", "insert delimiter", "delete delimiter")


def counter_bits(length: int, fields: int) -> int:
    """Bits that hold any count of edits in the cheapest parse of so many symbols."""
    return (length + 2 * fields).bit_length() + 1


def solve(shapes: Sequence[str], fields: int) -> list[int]:
    """The least weight for each shape over ``o`` (ordinary), ``d`` (delimiter), ``q`` (quote), ``b``
    (backslash) and ``n`` (line feed). A weight has the cost above four counters, one for each kind
    of edit, of ``counter_bits`` each, so that the counts are exact at any length: in 64 bits for
    usual records, in Python's whole numbers for those too long for that."""
    n, length = len(shapes), max(map(len, shapes), default=0)
    bits = counter_bits(length, fields)
    iq, dq, idl, dd = [(1 << 4 * bits) + (1 << bits * i) for i in range(4)]
    wide = 5 * bits > 61
    inf = 1 << 5 * bits if wide else np.int64(1 << 62)
    text = np.full((n, length), "", "<U1")
    for i, s in enumerate(shapes):
        text[i, :len(s)] = list(s)
    c = np.full((5, fields, n), inf, object if wide else np.int64)
    c[START, 0] = 0

    def insert() -> None:
        for f in range(fields):
            c[QUOTED, f] = np.minimum(np.minimum(c[QUOTED, f], c[START, f] + iq), c[ESCAPED, f] + iq)
            c[CLOSED, f] = np.minimum(c[CLOSED, f], c[QUOTED, f] + iq)
            if f + 1 < fields:
                c[START, f + 1] = np.minimum(c[START, f + 1], np.minimum(np.minimum(c[START, f], c[PLAIN, f]), c[CLOSED, f]) + idl)
        np.minimum(c, inf, out=c)

    def read(symbol: str) -> np.ndarray:
        new = np.full_like(c, inf)
        new[QUOTED] = np.minimum(c[QUOTED], c[ESCAPED])
        if symbol in "ob":
            new[PLAIN] = np.minimum(c[START], c[PLAIN])
        if symbol == "b":
            new[QUOTED], new[ESCAPED] = c[ESCAPED], c[QUOTED]
        elif symbol == "d":
            new[START, 1:] = np.minimum(np.minimum(c[START, :-1], c[PLAIN, :-1]), c[CLOSED, :-1])
            for s in (START, PLAIN, CLOSED):
                new[s] = np.minimum(new[s], c[s] + dd)
        elif symbol == "q":
            new[QUOTED] = np.minimum(np.minimum(c[START], c[CLOSED]), np.minimum(c[ESCAPED], c[QUOTED] + dq))
            new[CLOSED] = np.minimum(c[QUOTED], c[CLOSED] + dq)
            new[PLAIN], new[START] = c[PLAIN] + dq, c[START] + dq
        return new

    for i in range(length):
        insert()
        col, old = text[:, i], c.copy()
        for symbol in "odqbn":
            mine = col == symbol
            if mine.any():
                c = old[:, :, mine]
                part = read(symbol)
                old[:, :, mine] = np.minimum(part, inf)
        c = old
    insert()
    return [int(w) for w in c[[START, PLAIN, CLOSED], fields - 1].min(0)]


def describe(weight: int, bits: int) -> tuple[int, str | None]:
    """Cost and wording of a weight."""
    if not weight:
        return 0, None
    return weight >> 4 * bits, ", ".join(f"{e} x{n}" for i, e in enumerate(EDITS) if (n := weight >> bits * i & (1 << bits) - 1))


class _Classes(dict):
    """Character to symbol; anything not named is ordinary."""

    def __missing__(self, key: int) -> str:
        self[key] = "o"
        return "o"


class Parser:
    """Parses records of ``fields`` fields; shapes solved before are remembered up to a bound."""

    def __init__(self, fields: int, remember: int = 100_000):
        self.fields, self.remember, self.known, self.tables = fields, remember, {}, {}

    def table(self, delim: str) -> tuple:
        if delim not in self.tables:
            classes = _Classes({ord('"'): "q", ord("\\"): "b", ord("\n"): "n", ord(delim): "d"})
            d = re.escape(delim)
            self.tables[delim] = classes, re.compile(rf'"((?:[^"\\]|""|\\.)*)"|([^{d}"\n]*)', re.S)
        return self.tables[delim]

    def split(self, line: str, delim: str) -> list[str]:
        """Fields of a well-formed record."""
        if '"' not in line:
            return line.split(delim)
        out, at, field = [], 0, self.table(delim)[1]
        while True:
            m = field.match(line, at)
            q = m.group(1)
            out.append(m.group(2) if q is None else re.sub(r'""|\\(.)', lambda x: x.group(1) or '"', q, flags=re.S) if '"' in q or "\\" in q else q)
            at = m.end() + 1
            if at > len(line):
                return out

    def __call__(self, lines: Sequence[str | None], delims: Sequence[str | None]) -> Iterator[tuple]:
        """``(cost, edits, fields)`` for each record; cost null for a blank line, -1 where the delimiter is unusable."""
        shapes: list[str | None] = []
        for line, delim in zip(lines, delims):
            usable = delim is not None and len(delim) == 1 and delim not in '"\\\n\r'
            shapes.append(re.sub("oo+", "o", line.translate(self.table(delim)[0])) if line is not None and usable else None)
        new = list({s for s in shapes if s is not None and s not in self.known})
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = list({s for s in shapes if s is not None})
        new.sort(key=len)
        while new:  # chunks of similar length, at most about a million cells wide
            k = max(1, min(len(new), 2_000_000 // (40 + len(new[0]))))
            while k > 1 and len(new[k - 1]) > 2 * len(new[0]) + 64:
                k //= 2
            chunk, new = new[:k], new[k:]
            bits = counter_bits(len(chunk[-1]), self.fields)
            for s, w in zip(chunk, solve(chunk, self.fields)):
                self.known[s] = describe(w, bits)
        for line, delim, s in zip(lines, delims, shapes):
            if line is None or not line.strip():
                yield None, None, None
            elif s is None:
                yield -1, "unusable delimiter", None
            else:
                cost, edits = self.known[s]
                yield cost, edits, self.split(line, delim) if cost == 0 else None


def parse(line: Column, delim: Column, fields: int) -> Column:
    """``struct(cost, edits, fields)`` of each record; a carriage return at the end doesn't count."""
    kind = T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("edits", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))])
    held: list[Parser] = []

    @F.pandas_udf(kind)
    def run(lines: pd.Series, delims: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Parser(fields))
        text = [None if x is None else x[:-1] if x.endswith("\r") else x for x in lines]
        out = pd.DataFrame(list(held[0](text, list(delims))), columns=["cost", "edits", "fields"])
        out["cost"] = out["cost"].astype("Int32")
        return out

    return run(line, delim)


def is_stamp(c: Column, fraction: str = r"\.[0-9]{3}") -> Column:
    """A real date and time in ``%Y.%m.%dT%H:%M:%S`` with the fraction that the pattern demands."""
    return F.coalesce(c.rlike(STAMP + fraction + r"\z"), F.lit(False))


def to_stamp(c: Column) -> Column:
    """The value of a field that ``is_stamp`` accepts; null elsewhere."""
    part = lambda a, n: F.substring(c, a, n)
    sec = F.concat(part(18, 2), F.when(F.length(c) > 19, part(20, 7)).otherwise(F.lit(""))).try_cast("decimal(8,6)")
    return F.try_make_timestamp_ntz(part(1, 4).try_cast("int"), part(6, 2).try_cast("int"), part(9, 2).try_cast("int"), part(12, 2).try_cast("int"), part(15, 2).try_cast("int"), sec)


def check(code: str, c: Column) -> tuple[Column, Column]:
    """Whether a non-empty field is valid for the type code, and its value."""
    if code == "F":
        return c.rlike(NUMBER), c.try_cast("double")
    if code == "I":
        return c.rlike(DIGITS) & c.try_cast("bigint").isNotNull(), c.try_cast("bigint")
    if code == "Z":
        return is_stamp(c), to_stamp(c)
    if code in "SE":
        return F.lit(True), c
    raise ValueError(f"type code {code!r} is not supported here")


def parsed_lines(df: DataFrame, titles: Sequence[str] = TITLES, type_codes: str = CODES, line: str = "line", delim: str = "delim", line_no: str = "line_no", header_rows: int = 1) -> DataFrame:
    """``df``'s raw records with the columns ``cost``, ``edits``, ``reason`` and ``record`` (a struct of
    typed fields), without headers (``line_no`` up to ``header_rows``; a null one is no header) and blank lines (empty, white
    space or null). ``reason`` is null for a record that loads: the right number of fields, quotes
    that enclose whole fields, every non-empty field valid for its type code (``F`` number, ``I``
    64-bit integer, ``S``/``E`` string, ``Z`` stamp). Empty fields are null, in string columns empty.
    Columns of ``df`` with those four names are dropped, others kept; a record without usable
    delimiter fails. Empty input gives no rows."""
    names = sanitise(titles)
    p = parse(F.col(line), F.col(delim), len(names))
    kept = spread(df.filter(F.coalesce(F.col(line_no) > header_rows, F.lit(True)) & F.col(line).isNotNull()).drop("cost", "edits", "reason", "record", "_p"))
    out = kept.withColumn("_p", p).filter(F.col("_p.cost").isNotNull())
    wrong, typed = [], []
    for i, (name, code) in enumerate(zip(names, type_codes)):
        f = F.get(F.col("_p.fields"), F.lit(i))
        ok, value = check(code, f)
        wrong.append(F.when((f != "") & ~ok, F.lit(f"{name} is not valid for {code}")))
        typed.append((value if code in "SE" else F.when((f != "") & ok, value)).alias(name))
    values = F.concat_ws("; ", *wrong)
    reason = F.when(F.col("_p.cost") != 0, F.col("_p.edits")).when(values != "", values)
    return out.select(*kept.columns, F.col("_p.cost").alias("cost"), F.col("_p.edits").alias("edits"), reason.alias("reason"), F.struct(*typed).alias("record"))


def parsed_stamps(df: DataFrame, fields: Sequence[tuple[str, int]] = (("brokenmillis", 3), ("brokennanos", 9))) -> DataFrame:
    """``df``'s rows with ``reason`` and ``record``: each named string column holds a stamp with no
    fraction or one of exactly so many digits; null and empty values are null. ``record`` has the
    stamp (microseconds; digits beyond are cut) and ``<name>_ns``, the nanoseconds of its second."""
    wrong, typed = [], []
    for name, digits in fields:
        c = F.col(name)
        ok = is_stamp(c, rf"(\.[0-9]{{{digits}}})?")
        there = c.isNotNull() & (c != "")
        wrong.append(F.when(there & ~ok, F.lit(f"{name} is not a stamp with {digits} or no fraction digits")))
        typed += [F.when(there & ok, to_stamp(c)).alias(name), F.when(there & ok, F.rpad(F.substring(c, 21, 9), 9, "0").cast("bigint")).alias(f"{name}_ns")]
    values = F.concat_ws("; ", *wrong)
    kept = df.drop("reason", "record")
    return kept.withColumn("reason", F.when(values != "", values)).withColumn("record", F.struct(*typed))


def rejected(parsed: DataFrame) -> DataFrame:
    """The rows that can't be loaded, with the reason."""
    return parsed.filter(F.col("reason").isNotNull())


def loaded(parsed: DataFrame) -> DataFrame:
    """The other rows: all columns but raw text and parse results, then the typed fields. A typed
    field replaces a column of its name."""
    names = parsed.schema["record"].dataType.names
    gone = {"cost", "edits", "reason", "record", "line", "delim", *names}
    return parsed.filter(F.col("reason").isNull()).select(*[c for c in parsed.columns if c not in gone], "record.*")
