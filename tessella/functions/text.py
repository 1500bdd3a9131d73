"""Strings, parsing, formatting and JSON."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compare import as_col


def tolower(s) -> Column:
    return F.lower(as_col(s))


def toupper(s) -> Column:
    return F.upper(as_col(s))


def trim(s) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(as_col(s), r"^\s+|\s+$", "")


def _quoted(c: str) -> str:
    return r"\Q" + c.replace(r"\E", r"\E\\E\Q") + r"\E"


def explode(sep: str, s) -> Column:
    """The string cut at each separator."""
    return F.split(as_col(s), _quoted(sep), -1)


def implode(sep: str, arr) -> Column:
    return F.array_join(as_col(arr), sep)


def split_at(cuts: list[int], s) -> Column:
    """The string cut before each of the given positions."""
    s = as_col(s)
    ends = [*cuts, None]
    return F.array(*[F.substring(s, a + 1, 2**31 - 1 if e is None else max(e - a, 0)) for a, e in zip([0, *cuts], ends)])


def ngram(n: int, s) -> Column:
    """Chunks of n characters; the last may be shorter."""
    return F.regexp_extract_all(as_col(s), F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))


def search(sub, s) -> Column:
    """0-based position of a substring; null if it isn't there."""
    return F.nullif(F.locate(sub, as_col(s)), F.lit(0)) - 1 if isinstance(sub, str) else F.nullif(F.position(as_col(sub), as_col(s)), F.lit(0)) - 1


def format_(pattern: str, *values) -> Column:
    """printf with ``%s %d %f %%``, widths and precisions; ``%.3d`` pads with zeros to three digits."""
    out, i = [], 0
    for lit, spec in re.findall(r"((?:[^%]|%%)+)|(%[-+ 0]*\d*(?:\.\d+)?[sdf])", pattern):
        if lit:
            out.append(F.lit(lit.replace("%%", "%")))
            continue
        v = as_col(values[i])
        i += 1
        digits = re.fullmatch(r"%([-+ 0]*)(\d*)\.(\d+)d", spec)
        if digits:
            n = v.cast("bigint")
            text = F.concat(F.when(n < 0, "-").otherwise(""), F.lpad(F.abs(n).cast("string"), F.greatest(F.length(F.abs(n).cast("string")), F.lit(int(digits[3]))), F.lit("0")))
            out.append(F.format_string(f"%{digits[1].replace('0', '')}{digits[2]}s", text) if digits[2] else text)
        else:
            out.append(F.format_string(spec, v.cast({"d": "bigint", "f": "double", "s": "string"}[spec[-1]])))
    return F.concat(*out) if out else F.lit("")


def parse_int(s, radix: int = 10) -> Column:
    """The integer that the longest valid prefix denotes; 0 without one, null for null."""
    digits = "0-" + str(min(radix, 10) - 1) if radix <= 10 else "0-9a-" + chr(86 + radix) + "A-" + chr(54 + radix)
    s = as_col(s)
    head = F.regexp_extract(s, rf"^\s*([+-]?[{digits}]+)", 1)
    body = F.regexp_replace(head, r"^\+", "")
    value = body.try_cast("bigint") if radix == 10 else F.conv(F.regexp_replace(body, "^-", ""), radix, 10).try_cast("bigint") * F.when(body.startswith("-"), -1).otherwise(1)
    return F.when(s.isNotNull(), F.coalesce(F.when(head != "", value), F.when(head == "", F.lit(0).cast("bigint"))))


def parse_float(s) -> Column:
    """The number that the longest valid prefix denotes; NaN without one, null for null."""
    s = as_col(s)
    head = F.regexp_extract(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(s.isNotNull(), F.coalesce(F.when(head != "", head.try_cast("double")), F.lit(float("nan"))))


def int_(x, kind: str = "double") -> Column:
    """Integer by truncation; of a string (``kind="string"``) the character codes."""
    x = as_col(x)
    if kind == "string":
        return F.when(x == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(x, ""), lambda c: F.ascii(c)))
    return x.cast("bigint")


def float_(x) -> Column:
    return as_col(x).try_cast("double")


def char(codes) -> Column:
    """The string of an array of character codes."""
    return F.array_join(F.transform(as_col(codes), lambda c: F.char(c)), "")


def string(x) -> Column:
    return as_col(x).cast("string")


def from_json(s, schema: str | None = None) -> Column:
    """Of a known schema, else a VARIANT; malformed text gives null."""
    return F.from_json(as_col(s), schema) if schema else F.try_parse_json(as_col(s))


def to_json(x, mark: str | None = None) -> Column:
    """JSON of a struct, map or list. With ``mark``, which has letters and ``_`` only, stamps have it before
    their text, so that a reader that knows it can tell them from strings."""
    c = as_col(x)
    if mark is None:
        return F.to_json(c)
    if not re.fullmatch("[A-Za-z_]+", mark):
        raise ValueError("a mark has letters and _ only")
    shape = f"'{mark}'yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(c, {"timestampNTZFormat": shape, "timestampFormat": shape})


def stamp_of(s, mark: str) -> Column:
    """The stamp of a JSON text with the mark; others give null."""
    s = as_col(s)
    return F.when(s.startswith(mark), F.substring(s, len(mark) + 1, 2**31 - 1).try_cast("timestamp_ntz"))


uneval = rep = to_json


def checksum(*xs) -> Column:
    """64-bit hash; equal for equal values."""
    return F.xxhash64(*map(as_col, xs))


def zip_text(x) -> Column:
    """The value's JSON, compressed, in base 64."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else zlib.compress(t.encode()))

    return F.base64(run(as_col(x).cast("string")))


def unzip_text(x) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else zlib.decompress(bytes(b)).decode())

    return run(F.unbase64(as_col(x)))
