"""Delimited and fixed-width files by type code, and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.times import parse_stamp
from tessella.operators.records import parse
from tessella.schema import SKIP, sanitise, type_of, uncollide

STAMP = "%Y.%m.%dT%H:%M:%S.%q"
FRACTION = {"%q": 3, "%Q": 6, "%N": 9}


def convert(code: str, c: Column, stamp: str = STAMP, time: str = "%H:%M:%S") -> Column:
    """The value of a field by its type code. Numbers are read as far as they go, and empty or
    unreadable ones are 0; a stamp whose fraction hasn't the digits of the format loses it; an
    unreadable stamp is null."""
    upper = code.upper()
    kind = type_of(code)
    name = kind.simpleString()
    if upper in "IW421":
        return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0)).cast(name)
    if upper in "FV0D":
        number = F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
        if upper == "D":  # four decimals, the rest is cut
            d = number.try_cast("decimal(38,18)")
            return F.coalesce((F.signum(d) * F.floor(F.abs(d) * 10_000) / 10_000).cast(name), F.lit(0).cast(name))
        return F.coalesce(number.try_cast("double"), F.lit(0.0)).cast(name)
    if upper == "A":
        return F.timestamp_micros(F.floor(c.try_cast("bigint") / 1000)).cast("timestamp_ntz")
    if upper in "ZY9":
        fmt = time if upper == "Y" else stamp
        tail = fmt[-2:]
        if tail in FRACTION and fmt[-3:-2] == ".":
            whole = parse_stamp(fmt[:-3], F.regexp_extract(c, r"^(.*?)(\.[^.]*)?$", 1) if "." not in fmt[:-3] else F.regexp_replace(c, r"(:\d\d)\.[^.]*$", "$1"))
            digits = F.regexp_extract(c, rf":\d\d\.([0-9]{{{FRACTION[tail]}}})$", 1)
            us = F.when(digits != "", F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint")).otherwise(F.lit(0))
            return F.timestamp_micros(F.unix_micros(whole.cast("timestamp")) + us).cast("timestamp_ntz")
        return parse_stamp(fmt, c)
    if upper == "3":
        return F.substring(c, 1, 32)
    if upper == "R":  # a symbol of 6 characters and a suffix of 10
        return F.concat_ws(".", F.nullif(F.trim(F.substring(c, 1, 6)), F.lit("")), F.nullif(F.trim(F.substring(c, 7, 10)), F.lit("")))
    if upper == "Q":  # HHMMSSmmm as milliseconds of the day
        part = lambda a, n: F.substring(c, a, n).try_cast("bigint")
        return ((part(1, 2) * 60 + part(3, 2)) * 60 + part(5, 2)) * 1000 + part(7, 3)
    return c


def body(spark: SparkSession, path: str, header_rows: int, quoted_line_feeds: bool = False) -> DataFrame:
    """The non-blank lines (``value``) of a file, or folder of files, without the first ``header_rows``
    non-blank ones of each file, which are told by their place, never by their text.

    Each file is cut into lines by Spark, so a large file is read by many tasks. One header row is
    left out by the reader itself; for more, the lines of a file's first split are counted as they
    pass. The header must lie within that split, else reading fails."""
    if quoted_line_feeds:
        return _joined(spark, path, header_rows)
    if header_rows == 1:
        # a reader of one column: U+0001 can't stand in text, and would fail rather than cut a line
        got = spark.read.schema("value string").options(header=True, sep="\u0001", quote="", mode="FAILFAST", enforceSchema=True).csv(path)
    else:
        got = spark.read.text(path)
    if header_rows > 1:
        m = F.col("_metadata")
        whole = m["file_block_start"] + m["file_block_length"] >= m["file_size"]
        placed = got.select("value", m["file_path"].alias("file"), (m["file_block_start"] == 0).alias("first"), whole.alias("whole"))
        got = placed.mapInArrow(_without_header(header_rows), "value string")
    return got.filter(_blank("value") == F.lit(False))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, "\r$", "")) == "", F.lit(True))


def _without_header(rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, short = {}, set()
        for b in batches:
            value, first = b.column("value"), b.column("first").to_numpy(zero_copy_only=False)
            keep = np.ones(b.num_rows, bool)
            for i in np.flatnonzero(first):
                name = b.column("file")[i].as_py()
                if seen.get(name, 0) >= rows:
                    continue
                keep[i] = False
                if (value[i].as_py() or "").strip():
                    seen[name] = seen.get(name, 0) + 1
                if seen.get(name, 0) >= rows:
                    short.discard(name)
                elif not b.column("whole")[i].as_py():
                    short.add(name)
            yield pa.RecordBatch.from_arrays([value.filter(pa.array(keep))], ["value"])
        if short:
            raise ValueError(f"the header of {sorted(short)[0]} goes beyond its first split")

    return run


def _joined(spark: SparkSession, path: str, header_rows: int) -> DataFrame:
    """Records in which quoted fields may hold line feeds: a line is part of the record before it if the
    number of quotes in its file so far is odd (a quote after a backslash doesn't count). That
    number is summed per split, then over the splits (one row each), then within a split, so that
    a file of any size is spread over its splits; lines of one record meet by the place where it
    starts."""
    m = F.col("_metadata")
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("split"), at.alias("at"))
    plain = F.regexp_replace("value", r"\\.", "")
    lines = lines.withColumn("odd", F.pmod(F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))), F.lit(2)))
    over = W.partitionBy("file").orderBy("split")
    sums = lines.groupBy("file", "split").agg(F.sum("odd").alias("n"))
    before = sums.select("file", "split", (F.sum("n").over(over) - F.col("n")).alias("before"))
    inside = W.partitionBy("file", "split").orderBy("at")
    placed = lines.join(before, ["file", "split"]).withColumn("open", F.pmod(F.col("before") + F.sum("odd").over(inside) - F.col("odd"), F.lit(2)) == 1)
    # where a record starts: in this split, else at the last start of an earlier one
    start = F.struct("split", "at")
    last = placed.groupBy("file", "split").agg(F.max(F.when(~F.col("open"), start)).alias("last"))
    carried = last.select("file", "split", F.last("last", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    own = F.max(F.when(~F.col("open"), start)).over(inside.rowsBetween(W.unboundedPreceding, 0))
    keyed = placed.withColumn("own", own).join(carried, ["file", "split"]).withColumn("start", F.coalesce("own", "carried", start))
    parts = F.sort_array(F.collect_list(F.struct("split", "at", F.coalesce("value", F.lit("")).alias("value"))))
    records = keyed.groupBy("file", "start").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
    records = records.filter(~_blank("value"))
    if header_rows:
        n = F.row_number().over(W.partitionBy("file", F.col("start.split")).orderBy("start.at"))
        records = records.withColumn("n", n).filter((F.col("start.split") > 0) | (F.col("n") > header_rows))
    return records.select("value")


def read_delimited(spark: SparkSession, path: str, delim: str, codes: str, header_rows: int = 1, titles: Sequence[str] | None = None, stamp: str = STAMP, quoted_line_feeds: bool = False) -> DataFrame:
    """A file, or folder of files, as a table typed by ``codes`` (one per column; ``*`` skips one).

    Names come from ``titles``, else the first header row of the file that comes first by name, else
    ``col``, ``col1``, ...; the first ``header_rows`` non-blank lines of *each* file are its header,
    whatever stands in them; blank lines are skipped; quotes may enclose a field, with doubled quotes
    or backslashes inside; columns beyond the codes are ignored. A record with too few fields, or
    with quotes that don't close, is an error when it is read: use ``operators.records`` where some
    records may be broken. ``quoted_line_feeds`` lets quoted fields hold line feeds, at the price of
    a shuffle."""
    if titles is None and header_rows:
        from tessella.operators.records import Parser

        files = sorted(spark.read.text(path).inputFiles())
        head = spark.read.text(files[0]).filter(~_blank("value")).limit(1).collect() if files else []
        titles = Parser(1).split(head[0][0].rstrip("\r"), delim) if head else []
    wanted = [i for i, c in enumerate(codes) if c not in SKIP]
    names = sanitise([*titles, *[""] * len(codes)][:len(codes)]) if titles else uncollide([""] * len(codes))
    text = F.regexp_replace("value", "\r$", "")
    fields = F.when(~text.contains('"'), F.split(text, r"\Q" + delim + r"\E", -1)).otherwise(_quoted_fields(text, delim))
    cut = body(spark, path, header_rows, quoted_line_feeds).select(fields.alias("f"))
    ok = F.when(F.size("f") < len(codes), F.raise_error(F.concat(F.lit("too few fields: "), F.to_json("f")))).otherwise(F.col("f"))
    cut = cut.select(ok.alias("f"))
    return cut.select(*[convert(codes[i], F.get(F.col("f"), F.lit(i)), stamp).alias(names[i]) for i in wanted])


def _quoted_fields(text: Column, delim: str) -> Column:
    d = r"\Q" + delim + r"\E"
    pattern = rf'(?s)(?:^|{d})("(?:[^"\\]|""|\\.)*+"|(?:(?!{d})[^"])*+)'
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda f: F.when(f.startswith('"'), F.regexp_replace(F.substring(f, F.lit(2), F.length(f) - 2), r'(?s)"(")|\\(.)', "$1$2")).otherwise(f))


def read_csv(spark: SparkSession, path: str, codes: str, header_rows: int = 1, **more) -> DataFrame:
    return read_delimited(spark, path, ",", codes, header_rows, **more)


def read_tsv(spark: SparkSession, path: str, codes: str, header_rows: int = 1, **more) -> DataFrame:
    return read_delimited(spark, path, "\t", codes, header_rows, **more)


def read_psv(spark: SparkSession, path: str, codes: str, header_rows: int = 1, **more) -> DataFrame:
    return read_delimited(spark, path, "|", codes, header_rows, **more)


def read_fixed(spark: SparkSession, path: str, fields: str, widths: Sequence[int], titles: Sequence[str] | None = None, header_rows: int = 0, line_limit: int | None = None, newline_separated: bool = True, stamp: str = STAMP, time: str = "%H:%M:%S") -> DataFrame:
    """A fixed-width file, or folder of files, as a table typed by ``fields``, with surrounding blanks
    trimmed. The first ``header_rows`` lines of each file are left out by their place. Without
    newlines a file is cut into records of as many bytes as the widths' sum, by many tasks; one
    whose length is no multiple of that is an error. ``line_limit`` keeps so many lines, for a look
    at a file."""
    if newline_separated:
        lines = body(spark, path, header_rows)
    else:
        lines = _fixed_records(spark, path, sum(widths), header_rows)
    if line_limit is not None:
        lines = lines.limit(line_limit)
    names = sanitise(titles) if titles else uncollide([""] * len(fields))
    cols, at = [], 1
    for code, width, name in zip(fields, widths, names):
        if code not in SKIP:
            raw = F.substring("value", at, width)
            cols.append(convert(code, raw if code in "RrQq" else F.trim(raw), stamp, time).alias(name))
        at += width
    return lines.select(*cols)


def _fixed_records(spark: SparkSession, path: str, size: int, header_rows: int) -> DataFrame:
    """Records of ``size`` bytes. Hadoop's reader gives each record with its offset in its file."""
    got = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(size), "mapreduce.input.fileinputformat.input.dir.recursive": "true"})
    body_ = got.filter(lambda r: r[0] >= header_rows * size).map(lambda r: (bytes(r[1]).decode("utf-8", "replace"),))
    return spark.createDataFrame(body_, "value string")


def write_delimited(df: DataFrame, path: str, delim: str = ",", order: Sequence[str] = (), single: bool = False) -> None:
    """Header and rows; a field is quoted only where it has to be, quotes inside are doubled. ``single``
    gives one file (for small tables); otherwise each task writes its own."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("sep", delim).option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy.MM.dd'T'HH:mm:ss.SSS").option("emptyValue", "").csv(path)


def stored(spark: SparkSession, target: str, source: DataFrame, append: bool = False) -> DataFrame:
    """A table read from files, stored column-wise at ``target``, over or after what is there."""
    source.write.mode("append" if append else "overwrite").parquet(target)
    return spark.read.parquet(target)


def create_table(spark: SparkSession, target: str, path: str, delim: str, codes: str, header_rows: int = 1, **more) -> DataFrame:
    return stored(spark, target, read_delimited(spark, path, delim, codes, header_rows, **more))


def append_table(spark: SparkSession, target: str, path: str, delim: str, codes: str, header_rows: int = 1, **more) -> DataFrame:
    return stored(spark, target, read_delimited(spark, path, delim, codes, header_rows, **more), append=True)


def create_table_fixed(spark: SparkSession, target: str, path: str, spec: Mapping) -> DataFrame:
    return stored(spark, target, read_fixed(spark, path, **spec))


def append_table_fixed(spark: SparkSession, target: str, path: str, spec: Mapping) -> DataFrame:
    return stored(spark, target, read_fixed(spark, path, **spec), append=True)
