"""Types, type codes, column names and null rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type codes of delimited and fixed-width files, and the type each loads as.
TYPE_CODES = {
    "I": T.LongType(), "F": T.DoubleType(), "S": T.StringType(), "E": T.StringType(), "G": T.StringType(), "N": T.StringType(),
    "A": T.TimestampNTZType(), "Z": T.TimestampNTZType(), "Y": T.TimestampNTZType(), "9": T.TimestampNTZType(),
    "W": T.LongType(), "4": T.IntegerType(), "2": T.ShortType(), "1": T.ByteType(), "V": T.DoubleType(), "0": T.FloatType(),
    "D": T.DecimalType(18, 4), "3": T.StringType(), "R": T.StringType(), "Q": T.LongType(),
}
SKIP = "* "


def type_of(code: str) -> T.DataType | None:
    """The type of a code; null for a column to skip. Lower case asks for an index, which storage
    statistics replace, and gives the same type."""
    if code in SKIP:
        return None
    try:
        return TYPE_CODES[code.upper()]
    except KeyError:
        raise ValueError(f"unknown type code {code!r}") from None


def uncollide(names: Sequence[str]) -> list[str]:
    """Names made unique: the second ``a`` becomes ``a1``, the third ``a2``. An empty name becomes ``col``."""
    out: list[str] = []
    for name in names:
        name = name or "col"
        new, i = name, 0
        while new in out:
            i += 1
            new = f"{name}{i}"
        out.append(new)
    return out


def sanitise(titles: Sequence[str]) -> list[str]:
    """Column names of file titles: other characters than letters, digits and ``_`` become ``_``, a
    leading digit gets one before it."""
    return uncollide([re.sub(r"^(?=[0-9])", "_", re.sub(r"[^A-Za-z0-9_]", "_", t)) for t in titles])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns, as aggregates and comparisons expect."""
    kinds = {"double", "float"}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def meta_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """``(name, type, sorted, on_disk)`` of each column: whether it leads the order the plan knows of, and
    whether the table reads stored files (``path``, if that is what is asked of)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    order = plan.outputOrdering()
    first = order.apply(0).child().toString().split("#")[0] if order.size() else None
    disk = bool(path) or bool(df.inputFiles())
    return df.sparkSession.createDataFrame([(c, t, c == first, disk) for c, t in df.dtypes], "name string, type string, sorted boolean, on_disk boolean")
