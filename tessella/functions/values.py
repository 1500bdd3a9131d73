"""Nulls, types, maps and random values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.compare import as_col


def isnull(x, fill=None) -> Column:
    """Whether a value is null or NaN; with ``fill``, the value with those replaced."""
    c = as_col(x)
    some = F.nullif(c, F.lit(float("nan")))
    return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False)) if fill is None else F.coalesce(some, as_col(fill))


ifnull = isnull


def type_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def type_name(x) -> Column:
    return F.typeof(as_col(x))


# The numbers of the kinds of atoms (whole number, number, stamp), negative for lists of them;
# text is a list of characters, -1; then null, other lists, maps, tables.
ATOMS = {"bigint": 2, "int": 2, "smallint": 2, "tinyint": 2, "boolean": 2, "double": 3, "float": 3, "decimal": 3, "timestamp_ntz": 4, "timestamp": 4, "date": 4}
TEXT, NULL, LIST, MAP, TABLE = -1, 5, 6, 7, 10


def type_code(x) -> Column:
    """The number of a value's kind."""
    name = F.regexp_replace(F.typeof(as_col(x)), r"\([0-9,]*\)", "")
    inner = F.regexp_extract(name, r"^array<(.*)>$", 1)
    table = F.create_map(*[F.lit(y) for kv in ATOMS.items() for y in kv])
    atom_of = lambda c: F.try_element_at(table, c)
    return (F.when(name == "string", TEXT).when(name == "void", NULL).when(inner != "", F.coalesce(-atom_of(inner), F.lit(LIST)))
            .when(name.rlike("^(map|struct|variant)"), MAP).otherwise(atom_of(name)))


def atom(df: DataFrame, name: str) -> bool:
    """Whether a column holds single values rather than lists."""
    return df.schema[name].dataType.typeName() not in ("array", "map", "struct")


def map_(keys, vals) -> Column:
    return F.map_from_arrays(as_col(keys), as_col(vals))


def keys(m) -> Column:
    return F.map_keys(as_col(m))


def vals(m) -> Column:
    return F.map_values(as_col(m))


def has_key(m, k) -> Column:
    return F.map_contains_key(as_col(m), k)


def delete_keys(m, ks: list) -> Column:
    return F.map_filter(as_col(m), lambda k, _: ~k.isin(ks))


def ascend_keys(m) -> Column:
    """Keys by ascending value."""
    return F.transform(F.sort_array(F.transform(F.map_entries(as_col(m)), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), lambda e: e["k"])


def rand(n=None, seed: int | None = None) -> Column:
    """A uniform number in [0, n), whole if n is; in [0, 1) without n. The stream differs between plans."""
    r = F.rand(seed) if seed is not None else F.rand()
    return r if n is None else F.floor(r * n) if isinstance(n, int) else r * n


def pick(arr, seed: int | None = None) -> Column:
    """A random element."""
    a = as_col(arr)
    return F.get(a, F.floor((F.rand(seed) if seed is not None else F.rand()) * F.size(a)).cast("int"))


def identity(x) -> Column:
    return as_col(x)


def right(_, x) -> Column:
    return as_col(x)
