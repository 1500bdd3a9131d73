"""Schemaless records: a table of one VARIANT column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def atlas(df: DataFrame, json: str, keep: list[str] | None = None, name: str = "v") -> DataFrame:
    """Records parsed from a JSON column; malformed and null text gives null."""
    return df.select(*(keep or []), F.try_parse_json(json).alias(name))


def key(path: str, kind: str = "string", name: str = "v") -> Column:
    """The value at a nested key such as ``b.d``; null where it is missing or of another type."""
    return F.try_variant_get(F.col(name), "$." + path, kind)


def keys(df: DataFrame, name: str = "v") -> DataFrame:
    """The records' top-level keys and how many records have each."""
    as_map = F.from_json(F.to_json(F.col(name)), "map<string,string>")
    return df.select(F.explode(F.map_keys(as_map)).alias("key")).groupBy("key").count()


def schema(df: DataFrame, name: str = "v") -> str:
    """The records' common schema."""
    return df.agg(F.schema_of_variant_agg(name)).first()[0]
