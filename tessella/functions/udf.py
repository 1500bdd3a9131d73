"""User functions: over vectors, groups and tables, always in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(f: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A function of whole column vectors as a column function."""

    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    run.__annotations__ = {}
    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)


def aggregate(f: Callable[..., object], kind: str) -> Callable[..., Column]:
    """A function from column vectors to one value as an aggregate; a group's rows meet in one task, so
    groups should be bounded."""

    def run(*columns):
        return f(*columns)

    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def table_function(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function from a group's table to a table."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def parallel(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of any piece of the table, run on all cores."""
    return df.mapInPandas(lambda parts: (f(p) for p in parts), schema)


def fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """``step`` applied until the table no longer changes; each round is stored, so plans don't grow."""
    from tessella.operators.tables import same_table
    from tessella.session import durable

    now = durable(df)
    for _ in range(most):
        new = durable(step(now))
        if same_table(now, new):
            return new
        now = new
    raise RuntimeError(f"no fixpoint in {most} rounds")
