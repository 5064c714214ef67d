"""Queries by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Survey rows that each query stands for.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name."""
    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not matter."""
    from pyspark.sql import functions as F

    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
