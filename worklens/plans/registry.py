"""Pairs of a query over the sample tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from worklens.functions.params import DEFAULT
from worklens.sources.bind import Tables, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The fixed instant in SQL.
NOW = f"TIMESTAMP '{DEFAULT.as_of}'"


def days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"


def floor_days(a: str, b: str) -> str:
    return f"CAST(floor({days(a, b)}) AS BIGINT)"


def query(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None, **ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_views(sql, **ctes)
