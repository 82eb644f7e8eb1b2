"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.checks.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of the fixtures as query ``name``, with its SQL if it has one."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def text(c: str | Column, name: str | None = None) -> Column:
    """A flag, a list or a nullable number as text, which both engines spell alike."""
    column = F.col(c) if isinstance(c, str) else c
    out = column.cast("string")
    return out.alias(name or (c if isinstance(c, str) else "value"))


def joined(c: str | Column, name: str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.concat_ws("|", column).alias(name)


def rounded(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, digits).alias(name or c)
