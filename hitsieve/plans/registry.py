"""Registered queries: a Spark callable each and, where one exists, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def n(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(df: DataFrame, keep: list[str], values: list[str], counts: list[str] = (), digits: int = 6) -> DataFrame:
    return df.select(*keep, *[r(v, digits).alias(v) for v in values], *[n(c).alias(c) for c in counts])


def sql_r(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0"


def sql_rs(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{sql_r(x, digits)} AS {x}" for x in names)
