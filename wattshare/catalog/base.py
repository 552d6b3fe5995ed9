"""Registry of runnable queries.

A query is a function ``(spark, sf_dir) -> DataFrame``, the columns it returns, and where SQL can say the
same, that SQL.  The column list drives both sides: names, order, types and rounding are applied to
the DataFrame and to the SQL from one description, ``"name:kind"`` with kinds

    s text    i whole number    fN number rounded to N digits    t time stamp as text    d date as text
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshare.catalog.sql import with_tables


# Lifts exact halves off the rounding boundary, where one engine rounds the decimal text of a number
# and the other its binary value; far below the digits kept.
NUDGE = 1 + 1e-12


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: list[tuple[str, str]]
    sql: str | None
    covers: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_spark_column(n, k).alias(n) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"{_sql_column(n, k)} AS {n}" for n, k in self.columns)
        return with_tables(f"SELECT {shown} FROM ({self.sql}) AS q")


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, covers: str, sql: str | None = None):
    """Register the decorated function under ``name``."""
    pairs = [tuple(c.strip().split(":")) for c in columns.split(",")]

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query: {name}")
        REGISTRY[name] = Query(name, fn, pairs, sql, covers)
        return fn

    return register


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "s":
        return c.cast("string")
    if kind == "i":
        return c.cast("bigint")
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd")
    return F.round(c.cast("double") * NUDGE, int(kind[1:]))


def _sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR)"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind == "t":
        return f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    if kind == "d":
        return f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    rounded = f"round(CAST({name} AS DOUBLE) * {NUDGE!r}, {int(kind[1:])})"
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END"
