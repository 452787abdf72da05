"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, days as text.

    A billionth is added first (here and in the SQL twin), because sums in a
    different order put exact halves on either side of the rounding point.
    """
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c + F.lit(1e-9), 6) + F.lit(0.0)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def r6(x: str, name: str | None = None) -> str:
    """SQL twin of ``tidy`` for one number."""
    return f"round(({x}) + 1e-9, 6) + 0.0" + (f" AS {name}" if name else "")


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)
