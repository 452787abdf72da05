"""Lookups that a hot key cannot slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Parts into which the rows of one key are dealt.
SALTS = 256


def looked_up(
    rows: DataFrame, key: str | Sequence[str], found: DataFrame, deal: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """``rows`` with the columns that ``found`` (unique in ``key``) has for their ``key``.

    The rows of a key are dealt by ``deal`` into parts, and each part asks once: the rows
    of a hot key never meet in one task, and ``found`` is copied only to parts that ask.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(deal, F.lit(7)), F.lit(salts or SALTS)))
    told = dealt.select("_salt", *keys).distinct().join(found, keys)
    return dealt.join(told, ["_salt", *keys], how).drop("_salt")
