"""Reproducible samples and splits.

Every random order is the md5 of the row's own key and a seed, so a lost task
repeats the same draw and the result does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.functions import scalars as fn


def hash_key(*parts: str | Column, seed: str) -> Column:
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws("|", *cols, F.lit(seed))


def hash_order(*parts: str | Column, seed: str) -> Column:
    return F.md5(hash_key(*parts, seed=seed).cast("binary"))


def with_boots(df: DataFrame, boots: int) -> DataFrame:
    """Repeat every row once per bootstrap; a narrow explode, no join."""
    return df.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))


def two_samples(df: DataFrame, n: int | str, *, entity: str, date: str, seed: str) -> DataFrame:
    """Disjoint samples a and b of n rows each per entity and bootstrap.

    ``n`` is a number or the name of a column. If fewer than 2n rows exist the
    second sample is short; the caller decides if that fails the entity.
    """
    size = F.lit(n) if isinstance(n, int) else F.col(n)
    order = Window.partitionBy(entity, "boot").orderBy(hash_order(entity, date, "boot", seed=seed), date)
    ranked = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * size)
    return ranked.withColumn("sample", F.when(F.col("_r") <= size, "a").otherwise("b")).drop("_r")


def random_entities(
    df: DataFrame, n: int, *, entity: str, seed: str, at_least: int = 0, columns: Sequence[str] = ()
) -> DataFrame:
    """All rows of n entities drawn by hash order among those with enough known values."""
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_n_{c}") for c in columns])
    for c in columns:
        counts = counts.where(F.col(f"_n_{c}") >= at_least)
    picked = counts.select(entity).orderBy(hash_order(entity, seed=seed), entity).limit(n)
    return df.join(picked, entity, "left_semi")


def time_split(df: DataFrame, share: float, *, entity: str, date: str, within: Sequence[str] = ()) -> DataFrame:
    """First share of each entity's rows for training, the rest for testing."""
    u = Window.partitionBy(entity, *within)
    w = u.orderBy(date)
    early = F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(u) * F.lit(share))
    return df.withColumn("part", F.when(early, "train").otherwise("test"))


def hash_split(df: DataFrame, test_share: float, *, keys: Sequence[str], seed: str) -> DataFrame:
    """Random split by row hash."""
    u = fn.md5_bits(hash_key(*keys, seed=seed)) / F.lit(4294967296.0)
    return df.withColumn("part", F.when(u < test_share, "test").otherwise("train"))


def add_noise(df: DataFrame, columns: Sequence[str], sigma: float, *, keys: Sequence[str], seed: str) -> DataFrame:
    """Add N(0, sigma) to each column.

    One md5 of the row's key, the seed and a block number holds the bits of
    four draws, so columns are served four at a time.
    """
    draws = {}
    for i, c in enumerate(columns):
        h = f"_h{i // 4}"
        if i % 4 == 0:
            df = df.withColumn(h, hash_order(*keys, F.lit(i // 4), seed=seed))
        draws[c] = F.col(c) + sigma * fn.normal_from_md5(F.col(h), i % 4)
    return df.withColumns(draws).drop(*[c for c in df.columns if c.startswith("_h")])
