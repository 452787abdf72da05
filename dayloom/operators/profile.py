"""Coverage and completeness profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.operators.panel import _spine


def distinct_gate(df: DataFrame, columns: Sequence[str], k: int, *, entity: str) -> DataFrame:
    """Features with at least k distinct known values, per entity, in long form."""
    long = df.unpivot([entity], list(columns), "feature", "x").where(F.col("x").isNotNull())
    counts = long.groupBy(entity, "feature").agg(F.count_distinct("x").alias("n_values"))
    return counts.where(F.col("n_values") >= k)


def active_entities(df: DataFrame, k: int, *, entity: str, date: str) -> DataFrame:
    """Entities with rows on at least k distinct days."""
    return df.groupBy(entity).agg(F.count_distinct(date).alias("n_days")).where(F.col("n_days") >= k)


def half_lengths(df: DataFrame, *, entity: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(entity).agg(n.alias("n"), (n / 2).alias("half_n"))


def coverage(df: DataFrame, threshold: int, *, entity: str, date: str) -> DataFrame:
    """One row: long entities, and mean and std of observed days, calendar days and their share."""
    per = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), (F.datediff(F.max(date), F.min(date)) + 1).alias("filled")
    ).withColumn("share", F.col("n") / F.col("filled"))
    return per.agg(
        F.count_if(F.col("n") >= threshold).alias("n_long"),
        F.avg("n").alias("mean_days"), F.stddev_pop("n").alias("std_days"),
        F.avg("filled").alias("mean_filled"), F.stddev_pop("filled").alias("std_filled"),
        F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share"),
    )


def period_completeness(df: DataFrame, freq: str, *, survey: str, entity: str, date: str) -> DataFrame:
    """Mean and std over entities of rows per period spanned, for each survey."""
    per = df.groupBy(survey, entity).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi")
    )
    share = F.col("n") / F.size(_spine(F.col("lo"), F.col("hi"), freq))
    return per.withColumn("share", share).groupBy(survey).agg(
        F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share")
    )


def once_completeness(answers: DataFrame, everyone: DataFrame, *, survey: str, entity: str) -> DataFrame:
    """Share of all entities that answered each one-off survey."""
    total = everyone.agg(F.count_distinct(entity).alias("_all"))  # one row
    done = answers.groupBy(survey).agg(F.count_distinct(entity).alias("_n"))
    return done.crossJoin(F.broadcast(total)).select(survey, (F.col("_n") / F.col("_all")).alias("share"))
