"""Joins of panels, entity tables and surveys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dayloom import vocab
from dayloom.functions import scalars as fn
from dayloom.operators.ordered import dense_codes
from dayloom.sources.readers import item_scores


def drop_repeats(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right side without the columns the left side already has: first copy wins."""
    taken = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    return right.select(*[c for c in right.columns if c.lower() not in taken])


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    right = drop_repeats(right, left, keys).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def left_chain(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins onto ``base``, null keys matching null keys.

    The running result keeps its partitioning by the keys, so every further
    table costs one shuffle of that table only.
    """
    return reduce(lambda left, right: _null_safe(left, right, keys, "left"), others, base)


def outer_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of N tables on shared keys.

    Distinct keys of all tables form the left side of a chain of left joins:
    the same rows as N - 1 full joins, but the growing result is never
    reshuffled on coalesced keys.
    """
    spine = reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()
    return left_chain(spine, frames, keys)


def with_entity_table(panel: DataFrame, once: DataFrame, entity: str, how: str) -> DataFrame:
    """Attach entity attributes; ``how="full"`` also keeps entities without rows.

    Written as a left join plus an anti join: both can split a hot entity, which
    a full join cannot. The size of ``once`` decides at run time if it is broadcast.
    """
    once = drop_repeats(once, panel, [entity])
    out = panel.join(once, entity, "left")
    if how == "left":
        return out
    lonely = once.join(panel.select(entity).distinct(), entity, "left_anti")
    return out.unionByName(lonely, allowMissingColumns=True)


def merge_panels(
    base: DataFrame, once: DataFrame, others: Sequence[DataFrame], *, entity: str, date: str, how: str
) -> DataFrame:
    """Base panel with entity table and further panels; ``how`` is left or full."""
    led = with_entity_table(base, once, entity, how)
    chain = left_chain(led, others, [entity, date]) if how == "left" else outer_chain([led, *others], [entity, date])
    return chain


def study_scores(df: DataFrame, *, entity: str) -> DataFrame:
    """log_hrv, a null-carrying zero, the nine questionnaire scores and the entity code."""
    out = df.withColumns({"log_hrv": fn.natural_log("rmssd"), "zeroes": fn.zero_like("rmssd")})
    return dense_codes(item_scores(out, list(vocab.ITEM_SCORES)), entity, "p_id")


def merge_watch_led(watch, once, sleep, surveys, *, entity="participant_id", date="date"):
    """Left merge led by the watch panel, with all scores."""
    return study_scores(
        merge_panels(watch, once, [sleep, *surveys], entity=entity, date=date, how="left"), entity=entity
    )


def merge_everything(sleep, once, others, *, entity="participant_id", date="date"):
    """Full merge of every panel with all scores; leave a source out of ``others`` to skip it."""
    return study_scores(
        merge_panels(sleep, once, others, entity=entity, date=date, how="full"), entity=entity
    )


def merge_sleep_daily(sleep, daily, *, entity="participant_id", date="date"):
    out = left_chain(sleep, [daily], [entity, date])
    return out.withColumns({"log_hrv": fn.natural_log("rmssd"), "zeroes": fn.zero_like("rmssd")})


def merge_period_surveys(frames: Sequence[DataFrame], *, entity: str, date: str) -> DataFrame:
    """Outer merge of surveys on entity and day; repeats multiply, null days go."""
    return outer_chain([f.where(F.col(date).isNotNull()) for f in frames], [entity, date])


def merge_once_surveys(frames: Sequence[DataFrame], *, entity: str, record: str) -> DataFrame:
    return outer_chain(frames, [entity, record])


def fill_with_global_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls take the column's overall mean; the means are a single row."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(means)).withColumns(filled).select(*df.columns)


def informative(df: DataFrame, column: str, k: int, *, entity: str) -> DataFrame:
    """Gate in long form: is the column's distinct known count at least k per entity?"""
    return df.groupBy(entity).agg(F.count_distinct(column).alias("n")).where(F.col("n") >= k)
