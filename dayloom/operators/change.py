"""Correlation with a lag, and the change-versus-condition study."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.functions import scalars as fn, tails
from dayloom.operators import panel


def lagged_correlation(
    df: DataFrame, first: str, second: str, *, entity: str, date: str, shift: int = 0
) -> DataFrame:
    """Pearson r and p per entity over rows where ``first`` is known.

    A positive shift pairs a row's ``first`` with the ``second`` of ``shift``
    rows earlier. A missing ``second`` or fewer than two pairs gives null.
    """
    known = df.where(F.col(first).isNotNull()).select(entity, date, first, second)
    other = panel.shift(second, shift, entity=entity, date=date) if shift else F.col(second)
    rn = F.row_number().over(panel.by_day(entity, date))
    n = F.count(F.lit(1)).over(panel.whole(entity))
    paired = known.withColumns({"_b": other, "_rn": rn, "_n": n})
    inside = (F.col("_rn") > shift) if shift >= 0 else (F.col("_rn") <= F.col("_n") + shift)
    moments = (
        paired.where(inside)
        .groupBy(entity)
        .agg(
            fn.correlation(first, "_b").alias("r"),
            F.count(F.lit(1)).alias("n"),
            F.count("_b").alias("_known"),
        )
    )
    ok = (F.col("n") >= 2) & (F.col("_known") == F.col("n"))
    out = moments.withColumn("r", F.when(ok, F.col("r"))).drop("_known")
    return out.withColumn("p_val", tails.pearson_p_value(F.col("r"), F.col("n")))


def change_vs_condition(
    df: DataFrame, features: Sequence[str], condition: str, window: int, *, entity: str, date: str,
    label: Callable[[DataFrame], DataFrame] | None = None, shift: int = 0, kind: str = "linear",
) -> DataFrame:
    """Does change in the features go along with change in a condition?

    Gap filling, interpolation, z-scores, the condition's percentile bin (or
    the caller's own label step), the rolling score of features and of the
    condition, and their lagged correlation: one row per entity.
    """
    keys = {"entity": entity, "date": date}
    out = panel.interpolate(panel.fill_days(df, **keys), features, **keys)
    out = panel.z_score(out, features, entity=entity)
    out = label(out) if label else panel.add_percentiles(out, [condition], entity=entity)
    target = f"{condition}_percentile" if f"{condition}_percentile" in out.columns else condition
    out = out.withColumn(target, fn.number_or_zero(target))
    out = panel.rolling_mmd_average(out, features, window, **keys, kind=kind)
    out = out.withColumn("_cond", panel.rolling_mmd(target, window, **keys))
    return lagged_correlation(out, "average_MMD", "_cond", **keys, shift=shift)
