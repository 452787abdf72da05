"""Dominant periods of daily signals.

A signal is one array per entity, at most as long as the calendar. The Fourier
transform is an Arrow-batched helper; everything around it is columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dayloom.operators import panel


@F.pandas_udf(ArrayType(DoubleType()))
def amplitudes(series: pd.Series) -> pd.Series:
    """|rFFT| of each array, rounded so that equal peaks compare equal."""
    return series.map(lambda s: None if s is None or len(s) == 0 else np.round(np.abs(np.fft.rfft(np.asarray(s, float))), 9))


def inner_values(df: DataFrame, columns: Sequence[str], *, entity: str, date: str) -> DataFrame:
    """Zeros count as missing; inner gaps are filled linearly, outer ones stay null."""
    known = df.withColumns({c: F.when(F.col(c) != 0, F.col(c).cast("double")) for c in columns})
    return panel.interpolate(known, columns, entity=entity, date=date, inside_only=True)


def signals(
    df: DataFrame, columns: Sequence[str], *, entity: str, date: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per entity and signal with its length and amplitudes.

    The arrays are collected side by side under the windows' own partitioning
    and turned into rows afterwards, so many signals still cost one shuffle.
    """
    clean = inner_values(df, columns, entity=entity, date=date)
    listed = clean.groupBy(entity, *carry).agg(*[
        F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("d"), F.col(c).alias("x"))))).alias(c)
        for c in columns
    ])
    pairs = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c)["x"].alias("values")) for c in columns])
    long = listed.select(entity, *carry, F.inline(pairs))
    return long.select(entity, *carry, "signal", F.size("values").alias("n"), amplitudes("values").alias("amp"))


def _arg_max(amp: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(amp, F.array_max(amp)) - 1).cast("int")


def _as_period(n: Column, k: Column) -> Column:
    return F.when(k == 0, F.lit(float("inf"))).otherwise(n / F.nullif(k, F.lit(0)))


def dominant_period(kind: str, compat: bool = False) -> Column:
    """Period expression over the columns of ``signals``.

    peak: strongest frequency, the constant one included (infinite period).
    half: strongest varying frequency, null if its period exceeds half the length.
    cutoff: strongest among the periods of at most half the length.
    ``compat`` reads amplitudes one place early, as published results did: there
    the list of frequencies had lost its first entry and the amplitudes had not.
    """
    n, amp = F.col("n"), F.col("amp")
    size = F.size(amp)
    if kind == "peak":
        return _as_period(n, _arg_max(amp))
    varying = F.slice(amp, 2, F.greatest(size - 1, F.lit(1)))
    if kind == "half":
        k = _arg_max(amp) + 1 if compat else _arg_max(varying) + 1
        ok = (size > 1) & (k < size) & (k >= 2)
        return F.when(ok, _as_period(n, k))
    if compat:
        # place i holds the amplitude of frequency i but is read as frequency i + 1
        early = F.slice(amp, 2, F.greatest(size - 2, F.lit(1)))
        ok = (size > 2) & (_arg_max(amp) < size - 1)
        return F.when(ok, _as_period(n, _arg_max(early) + 2))
    late = F.slice(amp, 3, F.greatest(size - 2, F.lit(1)))
    return F.when(size > 2, _as_period(n, _arg_max(late) + 2))


def spectrum_table(df: DataFrame, columns: Sequence[str], *, entity: str, date: str) -> DataFrame:
    """Frequency and amplitude of every signal, one row each."""
    s = signals(df, columns, entity=entity, date=date)
    return s.select(entity, "signal", "n", F.posexplode("amp").alias("k", "amplitude")).withColumn(
        "freq", F.col("k") / F.col("n")
    )


def period_study(
    df: DataFrame, features: Sequence[str], *, entity: str, date: str, at_least: int = 10,
    kind: str = "half", compat: bool = False,
) -> DataFrame:
    """Dominant period of each feature for every entity with enough rows.

    Days are filled, scaled, interpolated and the rest set to the entity mean,
    all in one pass over the wide panel.
    """
    rows = F.count(F.lit(1)).over(panel.whole(entity))
    kept = df.select(entity, date, *features).withColumn("_n", rows).where(F.col("_n") >= at_least).drop("_n")
    out = panel.z_score(panel.fill_days(kept, entity=entity, date=date), features, entity=entity)
    out = panel.interpolate(out, features, entity=entity, date=date)
    out = panel.fill_with_mean(out, features, entity=entity)
    s = signals(out, features, entity=entity, date=date)
    return s.select(entity, "signal", dominant_period(kind, compat).alias("period"))


def smoothed_period_study(
    df: DataFrame, features: Sequence[str], *, entity: str, date: str
) -> DataFrame:
    """Period of each scaled rolling mean, kept up to half the entity's row count."""
    banded = df.withColumn("_rows", F.count(F.lit(1)).over(panel.whole(entity)))
    for c in features:
        banded = panel.rolling_band(banded, c, entity=entity, date=date)
    scaled = banded.select(entity, date, "_rows", *[F.col(f"z_rolling_{c}").alias(c) for c in features])
    s = signals(scaled, features, entity=entity, date=date, carry=["_rows"])
    out = s.select(entity, "_rows", "signal", dominant_period("peak").alias("period"))
    return out.where(F.col("period") <= F.col("_rows") / 2).drop("_rows")


def period_counts(periods: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histogram of whole-day periods."""
    known = periods.where(F.col("period").isNotNull())
    return known.groupBy(*by, F.floor("period").alias("period")).agg(F.count(F.lit(1)).alias("n"))
