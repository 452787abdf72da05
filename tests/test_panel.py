"""Edge rules of the panel operators on hand-made frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.functions import scalars as fn
from dayloom.operators import change, panel, runs, sampling

K = {"entity": "e", "date": "date"}


def col(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("e", "date"))).collect()]


def one(make_panel, values, name="x"):
    return make_panel([("p", i, v) for i, v in enumerate(values)], f"{name} double")


def test_interpolation_keeps_leading_nulls_and_extends_the_tail(make_panel):
    df = one(make_panel, [None, 1.0, None, None, 4.0, None, None])
    assert col(panel.interpolate(df, ["x"], **K), "x") == [None, 1, 2, 3, 4, 4, 4]
    assert col(panel.interpolate(df, ["x"], **K, inside_only=True), "x") == [None, 1, 2, 3, 4, None, None]


def test_percentile_averages_ties_and_skips_nulls(make_panel):
    df = one(make_panel, [10.0, 20.0, 20.0, None, 30.0])
    assert col(panel.add_percentiles(df, ["x"], entity="e"), "x_percentile") == [0.25, 0.625, 0.625, None, 1.0]


def test_quartile_bins_are_right_closed(make_panel):
    df = one(make_panel, [0.0, 0.25, 0.250001, 0.75, 0.76, 1.0, None])
    assert col(df.withColumn("b", fn.quartile_bin(F.col("x"))), "b") == [0.25, 0.25, 0.75, 0.75, 1, 1, None]


def test_day_spine_keeps_the_first_duplicate(spark):
    rows = [("p", dt.date(2024, 1, 3), 1, 5.0), ("p", dt.date(2024, 1, 1), 2, 7.0), ("p", dt.date(2024, 1, 3), 3, 9.0)]
    df = spark.createDataFrame(rows, "e string, date date, n int, x double")
    once = panel.first_row_per_day(df, **K, order=["n"])
    filled = panel.fill_days(once, **K)
    assert col(filled, "x") == [7.0, None, 5.0]
    assert col(filled, "e") == ["p"] * 3


def test_period_spines_match_pandas(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 7), dt.date(2024, 1, 20), dt.date(2024, 3, 31)]
    df = spark.createDataFrame([("p", d, float(i)) for i, d in enumerate(days)], "e string, date date, x double")
    s = pd.Series(range(4), index=pd.to_datetime(days), dtype=float)
    for ours, theirs in (("W", "W"), ("2W", "2W"), ("3D", "3D"), ("M", "ME"), ("D", "D")):
        want = s.resample(theirs).asfreq()
        got = panel.fill_periods(df, ours, **K).orderBy("date").collect()
        assert [r["date"] for r in got] == [d.date() for d in want.index], ours
        assert [r["x"] for r in got] == [None if np.isnan(v) else v for v in want], ours


def test_z_score_of_flat_and_empty_columns_is_zero(make_panel):
    df = make_panel([("p", i, 3.0, None) for i in range(4)], "a double, b double")
    out = panel.z_score(df, ["a", "b"], entity="e")
    assert col(out, "a") == [0.0] * 4 and col(out, "b") == [0.0] * 4


def test_rolling_mmd_of_squares(make_panel):
    df = one(make_panel, [float(i * i) for i in range(10)])
    out = df.withColumn("m", panel.rolling_mmd("x", 2, **K))
    assert col(out, "m") == [None, None, 36, 100, 196, 324, 484, 676, 900, None]


def test_limited_fills(make_panel):
    df = one(make_panel, [1.0, None, None, None, 5.0])
    assert col(panel.forward_fill(df, ["x"], 2, **K), "x") == [1, 1, 1, None, 5]
    assert col(panel.backward_fill(df, ["x"], 1, **K), "x") == [1, None, None, 5, 5]


def test_truthy_or_returns_first_null_or_nonzero(spark):
    df = spark.createDataFrame([(0.0, None, 1.0), (0.0, 0.0, 1.0), (1.0, None, None)], "a double, b double, c double")
    assert [r["t"] for r in df.select(fn.first_truthy("a", "b", "c").alias("t")).collect()] == [None, 1.0, 1.0]


def test_pad_label_jumps_past_a_hit(make_panel):
    hits = [0, 0, 1, 1, 1, 0, 0, 0, 0, 1]

    def walk(y, b):  # direct scan
        out, i = list(y), b
        while i < len(y) - b:
            if y[i] == 1:
                for j in range(i - b, i + b + 1):
                    out[j] = 1
                i += b + 1
            else:
                i += 1
        return out

    random.seed(3)
    for y in [hits] + [[random.randint(0, 1) for _ in range(15)] for _ in range(5)]:
        df = one(make_panel, [float(v) for v in y])
        assert col(panel.pad_label(df, "x", 2, **K), "x") == walk(y, 2)


def test_runs_are_averaged_thinned_or_kept(make_panel):
    labels = [1, 1, 1, 1, 0, None, 2, 2, 1]
    df = make_panel([("p", i, l, float(i)) for i, l in enumerate(labels)], "y int, x double")
    out = runs.sample_runs(df, ["x"], "y", limit=3, boots=1, seed="s", **K)
    stress = sorted(r["x"] for r in out.where("cond = 'stress'").collect())
    assert len(stress) == 4 and stress[2:] == [6.5, 8.0] and set(stress[:2]) <= {0.0, 1.0, 2.0, 3.0}
    assert [r["x"] for r in out.where("cond = 'no_stress'").collect()] == [4.0]


def test_a_final_run_always_ends_one_row_early(make_panel):
    df = make_panel([("p", i, 1, float(i)) for i in range(4)], "y int, x double")
    out = runs.sample_runs(df, ["x"], "y", limit=3, boots=1, seed="s", **K)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 3.0]


def test_two_samples_are_disjoint_and_stable(make_panel):
    df = make_panel([("p", i, 0.0) for i in range(20)] + [("q", i, 0.0) for i in range(20)], "x double")
    s = sampling.two_samples(sampling.with_boots(df, 3), 7, **K, seed="k")
    rows = {(r["e"], r["boot"], r["date"]): r["sample"] for r in s.collect()}
    assert len(rows) == 2 * 3 * 14
    again = sampling.two_samples(sampling.with_boots(df.repartition(7), 3), 7, **K, seed="k")
    assert rows == {(r["e"], r["boot"], r["date"]): r["sample"] for r in again.collect()}


def test_lagged_correlation_follows_positional_shift(make_panel):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=12), rng.normal(size=12)
    a[0] = np.nan
    df = make_panel([("p", i, None if np.isnan(x) else float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    x, y = a[1:], b[1:]
    for k, (u, v) in {0: (x, y), 2: (x[2:], y[:-2]), -3: (x[:-3], y[3:])}.items():
        r = change.lagged_correlation(df, "a", "b", **K, shift=k).first()
        assert r["n"] == len(u) and r["r"] == pytest.approx(np.corrcoef(u, v)[0, 1])


def test_prepared_panel_is_complete(make_panel):
    df = make_panel([("p", 0, 1.0, None), ("p", 3, 4.0, 2.0), ("p", 5, None, 3.0)], "x double, y double")
    out = panel.prepare(df, ["x", "y"], **K)
    assert out.count() == 6 and out.where("x is null or y is null").count() == 0


def test_one_row_entity(make_panel):
    df = make_panel([("p", 0, 2.0)], "x double")
    out = panel.prepare(df, ["x"], **K).withColumn("m", panel.rolling_mmd("x", 1, **K))
    assert [tuple(r)[2:] for r in out.collect()] == [(0.0, None)]
