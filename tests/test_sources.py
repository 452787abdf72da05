"""Readers, writers, merges and vocabulary."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from dayloom import vocab
from dayloom.operators import ccit, merge
from dayloom.sources import readers, writers


def test_gzip_csv_to_merged_survey(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("participant_id,daily858_scheduledate,daily_stressed\np,2024-01-01 08:00:00,1\np,2024-01-02 08:00:00,\nq,oops,0\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("participant_id,sam_scheduledate,sam7\np,2024-01-02,3\nq,2024-01-05,2\n")

    def schema(date, value):
        return StructType([StructField("participant_id", StringType()), StructField(date, StringType()), StructField(value, DoubleType())])

    a = readers.with_schedule_day(readers.read_survey_csv(spark, str(tmp_path / "a.csv.gz"), schema("daily858_scheduledate", "daily_stressed")))
    b = readers.with_schedule_day(readers.read_survey_csv(spark, str(tmp_path / "b.csv.gz"), schema("sam_scheduledate", "sam7")))
    out = merge.merge_period_surveys([a, b], entity="participant_id", date="date")
    got = {(r["participant_id"], r["date"].day): (r["daily_stressed"], r["sam7"]) for r in out.collect()}
    assert got == {("p", 1): (1.0, None), ("p", 2): (None, 3.0), ("q", 5): (None, 2.0)}


def test_panel_roundtrip_and_feeds(spark, tmp_path):
    df = spark.createDataFrame([("p", "2024-01-02 09:00:00", 1.0), ("p", "2024-01-01 09:00:00", 2.0)], "participant_id string, start_time string, x double")
    df.write.parquet(str(tmp_path / "raw"))
    done = writers.ingest_feeds(spark, {"ebt": (str(tmp_path / "raw"), "start_time")}, str(tmp_path / "out"))
    back = readers.read_table(spark, done["ebt"])
    assert {r["date"] for r in back.collect()} == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}
    writers.write_panel(back.drop("day"), str(tmp_path / "panel"), entity="participant_id")
    assert readers.read_table(spark, str(tmp_path / "panel"), ["x"]).count() == 2


@pytest.mark.parametrize("period", ["day", "month"])
def test_ingest_replaces_only_the_periods_it_brings(spark, tmp_path, period):
    out, cols = str(tmp_path / "out"), "participant_id string, start_time string, x double"
    whole = [("p", "2024-01-01 09:00:00", 1.0), ("p", "2024-02-02 09:00:00", 2.0), ("p", None, 3.0)]
    late = [("p", "2024-02-02 10:00:00", 4.0), ("q", "2024-02-02 11:00:00", 5.0)]
    for name, rows in (("whole", whole), ("late", late)):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / name))
    read = lambda: sorted(r["x"] for r in readers.read_table(spark, f"{out}/ring").collect())
    for _ in range(2):
        writers.ingest_feeds(spark, {"ring": (str(tmp_path / "whole"), "start_time")}, out, period=period)
        assert read() == [1.0, 2.0, 3.0]
    writers.ingest_feeds(spark, {"ring": (str(tmp_path / "late"), "start_time")}, out, period=period)
    assert read() == [1.0, 3.0, 4.0, 5.0]
    undated = readers.read_table(spark, f"{out}/ring").where("date is null").collect()
    assert [r["x"] for r in undated] == [3.0]


def test_result_store_replaces_only_its_own_run(spark, tmp_path):
    path = str(tmp_path / "edges")
    df = spark.createDataFrame([("p", 1.0)], "e string, w double")
    writers.write_results(df, path, {"definition": "a", "boots": 2})
    writers.write_results(df.withColumn("w", F.lit(5.0)), path, {"definition": "b", "boots": 2})
    writers.write_results(df.withColumn("w", F.lit(9.0)), path, {"definition": "b", "boots": 2})
    assert sorted(r["w"] for r in readers.read_table(spark, path).collect()) == [1.0, 9.0]
    assert [r["w"] for r in writers.read_results(spark, path, definition="a").collect()] == [1.0]


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, b string")
    got = {(r["k"], r["a"], r["b"]) for r in merge.outer_chain([a, b], ["k"]).collect()}
    assert got == {(1, "x", None), (None, "y", "z"), (2, None, "w")}


def test_first_per_key_and_clean_once(spark):
    df = spark.createDataFrame([("p", 2, 0.0), ("p", 1, 1.0)], "participant_id string, record_id int, med_4___2 double")
    one = readers.first_per_key(df, "participant_id", ["record_id"])
    assert [tuple(r) for r in one.collect()] == [("p", 1, 1.0)]
    codes = vocab.coded_columns()
    wide = one.select("participant_id", *[F.lit(0.0).alias(c) if c != "med_4___2" else F.col(c) for c in codes])
    r = readers.clean_once(wide).first()
    assert r["hx_diabetes"] == 1.0 and r["hx_any"] == 1.0 and r["mhx_any"] == 0.0


def study_tables(spark):
    day = dt.date(2024, 1, 1)
    items = {c: 1.0 for s in vocab.ITEM_SCORES for c in vocab.items(s)}
    once = spark.createDataFrame([("p",), ("lonely",)], "participant_id string").select(
        "participant_id", *[F.lit(1.0).alias(c) for s in vocab.ONCE_SCORES for c in vocab.items(s)])
    rest = [c for c in items if not any(c in vocab.items(s) for s in vocab.ONCE_SCORES)]
    survey = spark.createDataFrame([("p", day)], "participant_id string, date date").select(
        "participant_id", "date", *[F.lit(1.0).alias(c) for c in rest])
    sleep = spark.createDataFrame([("p", day, 0.0), ("q", day, 1.0)], "participant_id string, date date, rmssd double")
    watch = spark.createDataFrame([("q", day, 7.0)], "participant_id string, date date, steps double")
    return sleep, once, survey, watch


def test_full_and_left_study_merges(spark):
    sleep, once, survey, watch = study_tables(spark)
    full = {r["participant_id"]: r for r in merge.merge_everything(sleep, once, [survey, watch]).collect()}
    assert set(full) == {"p", "q", "lonely"}
    assert full["p"]["log_hrv"] == float("-inf") and full["p"]["phq9_score"] == 9.0 and full["p"]["ace_score"] == 10.0
    assert full["q"]["steps"] == 7.0 and full["q"]["phq9_score"] is None and full["lonely"]["date"] is None
    assert sorted(r["p_id"] for r in full.values()) == [0, 1, 2]
    left = merge.merge_watch_led(watch, once, sleep, [survey]).collect()
    assert [(r["participant_id"], r["rmssd"], r["zeroes"]) for r in left] == [("q", 1.0, 0.0)]


def test_feature_sets_drop_target_and_leaks():
    assert "daily_shifts" not in vocab.resolve_features("surveys", "shift_stress")
    total = vocab.resolve_features("oura+surveys", "total_stress")
    assert not {"daily_stressed", "daily_control", "shift_stress"} & set(total) and len(total) == 20
    assert len(vocab.FEATURE_SETS["all"]) == 36 and len(vocab.coded_columns()) == 29
    assert len(vocab.TRAITS_CATEGORICAL) == 31
    assert vocab.needs_watch_panel(vocab.FEATURE_SETS["all"]) and not vocab.needs_watch_panel(vocab.RING)


@pytest.mark.parametrize("dependent", [True, False])
def test_classifier_test_tells_dependence(spark, dependent):
    import numpy as np

    rng = np.random.default_rng(0)
    x, e = rng.normal(size=600), rng.normal(size=600)
    y = x + 0.1 * e if dependent else e
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    p = ccit.conditional_independence(df, "x", "y", [], row_id="id", rounds=2, trees=10)
    assert (p < 0.01) if dependent else (p > 0.01)
