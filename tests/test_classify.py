"""Datasets and models of several targets."""

import pytest
from pyspark.sql import functions as F

from dayloom.operators import classify

K = {"entity": "e", "date": "date"}
TARGETS = {
    "high": lambda d: (F.col("x") > 3).cast("int"),
    "seldom": lambda d: F.when(F.col("y") > 6, 1).when(F.col("y") < 2, 0),
    "never": lambda d: F.lit(None).cast("int"),
}


@pytest.fixture(scope="module")
def panel(make_panel):
    rows = [
        (e, d, None if (d + i) % 5 == 0 else float((d * 7 + i) % 9), float((d * d + i) % 11))
        for i, e in enumerate("pqr") for d in range(20) if (d + i) % 6
    ]
    return make_panel([*rows, ("alone", 3, 5.0, None)], "x double, y double")


def test_stacked_targets_equal_one_dataset_each(panel):
    stacked = classify.build_targets(panel, ["x", "y"], TARGETS, **K)
    for name, target in TARGETS.items():
        one = classify.build_dataset(panel, ["x", "y"], target, **K)
        ours = stacked.where(F.col("target_name") == name).drop("target_name")
        assert sorted(map(str, ours.select(one.columns).collect())) == sorted(map(str, one.collect()))
    assert stacked.where("target_name = 'never'").count() == 0


def test_targets_cost_one_scan(spark, panel, tmp_path):
    panel.write.parquet(str(tmp_path / "panel"))
    stacked = classify.build_targets(spark.read.parquet(str(tmp_path / "panel")), ["x", "y"], TARGETS, **K)
    plan = stacked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_models_side_by_side_equal_models_alone(panel):
    two = {name: TARGETS[name] for name in ("high", "seldom")}
    got = classify.predict_targets(panel, ["x", "y"], two, **K, trees=2, depth=2)
    assert set(got.columns) == {"e", "target", *classify.METRICS}
    for name, target in two.items():
        data = classify.build_dataset(panel, ["x", "y"], target, **K)
        alone = classify.scores(classify.fit_predict(data, ["x", "y"], trees=2, depth=2), "target", "prediction", ["e"])
        ours = got.where(F.col("target") == name).select(alone.columns)
        assert sorted(map(str, ours.collect())) == sorted(map(str, alone.collect()))


def test_trees_pass_over_bins_not_over_rows(spark, monkeypatch):
    """Equal rows are one weighted row, and the model is the one of all rows."""
    rows = [
        ("a", i, None if i % 11 == 0 else float(i * 7 % 9), float(i * i % 13), float((i * 7 % 9 > 3) ^ (i * i % 13 > 8)), "test" if i % 5 == 0 else "train")
        for i in range(1500)
    ]
    data = spark.createDataFrame(rows, "e string, i int, x double, y double, target double, part string")
    seen, fit = [], classify.GBTClassifier.fit

    def spied(self, df, *more):
        seen.append(df.count())
        return fit(self, df, *more)

    monkeypatch.setattr(classify.GBTClassifier, "fit", spied)
    plain, binned = [], []
    for out, bound in ((plain, 10_000), (binned, 100)):
        monkeypatch.setattr(classify, "PLAIN", bound)
        got = classify.fit_predict(data, ["x", "y"], trees=3, depth=3)
        assert {*data.columns, "prediction"} == set(got.columns)
        out += sorted(got.select("i", "target", "prediction").collect())
    assert plain == binned and len(plain) == 300
    assert seen[0] == 1200 and seen[1] <= 10 * 13 * 2
