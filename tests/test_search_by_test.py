"""The table search against the row search, tests by name, definitions as a key, labels by name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import ci_tests, graph_search as gs, labels

FEATS = ["a", "b", "c", "d", "e"]


def graph_table(spark, samples, usable=None):
    rows = []
    for k, x in enumerate(samples):
        c = np.clip(np.corrcoef(x.T), -1, 1)
        r = np.corrcoef(x.argsort(0).argsort(0).T)
        rows.append((k, len(x), c.ravel().tolist(), r.ravel().tolist(), x.ravel().tolist(), list(usable or range(x.shape[1]))))
    df = spark.createDataFrame(rows, "g int, n long, c array<double>, s array<double>, x array<double>, usable array<int>")
    return df.withColumn("limit", gs.critical_r(F.col("n"), 0.05))


def samples(seed, graphs=25, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(graphs):
        mix = np.tril(rng.normal(size=(5, 5)) * (rng.random((5, 5)) < 0.5), -1) + np.eye(5)
        out.append(rng.normal(size=(n, 5)) @ mix.T)
    return out


@pytest.mark.parametrize("max_cond, usable", [(0, None), (1, None), (2, None), (2, [0, 2, 3])])
def test_table_search_equals_row_search(spark, max_cond, usable):
    table = graph_table(spark, samples(max_cond), usable)
    a = gs.skeleton(table, FEATS, max_cond=max_cond)
    b = gs.skeleton_by_test(table, FEATS, "pearsonr", keys=["g"], alpha=0.05, max_cond=max_cond)
    read = lambda df: {r.g: (sorted(map(tuple, r.edges)), sorted((c.i, c.j, tuple(c.z)) for c in r.cut)) for r in df.collect()}
    assert read(a) == read(b)


def test_partial_correlation_equals_residuals(spark):
    x = samples(9, 1, 200)[0]
    c = np.corrcoef(x.T).ravel().tolist()
    df = spark.createDataFrame([(c,)], "m array<double>")
    at = lambda a, b: F.element_at("m", (a * 5 + b + 1).cast("int"))
    for z in ([], [2], [2, 4], [2, 3, 4]):
        got = df.select(ci_tests.partial_correlation_given(at, F.lit(0), F.lit(1), [F.lit(v) for v in z])).first()[0]
        centred = x - x.mean(0)
        rest = centred[:, :2] - (centred[:, z] @ np.linalg.lstsq(centred[:, z], centred[:, :2], rcond=None)[0] if z else 0)
        assert got == pytest.approx(np.corrcoef(rest.T)[0, 1], abs=1e-9)


def test_classifier_as_ci_test(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=1500)
    chain = np.stack([z + 0.4 * rng.normal(size=1500), z, z + 0.4 * rng.normal(size=1500)], 1)
    found = gs.skeleton_by_test(graph_table(spark, [chain]), ["x", "z", "y"], "ccit", keys=["g"], alpha=0.01, max_cond=1).first()
    assert sorted(map(tuple, found.edges)) == [(0, 1), (1, 2)]
    assert [(c.i, c.j, list(c.z)) for c in found.cut] == [(0, 2, [1])]


def test_a_test_of_ones_own(spark):
    @ci_tests.ci_test("never")
    def never(asked):
        return asked.questions.limit(0)

    try:
        table = graph_table(spark, samples(1, 3))
        rows = gs.skeleton_by_test(table, FEATS, "never", keys=["g"], alpha=0.05).collect()
        assert all(len(r.edges) == 10 and not r.cut for r in rows)
    finally:
        del ci_tests.TESTS["never"]


def panel_rows(make_panel, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("p", "q", "few"):
        for d in range(70):
            if rng.random() < 0.9:
                a, b, c = rng.normal(size=3)
                rows.append((e, d, float(a), float(a + 0.3 * b), float(c) if e != "few" else float(d % 3), float(rng.random())))
    return make_panel(rows, "a double, b double, c double, ppe_6 double")


KEYS = {"entity": "e", "date": "date"}
OPTIONS = {"boots": 2, "min_rows": 6, **KEYS}


def test_definitions_share_one_panel(spark, make_panel, monkeypatch):
    df = panel_rows(make_panel)
    low = lambda d: d.withColumn("label", (F.col("a") > 0).cast("int"))
    high = lambda d: d.withColumn("label", (F.col("b") > 0.5).cast("int"))
    feats = {"one": (["a", "b", "c"], low), "two": (["b", "c"], high)}
    plans, cut = [], gs.cut_lineage
    monkeypatch.setattr(gs, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    read = lambda rows: {
        (r.definition, r.e, r.boot, r.cond): (r.n, sorted(r.usable), sorted(map(tuple, r.arcs)), sorted(map(tuple, r.edges))) for r in rows.collect()
    }
    both = read(gs.discover(df, feats, **OPTIONS))
    assert len(plans) == 1 and plans[0].count("Scan ExistingRDD") == 1
    assert {k[0] for k in both} == {"one", "two"} and {k[1] for k in both} == {"p", "q", "few"}
    assert all(2 not in v[1] for k, v in both.items() if k[1] == "few")
    assert all(0 not in v[1] for k, v in both.items() if k[0] == "two")
    alone = read(gs.discover(df, {"one": feats["one"]}, **OPTIONS))
    assert alone == {k: v for k, v in both.items() if k[0] == "one"}


def test_labels_by_name(spark, make_panel):
    rows = [("p", d, [None, 1.0][d % 2], float(d), [None, 80.0, 10.0, 50.0][d % 4], 1.0 * (d > 5), 2.0 * (d > 6)) for d in range(8)]
    df = make_panel(rows, "ppe_6 double, log_hrv double, daily_control double, daily_stressed double, shift_stress double")
    df = df.withColumn("daily_shifts", F.lit(0)).withColumn("control_cat", F.lit(0.0))
    read = lambda name, **s: [r.label for r in labels.step(name, **KEYS, **s)(df).orderBy("date").collect()]
    assert read("control_cat", hi=75, lo=25) == [None, 1, 0, None, None, 1, 0, None]
    assert read("hrv_binary") == [1, None, None, None, None, 0, 0, 0]
    assert read("daily_stressed") == [0, 0, 0, 0, 0, 0, 1, 1]
    assert read("total_stress") == [None] * 6 + [1, 1]
    assert read("any_stress") == [1, None, None, None, None, 0, 1, 1]
    assert read("ppe_6") == [None] * 8  # back-filled to 1.0 every day: all ranks tie in the middle
    assert labels.step("covid_past_24", columns={"covid_past_24": "ppe_6"}, **KEYS)(df).where("label = 1").count() == 8
    with pytest.raises(KeyError):
        labels.step("unknown", **KEYS)
    found = labels.definitions(["shift_stress", "daily_control"], ["daily_shifts", "daily_stressed", "efficiency"], {"efficiency": "x"}, **KEYS)
    assert [f for f, _ in found.values()] == [["daily_stressed", "x"], ["daily_shifts", "x"]]


def test_labels_after_scaling(spark, make_panel):
    """The published order: a label that compares raw values sees scaled and completed ones."""
    seen = {}

    def step(df):
        seen["nulls"] = df.where("a IS NULL").count()
        seen["mean"] = df.where("e = 'p'").agg(F.avg("a")).first()[0]
        return df.withColumn("label", (F.col("a") > 0).cast("int"))

    df = panel_rows(make_panel).withColumn("a", F.col("a") + 10)
    gs.discover(df, {"one": (["a", "b"], step)}, **OPTIONS)
    assert seen["nulls"] > 0 and seen["mean"] > 9
    gs.discover(df, {"one": (["a", "b"], step)}, label_after_scaling=True, **OPTIONS)
    assert seen["nulls"] == 0 and abs(seen["mean"]) < 1
