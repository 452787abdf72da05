"""The stored chain: graphs, comparison, summaries and tests."""

import pytest
from pyspark.sql import functions as F

from dayloom.operators import graph_tables as gt, study

FEATURES = ["a", "b", "c"]
THEMES = {"one": ["a", "b"], "two": ["c"]}
PAIRS = {"between_one": ("one", "one"), "between_one_two": ("one", "two")}
SCHEMA = (
    "definition string, e string, boot int, cond string, w array<double>, "
    "arcs array<struct<src:int,dst:int>>, features array<string>"
)


def graphs(spark, rows):
    w = [float(10 * i + j) for i in range(3) for j in range(3)]
    return spark.createDataFrame([(d, e, b, c, w, arcs, FEATURES) for d, e, b, c, arcs in rows], SCHEMA)


def quartet(d, e, boot, base, other):
    """Stress graphs as given, and two equal reference graphs."""
    return [(d, e, boot, "no_stress", base), (d, e, boot, "stress", other), (d, e, boot, "a", base), (d, e, boot, "b", base)]


def stored(spark, path, rows, run, **more):
    study.store_graphs(graphs(spark, rows), path, run, entity="e")
    study.store_comparison(spark, path, run, entity="e", n_nodes=3, themes=THEMES, theme_pairs=PAIRS, **more)


def test_chain_of_tables(spark, tmp_path):
    rows = quartet("x", "p", 0, [(0, 1), (1, 2)], [(1, 0)]) + quartet("x", "p", 1, [(0, 1)], []) + quartet("y", "p", 0, [], [])
    rows += [("x", "q", 0, "stress", [(0, 2)])]  # no partner: no pair
    stored(spark, str(tmp_path), rows, {"boots": 2})
    kept = study.stored_graphs(spark, str(tmp_path), boots=2)
    assert kept.count() == len(rows)
    edge = kept.where("definition = 'x' and e = 'p' and boot = 0 and cond = 'no_stress'").first()["edges"]
    assert [(r.src, r.dst, r.weight) for r in edge] == [("a", "b", 1.0), ("b", "c", 12.0)]
    c = study.stored_comparison(spark, str(tmp_path), boots=2)
    got = {(r.definition, r.e, r.boot, r.label): (r.int_union, r.between_one, r.between_one_two, len(r.only_in_base)) for r in c.collect()}
    assert got == {
        ("x", "p", 0, "stress"): (0.5, 0, 1, 1), ("x", "p", 0, "reference"): (1.0, 0, 0, 0),
        ("x", "p", 1, "stress"): (0.0, 1, 0, 1), ("x", "p", 1, "reference"): (1.0, 0, 0, 0),
        ("y", "p", 0, "stress"): (0.0, 0, 0, 0), ("y", "p", 0, "reference"): (0.0, 0, 0, 0),
    }
    shares = study.summarised(study.stored_comparison(spark, str(tmp_path), boots=2, definition="x"), entity="e").collect()
    assert {(r.e, r.lo, r.hi): (r.percent_added, r.percent_removed) for r in shares} == {
        ("p", "a", "b"): (0.5, 0.0), ("p", "b", "c"): (0.5, 0.0)
    }


def test_rerun_replaces_its_own_definitions_only(spark, tmp_path):
    path = str(tmp_path)
    stored(spark, path, quartet("x", "p", 0, [(0, 1)], []) + quartet("y", "p", 0, [(0, 1)], []), {"boots": 1})
    stored(spark, path, quartet("x", "p", 0, [(0, 1)], []), {"boots": 2})
    stored(spark, path, quartet("x", "r", 0, [(0, 2)], [(0, 2)]), {"boots": 1})
    seen = {(r.boots, r.definition, r.e) for r in study.stored_comparison(spark, path).collect()}
    assert seen == {(1, "x", "r"), (1, "y", "p"), (2, "x", "p")}


def test_pairs_from_arrays_are_the_pairs_from_rows(spark):
    rows = quartet("x", "p", 0, [(0, 1), (1, 2)], [(1, 0), (0, 2)]) + quartet("x", "q", 0, [], [(2, 1)])
    g = graphs(spark, rows).withColumn("edges", F.transform("arcs", lambda e: F.struct(
        F.element_at("features", e.src + 1).alias("src"), F.element_at("features", e.dst + 1).alias("dst"), F.lit(1.0).alias("weight"))))
    g = g.withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")))  # no list is an empty one
    long = g.select("e", "boot", "cond", F.inline("edges"))
    want = gt.paired_edges(long, g.select("e", "boot", "cond"), ["e"])
    got = gt.paired_graphs(g, ["e"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_measures_over_bootstraps(spark, tmp_path):
    rows = []
    for b in range(6):  # stress graphs lose a to b in all and c in every other bootstrap
        rows += quartet("x", "p", b, [(0, 1), (1, 2)], [(1, 2)] if b % 2 else [])
    stored(spark, str(tmp_path), rows, {"boots": 6})
    tests = study.measure_tests(
        study.stored_comparison(spark, str(tmp_path), boots=6), ["int_union", *PAIRS], entity="e", method="t"
    )
    got = {r.measure: r for r in tests.collect()}
    assert got["int_union"].p_val < 0.01 and got["between_one_two"].direction == "Loss"
    assert "between_one" not in got  # the same in every bootstrap: no variance, no test
    assert got["between_one_two"].p_val == pytest.approx(0.0756, abs=1e-3)


def test_empty_search(spark, tmp_path):
    study.store_graphs(graphs(spark, []), str(tmp_path), {"boots": 1}, entity="e")
    compare = gt.compare_pairs(gt.paired_graphs(graphs(spark, []).withColumn(
        "edges", F.array().cast("array<struct<src:string,dst:string,weight:double>>")), ["definition", "e"]), ["definition", "e"], THEMES, PAIRS, 3)
    assert compare.count() == 0 and study.summarised(compare, entity="e").count() == 0
