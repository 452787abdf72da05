"""Graph search on planted structure and graph tables on hand-made edges."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import tails
from dayloom.operators import graph_draws, graph_search as gs, graph_tables as gt

K = {"entity": "e", "date": "date"}


def matrix_rows(spark, samples):
    """One graph row per sample matrix."""
    rows = []
    for i, x in enumerate(samples):
        c = np.corrcoef(x, rowvar=False).ravel()
        rows.append((f"g{i}", 0, "a", len(x), [float(v) for v in c], list(range(x.shape[1])), gs._critical(len(x), 0.05)))
    return spark.createDataFrame(
        rows, "e string, boot int, cond string, n long, c array<double>, usable array<int>, limit double"
    ).withColumn("w", F.col("c"))


def direct_search(x, alpha=0.05, deepest=2):
    """Order-independent search with regression residuals."""
    n, p = x.shape
    x = x - x.mean(0)

    def independent(a, b, z):
        u, v = x[:, a], x[:, b]
        if z:
            m = x[:, list(z)]
            u = u - m @ np.linalg.lstsq(m, u, rcond=None)[0]
            v = v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
        r = np.corrcoef(u, v)[0, 1]
        return tails.t_two_sided([r * math.sqrt((n - 2) / (1 - r * r))], [n - 2])[0] >= alpha

    adj = {i: set(range(p)) - {i} for i in range(p)}
    for size in range(deepest + 1):
        frozen = {k: set(v) for k, v in adj.items()}
        for a, b in itertools.combinations(range(p), 2):
            if b in frozen[a]:
                sets = itertools.chain(
                    itertools.combinations(sorted(frozen[a] - {b}), size), itertools.combinations(sorted(frozen[b] - {a}), size)
                )
                if any(independent(a, b, z) for z in sets):
                    adj[a].discard(b)
                    adj[b].discard(a)
    return {(a, b) for a in adj for b in adj[a] if a < b}


def linear_samples(k, n=120, p=6, seed=0):
    rng = np.random.default_rng(seed)
    for _ in range(k):
        w = np.triu(rng.normal(size=(p, p)) * (rng.uniform(size=(p, p)) < 0.4), 1)
        yield rng.normal(size=(n, p)) @ np.linalg.inv(np.eye(p) - w)


def test_skeletons_equal_a_direct_search(spark):
    samples = list(linear_samples(25))
    names = [f"f{i}" for i in range(6)]
    out = gs.skeleton(matrix_rows(spark, samples), names).collect()
    got = {r["e"]: {(e["i"], e["j"]) for e in r["edges"]} for r in out}
    for i, x in enumerate(samples):
        assert got[f"g{i}"] == direct_search(x), i


def arcs_of(spark, x, names):
    out = gs.directed(gs.skeleton(matrix_rows(spark, [x]), names)).first()
    return {(names[a["src"]], names[a["dst"]]) for a in out["arcs"]}


def test_chain_collider_and_noise(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(3, 500))
    names = ["x", "y", "z"]
    chain = arcs_of(spark, np.column_stack([a, a + 0.5 * b, a + 0.5 * b + 0.5 * c]), names)
    assert {frozenset(e) for e in chain} == {frozenset("xy"), frozenset("yz")}
    assert chain != {("x", "y"), ("z", "y")}
    collider = arcs_of(spark, np.column_stack([a, a + c + 0.3 * b, c]), names)
    assert collider == {("x", "y"), ("z", "y")}


def test_null_pairs_are_rejected_at_the_level(spark):
    rng = np.random.default_rng(3)
    rows = matrix_rows(spark, [rng.normal(size=(40, 2)) for _ in range(600)])
    hits = sum(len(r["edges"]) for r in gs.skeleton(rows, ["x", "y"]).collect())
    assert 0.02 < hits / 600 < 0.08


def acyclic(p, arcs):
    out = {i: {b for a, b in arcs if a == i} for i in range(p)}
    left = set(range(p))
    while left:
        free = {v for v in left if not out[v] & left}
        if not free:
            return False
        left -= free
    return True


def test_orientation_keeps_every_edge_once():
    rng = np.random.default_rng(8)
    for _ in range(300):
        p = int(rng.integers(3, 8))
        pairs = [(i, j) for i in range(p) for j in range(i + 1, p) if rng.uniform() < 0.5]
        cut = {(i, j): {int(k) for k in range(p) if k not in (i, j) and rng.uniform() < 0.4}
               for i in range(p) for j in range(i + 1, p) if (i, j) not in pairs}
        arcs = gs.orient(pairs, cut)
        assert sorted((min(a), max(a)) for a in arcs) == pairs


def test_colliders_that_disagree_lose_no_edge():
    assert len(gs.orient([(0, 1), (1, 2), (2, 3)], {})) == 3


def test_extension_orients_a_tree_without_new_colliders():
    pairs = [(0, 1), (1, 2), (2, 3)]
    cut = {(0, 2): {1}, (0, 3): {1}, (1, 3): {2}}
    arcs = gs.orient(pairs, cut)
    heads = [b for _, b in arcs]
    assert len(arcs) == 3 and len(set(heads)) == 3 and acyclic(4, arcs)


def test_propagation_away_from_a_collider():
    # 0 -> 2 <- 1 and 2 - 3: the last edge must leave node 2
    arcs = gs.orient([(0, 2), (1, 2), (2, 3)], {(0, 1): set(), (0, 3): {2}, (1, 3): {2}})
    assert set(arcs) == {(0, 2), (1, 2), (2, 3)}


def test_whole_search_finds_planted_edges(make_panel):
    rng = np.random.default_rng(4)
    rows = []
    for e in ("p", "q"):
        x = rng.normal(size=160)
        y = x + 0.2 * rng.normal(size=160)
        z = rng.normal(size=160)
        lab = rng.integers(0, 2, size=160)
        rows += [(e, i, float(x[i]), float(y[i]), float(z[i]), int(lab[i])) for i in range(160)]
    df = make_panel(rows, "x double, y double, z double, lab int")
    label = lambda d: d.withColumn("label", F.col("lab"))
    g = gs.graph_rows(df, ["x", "y", "z"], label, **K, boots=2).collect()
    assert len(g) == 2 * 2 * 4 and {r["cond"] for r in g} == {"a", "b", "stress", "no_stress"}
    for r in g:
        assert (0, 1) in {(e["i"], e["j"]) for e in r["edges"]}
    sizes = {(r["e"], r["boot"]): set() for r in g}
    for r in g:
        sizes[r["e"], r["boot"]].add(r["n"])
    assert all(len(s) == 1 for s in sizes.values())


def test_result_does_not_depend_on_the_partitioning(spark, make_panel):
    rng = np.random.default_rng(6)
    df = make_panel([(e, i, *map(float, rng.normal(size=3)), int(rng.integers(0, 2))) for e in "pqr" for i in range(60)], "x double, y double, z double, lab int")
    label = lambda d: d.withColumn("label", F.col("lab"))

    def run():
        rows = gs.graph_rows(df, ["x", "y", "z"], label, **K, boots=2, min_rows=5)
        return sorted((r["e"], r["boot"], r["cond"], r["n"], str(r["arcs"])) for r in rows.collect())

    width = spark.conf.get("spark.sql.shuffle.partitions")
    first = run()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


# ------------------------------------------------------------------ graph tables

EDGES = "e string, boot int, cond string, src string, dst string, weight double"
THEMES = {"phys": ["a", "b"], "mental": ["b", "c"]}
PAIRS = {"phys": ("phys", "phys"), "cross": ("phys", "mental")}


def compare(spark, edges, graphs, n=4):
    e = spark.createDataFrame(edges, EDGES)
    g = spark.createDataFrame(graphs, "e string, boot int, cond string")
    return gt.compare_pairs(gt.paired_edges(e, g, ["e"]), ["e"], THEMES, PAIRS, n)


def test_comparison_measures(spark):
    edges = [("p", 0, "no_stress", "a", "b", 0.5), ("p", 0, "no_stress", "b", "c", 0.2), ("p", 0, "stress", "b", "a", 0.9)]
    r = compare(spark, edges, [("p", 0, "stress"), ("p", 0, "no_stress")]).first()
    assert r["int_union"] == 0.5 and r["phys"] == 0 and r["cross"] == 1
    assert [tuple(x) for x in r["only_in_base"]] == [("b", "c")] and r["only_in_other"] == []
    assert [(tuple(k), round(v, 9)) for k, v in r["weight_diffs"].items()] == [(("a", "b"), -0.4)]
    # a -> b -> c joins three ordered pairs, b -> a one, of twelve
    assert r["difference"] == pytest.approx(math.log(3 / 12) - math.log(1 / 12))


def test_empty_graphs(spark):
    graphs = [("p", 0, "a"), ("p", 0, "b"), ("q", 0, "a"), ("q", 0, "b"), ("r", 0, "a")]
    rows = {r["e"]: r for r in compare(spark, [("q", 0, "a", "a", "b", 1.0)], graphs).collect()}
    assert set(rows) == {"p", "q"}
    assert rows["p"]["int_union"] == 0.0 and rows["p"]["difference"] is None
    assert rows["q"]["difference"] == -math.inf


def test_disjoint_paths_against_path_sets():
    rng = np.random.default_rng(1)

    def brute(out, s, t):
        paths = []

        def walk(v, seen):
            for u in out[v]:
                if u == t:
                    paths.append(frozenset(seen - {s}))
                elif u not in seen:
                    walk(u, seen | {u})

        walk(s, {s})
        best = 0
        for k in range(len(paths), 0, -1):
            if k > best and any(
                all(not (a & b) for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(paths, k)
            ):
                best = k
        return best

    for _ in range(40):
        p = 5
        out = [[j for j in range(p) if j > i and rng.uniform() < 0.5] for i in range(p)]
        for s, t in itertools.permutations(range(p), 2):
            assert gt._disjoint_paths(out, s, t) == brute(out, s, t)


def test_edge_summary_keeps_zeros(spark):
    edges = [("p", 0, "no_stress", "a", "b", 0.5), ("q", 0, "stress", "c", "b", 0.2)]
    graphs = [(e, 0, c) for e in "pq" for c in ("stress", "no_stress")]
    c = compare(spark, edges, graphs)
    who = spark.createDataFrame([("p",), ("q",)], "e string")
    got = {(r["e"], r["lo"], r["hi"]): (r["percent_added"], r["percent_removed"]) for r in gt.edge_summary(c, who, entity="e", boots=1).collect()}
    assert got == {("p", "a", "b"): (1, 0), ("p", "b", "c"): (0, 0), ("q", "a", "b"): (0, 0), ("q", "b", "c"): (0, 1)}


def test_bootstraps_of_a_longer_history(spark, tmp_path):
    from dayloom.plans import catalogue, fixtures as fx

    kinds, rows = fx.TYPES, []
    for day in range(63):
        # inside every day: click to view on all days, and click to error on even days of the month only
        for user in (1, 2):
            for i, kind in enumerate(("click", "view", "click", "error") if (day + 1) % 2 else ("click", "view")):
                rows.append((len(rows), user, day, i, kind, float(day % 5 + i)))
    assert {r[4] for r in rows} <= set(kinds)
    df = spark.createDataFrame(rows, "event_id long, user_id long, d int, i int, event_type string, value double")
    ts = F.expr("timestamp'2024-01-05 06:00:00' + make_interval(0, 0, 0, d, i)")
    df.withColumn("ts", ts).drop("d", "i").write.parquet(f"{tmp_path}/events.parquet")
    assert fx.bootstraps(spark, str(tmp_path)) == 7
    assert sorted(r.boot for r in fx.edges(spark, str(tmp_path)).select("boot").distinct().collect()) == list(range(7))
    shares = catalogue.QUERIES["C08_edge_shares"](spark, str(tmp_path)).collect()
    assert shares and all(0 <= r.percent_added <= 1 and 0 <= r.percent_removed <= 1 for r in shares)
    kept = {(r.user_id, r.lo, r.hi) for r in catalogue.QUERIES["ST14_weight_change"](spark, str(tmp_path)).collect()}
    assert {(u, "click", "view") for u in (1, 2)} <= kept


def test_short_panels_end_before_the_bootstraps(make_panel):
    """Panels that no draw can use are not repeated per bootstrap, and no sample changes."""
    labels = {
        "many": [0, 1] * 12,  # runs of one day
        "runs": [0] * 7 + [1] * 3 + [0] * 2 + [2] * 9 + [None] * 3 + [0] * 8 + [1] * 6,  # 3 + 1 + 4 and 1 + 4 + 2 rows or so
        "short": [0, 1] * 3,
        "calm": [0] * 40 + [1],
    }
    rows = [(e, d, y, float(d * d % 7)) for e, ys in labels.items() for d, y in enumerate(ys)]
    days = make_panel(rows, "label int, x double")
    options = {"limit": 3, "boots": 4, "seed": "s", **K}
    whole, gated = (gs.sample_pool(days, ["x"], at_least=n, **options) for n in (0, 6))
    drawn = [sorted(map(tuple, gs.draw_samples(p, min_rows=6, seed="s", **K).select("e", "date", "boot", "cond", "x").collect())) for p in (whole, gated)]
    assert drawn[0] == drawn[1] and {r[0] for r in drawn[0]} == {"many", "runs"}
    assert {r[0] for r in gated.select("e").distinct().collect()} == {"many", "runs"}


def test_correlations_of_many_samples_at_once():
    """Samples of any lengths, among them constant and unknown columns, as one by one."""
    rng = np.random.default_rng(3)
    samples = [rng.normal(size=(n, 3)) for n in (10, 12, 10, 11)]
    samples[2][:, 1] = 4.0
    samples[3][0, 0] = np.nan
    got = gs.correlations([x.ravel() for x in samples], 3)
    for x, c in zip(samples, got):
        with np.errstate(all="ignore"):
            assert np.allclose(c.reshape(3, 3), np.corrcoef(x, rowvar=False), equal_nan=True)


@pytest.fixture(scope="module")
def odd_days(spark):
    """Panels with long runs, unknown labels, a missing feature, few days, and no name."""
    rng, rows = np.random.default_rng(11), []
    for e, n in (("a", 60), ("b", 45), (None, 50), ("short", 9), ("x" * 60, 48)):
        label = np.repeat(rng.integers(0, 3, n), rng.integers(1, 8, n))[:n]
        for d in range(n):
            x, z = rng.normal(size=2)
            rows.append((e, d, None if d % 17 == 3 else float(label[d]), float(x), float(x + z), None if e == "b" else float(z)))
    df = spark.createDataFrame(rows, "e string, d int, label double, x double, y double, z double")
    days = df.withColumn("date", F.expr("date_add(date'2024-01-01', d)")).drop("d")
    return days.withColumn("definition", F.explode(F.array(F.lit("one"), F.lit("two"))))


def test_draws_in_arrays_are_the_draws_of_columns(odd_days):
    features, group, options = ["x", "y", "z"], ["definition"], {"limit": 3, "boots": 6, "seed": "s"}
    pool = gs.sample_pool(odd_days, features, at_least=5, group=group, **options, **K)
    samples = gs.draw_samples(pool, min_rows=5, seed="s", group=group, **K)
    more = {"sigma": 0.01, "extra": ["s", "x"], "group": group, **K}
    a = gs.correlation_rows(samples, features, seed="s", **more)
    b = graph_draws.drawn_correlations(odd_days, features, min_rows=5, **options, **more)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    keyed = lambda rows: {(r.definition, r.e, r.boot, r.cond): r for r in rows}
    a, b = keyed(a.collect()), keyed(b.collect())
    assert a.keys() == b.keys() and {k[1] for k in a} == {"a", "b", None, "x" * 60} and len(a) == 2 * 4 * 6 * 4
    for k, r in a.items():
        assert r.n == b[k].n >= 5
        for c in ("c", "w", "s"):
            np.testing.assert_allclose(np.array(r[c], float), np.array(b[k][c], float), atol=1e-9)
        rows = [sorted(map(tuple, np.nan_to_num(np.array(x, float)).reshape(-1, 3))) for x in (r.x, b[k].x)]
        np.testing.assert_allclose(*rows, atol=1e-12)


def test_a_panel_arrives_once_whatever_the_bootstraps(odd_days):
    plan = lambda boots: graph_draws.drawn_correlations(
        odd_days, ["x", "y"], limit=3, boots=boots, min_rows=5, sigma=0.01, seed="s", **K
    )._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0" not in plan(100) and "FlatMapGroupsInArrow" in plan(100)


def test_search_of_a_batch_is_the_search_of_each_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 14, 5))
    x[:, :, 1:] += rng.random((40, 1, 4)) * 2 * x[:, :, :-1]
    c, limit, usable = graph_draws.matrices(x), rng.uniform(0.2, 0.6, 40), rng.random((40, 5)) < 0.9
    c[3, 0, 1] = c[3, 1, 0] = np.nan  # above every limit
    usable[3] = True
    left, gone = gs.searched(c, limit, usable, 2)
    assert left[3, 0, 1] or any(tuple(r[:3]) == (3, 0, 1) for r in gone)
    for i in range(40):
        alone, cut = gs.searched(c[i : i + 1], limit[i : i + 1], usable[i : i + 1], 2)
        assert (alone[0] == left[i]).all() and (cut[:, 1:] == gone[gone[:, 0] == i][:, 1:]).all()
    rows = [(i, c[i].ravel().tolist(), float(limit[i]), np.flatnonzero(usable[i]).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, c array<double>, limit double, usable array<int>").drop("nothing")
    one, two = gs.directed(gs.skeleton(df, list("abcde"))), gs.directed_skeletons(df, list("abcde"))
    assert one.columns == two.columns
    assert [str(r) for r in one.orderBy("id").collect()] == [str(r) for r in two.orderBy("id").collect()]


def test_entities_that_give_no_draws_are_not_scaled(odd_days, monkeypatch):
    days = odd_days.where("definition = 'one'").withColumnRenamed("label", "lab").drop("definition")
    calm = days.withColumn("e", F.lit("calm")).where("lab = 0")
    scaled, kept = [], gs.panel.z_score
    monkeypatch.setattr(gs.panel, "z_score", lambda df, *a, **k: scaled.append(df) or kept(df, *a, **k))
    label = lambda df: df.withColumn("label", F.col("lab"))
    rows = gs.discover(days.unionByName(calm), {"one": (["x", "y"], label), "none": (["x"], lambda d: d.withColumn("label", F.lit(0)))},
                       boots=2, min_rows=5, **K)
    found = {(r.definition, r.e) for r in rows.select("definition", "e").distinct().collect()}
    assert found == {("one", e) for e in ("a", "b", None, "x" * 60)}
    assert {r.e for r in scaled[0].select("e").distinct().collect()} == {"a", "b", None, "x" * 60}
