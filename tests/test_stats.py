"""Statistics against direct computation."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import tails
from dayloom.operators import inference, ordered, spectrum, twosample


def ks_by_enumeration(d, m, n):
    """Share of all interleavings whose gap is at least d."""
    hit = total = 0
    for where in itertools.combinations(range(m + n), m):
        a = b = 0
        worst, chosen = 0.0, set(where)
        for i in range(m + n):
            if i in chosen:
                a += 1
            else:
                b += 1
            worst = max(worst, abs(a / m - b / n))
        total += 1
        hit += worst >= d - 1e-12
    return hit / total


@pytest.mark.parametrize("m,n", [(5, 5), (4, 6), (3, 7), (6, 4), (1, 5)])
def test_ks_tail_by_full_enumeration(m, n):
    for i in range(1, m * n + 1):
        d = i / (m * n)
        if d * math.lcm(m, n) % 1 < 1e-9:
            assert tails.ks_two_sided(d, m, n) == pytest.approx(ks_by_enumeration(d, m, n), abs=1e-12)


def ks_by_fractions(d, m, n):
    """Share of the lattice paths that leave the band, counted in whole numbers."""
    inside = {(0, 0): 1}
    for i in range(m + 1):
        for j in range(n + 1):
            if (i, j) != (0, 0):
                stays = abs(Fraction(i, m) - Fraction(j, n)) < d
                inside[i, j] = inside.get((i - 1, j), 0) + inside.get((i, j - 1), 0) if stays else 0
    return float(1 - Fraction(inside[m, n], math.comb(m + n, m)))


@pytest.mark.parametrize("m,n", [(60, 50), (50, 60), (41, 80), (1, 90)])
def test_small_ks_tails_keep_their_digits(m, n):
    lcm = math.lcm(m, n)
    for share in (0.2, 0.5, 0.8, 0.95, 1.0):
        d = Fraction(round(share * lcm / (lcm // max(m, n))) * (lcm // max(m, n)), lcm)
        assert tails.ks_two_sided(float(d), m, n) == pytest.approx(ks_by_fractions(d, m, n), rel=1e-11)


def test_ks_p_value_takes_its_method(spark):
    rows = [(0.5, 10, 12), (0.5, 10, 12), (None, 10, 12), (0.5, 0, 12), (0.75, 8, 8)]
    df = spark.createDataFrame(rows, "d double, m long, n long").coalesce(1)
    for method in ("exact", "series"):
        got = [r["p"] for r in df.select(tails.ks_p_value(F.col("d"), F.col("m"), F.col("n"), method).alias("p")).collect()]
        want = [None if d is None or m < 1 else tails.ks_two_sided(d, m, n, method) for d, m, n in rows]
        assert got == [None if w is None else pytest.approx(w) for w in want]


def _integral(f, a, b, n=20000):
    x = np.linspace(a, b, n + 1)
    w = np.where(np.arange(n + 1) % 2 == 1, 4, 2.0)
    w[0] = w[-1] = 1
    return (w * f(x)).sum() * (b - a) / n / 3


@pytest.mark.parametrize("t,df", [(0.0, 3), (1.0, 5), (2.5, 30), (4.0, 2.7), (12.0, 1.5), (0.3, 200)])
def test_t_tail_by_integration(t, df):
    f = lambda s: np.sin(s**4) ** (df - 1) * 4 * s**3
    want = _integral(f, 0, math.atan2(math.sqrt(df), t) ** 0.25) / _integral(f, 0, (math.pi / 2) ** 0.25)
    assert tails.t_two_sided([t], [df])[0] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("x,k", [(0.5, 1), (3.84, 1), (10.0, 4), (30.0, 20), (0.0, 3)])
def test_chi2_tail_by_integration(x, k):
    f = lambda u: u ** (k - 1.0) * np.exp(-u * u / 2)
    want = _integral(f, math.sqrt(x), 40) / _integral(f, 0, 40)
    assert tails.chi2_tail([x], [k])[0] == pytest.approx(want, abs=1e-9)


def _two_groups(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g, size in (("big", n), ("small", 12), ("ties", 60)):
        for i in range(size):
            v = rng.normal() if g != "ties" else float(rng.integers(0, 4))
            rows.append((g, "x" if i % 3 else "y", float(v)))
    return rows, spark.createDataFrame(rows, "g string, s string, v double")


def test_ks_statistic_in_blocks_equals_plain_and_brute_force(spark):
    rows, df = _two_groups(spark)
    plain = {r["g"]: r["d"] for r in twosample.ks_statistic(df, "v", "s", ["g"]).collect()}
    cut = {r["g"]: r["d"] for r in twosample.ks_statistic(df, "v", "s", ["g"], block_rows=20).collect()}
    for g in plain:
        x = np.sort([v for k, s, v in rows if k == g and s == "x"])
        y = np.sort([v for k, s, v in rows if k == g and s == "y"])
        at = np.concatenate([x, y])
        want = np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max()
        assert plain[g] == pytest.approx(want) and cut[g] == pytest.approx(want)


def _bh(p):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    out = np.empty(len(p))
    out[order] = q
    return out


@pytest.mark.parametrize("block_rows", [ordered.BLOCK_ROWS, 25])
def test_benjamini_hochberg(spark, block_rows):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.uniform(size=300) ** 3, "one": np.array([0.03]), "ties": rng.choice([0.01, 0.2, 0.9], 40)}
    rows = [(g, i, float(p)) for g, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    out = inference.benjamini_hochberg(df, "p", ["g"], block_rows=block_rows).collect()
    assert len(out) == len(rows)
    for g, ps in groups.items():
        want = _bh(ps)
        for r in (r for r in out if r["g"] == g):
            assert r["p_value_fdr"] == pytest.approx(want[r["i"]])
            assert r["reject_fdr"] == int(want[r["i"]] <= 0.1)


def test_bonferroni_is_not_capped(spark):
    df = spark.createDataFrame([("m", 0.01), ("m", 0.4), ("m", 0.9)], "g string, p double")
    got = {r["p"]: (r["p_value_bc"], r["reject_bc"]) for r in inference.bonferroni(df, "p", ["g"]).collect()}
    assert got[0.9][0] == pytest.approx(2.7) and got[0.01][1] == 1 and got[0.4][1] == 0


def _vectors(spark, n=150, dim=5):
    rng = np.random.default_rng(2)
    rows = [(i, "x" if rng.uniform() < 0.4 else "y", [float(v) for v in rng.normal(size=dim) + (i % 2)]) for i in range(n)]
    x = np.array([v for _, s, v in rows if s == "x"])
    y = np.array([v for _, s, v in rows if s == "y"])
    return x, y, spark.createDataFrame(rows, "id long, s string, v array<double>").repartition(3)


def test_kernel_discrepancies(spark):
    x, y, df = _vectors(spark)

    def brute(k):
        return k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean()

    rbf = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(-1))
    got = twosample.mmd_rbf(df, "v", "s", gamma=0.3, block_rows=16).first()["mmd"]
    assert got == pytest.approx(brute(rbf), abs=1e-10)
    for degree in (1, 2, 3):
        poly = lambda a, b: (0.5 * a @ b.T + 2) ** degree
        got = twosample.mmd_poly(df, "v", "s", degree=degree, gamma=0.5, coef0=2).first()["mmd"]
        assert got == pytest.approx(brute(poly), rel=1e-9)
    assert twosample.mmd_linear(df, "v", "s").first()["mmd"] == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum())


def test_gaussian_kernel_with_copies_and_gaps(spark):
    x, y, df = _vectors(spark, n=60)
    copies = [(1000 + i, "x", [float(v) for v in x[0]]) for i in range(500)]
    odd = [(2000, "x", None), (2001, "z", [0.0] * 5), (2002, None, [0.0] * 5)]
    more = df.unionByName(spark.createDataFrame(copies + odd, df.schema))
    big = np.concatenate([x, np.repeat(x[:1], 500, 0)])
    rbf = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1))
    want = rbf(big, big).mean() + rbf(y, y).mean() - 2 * rbf(big, y).mean()
    assert twosample.mmd_rbf(more, "v", "s", block_rows=8).first()["mmd"] == pytest.approx(want, abs=1e-10)
    keyed = more.withColumn("g", F.lit(None).cast("long")).unionByName(df.where("s = 'x'").withColumn("g", F.lit(1).cast("long")))
    got = {r["g"]: r["mmd"] for r in twosample.mmd_rbf(keyed, "v", "s", ["g"], block_rows=8).collect()}
    assert got == {None: pytest.approx(want, abs=1e-10), 1: None}
    assert twosample.mmd_rbf(df.limit(0), "v", "s").first()["mmd"] is None


def test_kernels_by_group(spark):
    x, y, df = _vectors(spark)
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    whole = twosample.mmd_rbf(df, "v", "s", block_rows=32).first()["mmd"]
    for r in twosample.mmd_rbf(two, "v", "s", ["g"], block_rows=32).collect():
        assert r["mmd"] == pytest.approx(whole)
    whole = twosample.mmd_poly(df, "v", "s").first()["mmd"]
    for r in twosample.mmd_poly(two, "v", "s", ["g"]).collect():
        assert r["mmd"] == pytest.approx(whole)


def test_period_of_a_sine(make_panel):
    df = make_panel([("p", i, 2 + math.sin(2 * math.pi * i / 14)) for i in range(70)], "x double")
    s = spectrum.signals(df, ["x"], entity="e", date="date").select(
        spectrum.dominant_period("peak").alias("peak"), spectrum.dominant_period("half").alias("half"),
        spectrum.dominant_period("cutoff").alias("cutoff"),
    ).first()
    assert s["peak"] == math.inf and s["half"] == pytest.approx(14) and s["cutoff"] == pytest.approx(14)


def test_compat_period_is_one_place_off(make_panel):
    df = make_panel([("p", i, 1e-6 + math.sin(2 * math.pi * (i + 0.5) / 14)) for i in range(70)], "x double")
    s = spectrum.signals(df, ["x"], entity="e", date="date").select(spectrum.dominant_period("half", compat=True).alias("p")).first()
    assert s["p"] == pytest.approx(70 / 6)


def test_signal_without_values_has_no_period(make_panel):
    df = make_panel([("p", i, 0.0) for i in range(5)], "x double")
    s = spectrum.signals(df, ["x"], entity="e", date="date")
    row = s.select("n", *[spectrum.dominant_period(k, c).alias(f"{k}{c}") for k in ("peak", "half", "cutoff") for c in (False, True)]).first()
    assert row["n"] == 0 and all(v is None for v in tuple(row)[1:])


def test_dense_codes_cover_all_keys(spark):
    df = spark.createDataFrame([(f"id{i % 50}",) for i in range(200)] + [(None,)], "k string")
    out = ordered.dense_codes(df, "k", "c")
    codes = {r["k"]: r["c"] for r in out.collect()}
    assert out.count() == 201 and codes.pop(None) == -1 and sorted(codes.values()) == list(range(50))


def test_next_in_order_crosses_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else "cold", int(t), i, float(i)) for i, t in enumerate(rng.integers(0, 1000, 300))]
    df = spark.createDataFrame(rows, "e string, t int, i int, v double")
    out = ordered.next_in_order(df, entity="e", block=F.floor(F.col("t") / 50), order=["t", "i"], values=["v"])
    got = {r["i"]: r["next_v"] for r in out.collect()}
    for e in ("hot", "cold"):
        seq = sorted((t, i) for k, t, i, _ in rows if k == e)
        for (_, i), nxt in zip(seq, seq[1:] + [None]):
            assert got[i] == (None if nxt is None else float(nxt[1]))


def test_viability_counts(spark):
    rows = [("p", d, "m", r, s) for d, r, s in (("a", 1, "Gain"), ("b", 0, "Loss"), ("c", 1, "Loss"))]
    df = spark.createDataFrame(rows, "e string, definition string, measure string, reject_fdr int, direction string")
    r = inference.viability(df, entity="e").first()
    assert (r["number_rejected"], r["number_gained"], r["number_lost"]) == (2, 1, 1)
    assert r["definitions"] == ["a", "c"] and r["directions"] == ["Gain", "Loss"]


def test_chi2_of_a_single_row_table(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "v")], "x string, y string")
    r = twosample.chi2_test(df, "x", "y").first()
    assert r["chi2"] == 0.0 and r["p_val"] == 1.0
