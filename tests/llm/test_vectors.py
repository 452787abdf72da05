"""Exact top-k and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import maxscore, quantised

KIND = "vec_id long, embedding array<float>, score string, _id long"


def vectors(rng, n, d, copies=0):
    x = rng.standard_normal((n, d)).astype(np.float32) * 0.3
    x[n - copies :] = x[0]
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], KIND)


def inner(x, ids, k, every):
    whole = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def euclid(x, ids, k, every):
    x, out = x.astype(np.float64), []
    for i in np.flatnonzero(ids % every == 0):
        s = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(64, 8), (10_000, 10_000)])
def test_both_searches_are_exact(spark, monkeypatch, shard, block):
    rng = np.random.default_rng(1)
    x, ids = vectors(rng, 500, 12, copies=160), rng.permutation(2000)[:500]
    df = frame(spark, zip(ids.tolist(), x))
    monkeypatch.setattr(maxscore.grid.top_of_tiles, "__defaults__", (shard, block))
    monkeypatch.setattr(maxscore, "STRIDE", 32)
    monkeypatch.setattr(quantised, "STRIDE", 32)
    got = maxscore.search(df, F.col("_id") % 7 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == inner(x, ids, 5, 7)
    got = sorted(map(tuple, quantised.nearest(df, F.col("_id") % 7 == 0, k=5).collect()))
    want = euclid(x, ids, 5, 7)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.5, 0.5]),
    ]
    df = frame(spark, rows)
    top = maxscore.search(df, F.col("_id") == 0, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in top] == [(6, 128 * 256), (9, 128 * 256), (1, 0)]
    near = quantised.nearest(df, F.col("_id") == 0, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [6, 9]
    assert quantised.nearest(df, F.col("_id") == 1, k=5).count() == 0
    empty = df.filter("vec_id < 0")
    assert maxscore.search(empty, F.col("_id") == 0, k=5).count() == 0
    assert quantised.nearest(empty, F.col("_id") == 0, k=5).columns == ["query_id", "rank", "vec_id", "score"]


def test_repeated_ids_and_large_values(spark):
    df = frame(spark, [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0])])
    near = quantised.nearest(df, F.col("_id") == 0, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [1, 1, 2]
    assert maxscore.search(df, F.col("_id") == 1, k=3).count() == 2 * 2
    floor = maxscore.Postings(np.array([[3.0, -1.0], [-2.0, 5.0], [1.0, 1.0]]))
    at, score = floor.best(np.array([2.0, 1.0]), 3.0)
    assert dict(zip(at.tolist(), score.tolist())) == {0: 5.0, 2: 3.0}


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 9)) * rng.uniform(0.01, 100, (40, 1))
    steps, scale, rest = quantised.quantise(x)
    back = steps * scale[:, None]
    for i in range(40):
        true, near = np.linalg.norm(x - x[i], axis=1), np.linalg.norm(back - back[i], axis=1)
        assert (np.abs(true - near) <= rest + rest[i] + 1e-9).all()
