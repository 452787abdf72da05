"""Classifier tests with rounds and tests as keys."""

import hashlib
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayloom import session
from dayloom.functions import digests
from dayloom.operators import ccit, neighbours


@pytest.fixture(scope="module")
def cases(spark):
    """Chains x <- z -> y, planted links x -> y, and z with three values only."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        z, e, f = map(float, rng.normal(size=3))
        rows.append(("apart", i, z + 0.3 * e, z + 0.3 * f, z))
        rows.append(("linked", i, e, e + 0.3 * f, z))
        c = float(rng.integers(3))
        rows.append(("few values", i, c + 0.3 * e, c + 0.3 * f, c))
        rows.append(("constant", i, e, f, 1.0))
    rows += [("apart", 10_000, None, 1.0, 1.0), ("nulls", 1, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "test string, id int, x double, y double, z double")


def test_planted_dependence_is_found(cases):
    got = {r.test: r for r in ccit.classifier_tests(cases, "x", "y", ["z"], row_id="id", keys=["test"], rounds=12).collect()}
    assert set(got) == {"apart", "linked", "few values", "constant"}
    assert got["linked"].p_val < 1e-6 and got["linked"].gap > 0.15
    for name in ("apart", "few values", "constant"):
        assert got[name].p_val > 0.01, name
    assert all(0.18 * 12 * 700 < r.tested < 0.27 * 12 * 700 for r in got.values())


def test_one_table_is_one_test(cases):
    apart = cases.where("test = 'apart'")
    assert ccit.conditional_independence(apart, "x", "y", [], row_id="id", rounds=6) < 1e-6
    assert ccit.conditional_independence(apart, "x", "y", ["z"], row_id="id", rounds=6, alpha=0.01) is True
    assert ccit.conditional_independence(apart.limit(0), "x", "y", ["z"], row_id="id") is None


def test_keys_do_not_mix(cases):
    alone = ccit.classifier_tests(cases.where("test = 'linked'"), "x", "y", ["z"], row_id="id", rounds=4).first()
    among = ccit.classifier_tests(cases, "x", "y", ["z"], row_id="id", keys=["test"], rounds=4).where("test = 'linked'").first()
    assert (alone.tested, round(alone.gap, 12)) == (among.tested, round(among.gap, 12))


@pytest.mark.parametrize("bucket", [4, 1000])
def test_neighbours_come_from_the_bucket(spark, monkeypatch, bucket):
    monkeypatch.setattr(ccit, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    rows = [(k, f"r{i}", int(p), bool(i % 3), int(rng.integers(2**32)), 0.1, float(i), round(float(rng.choice([0.2, rng.random()])), 9))
            for k in range(2) for i, p in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "_k int, _id string, _part int, _test boolean, _deal long, _u0 double, _u1 double, _u2 double")
    df = df.withColumn("_fine", F.lit(3))
    got = ccit._swapped(df, ["_k"], ["_u0", "_u1", "_u2"], 1, 2).collect()
    assert sorted((r._k, r._id) for r in got) == sorted((r[0], r[1]) for r in rows if r[2] == 1)
    donors = {(r[0], r[6]): r[7] for r in rows if r[2] == 2}
    found = [r for r in got if (r._k, r._u1) in donors]  # the others met no donor and keep their y
    assert len(found) == len(got) if bucket == 1000 else len(found) > 0.9 * len(got)
    gaps = [abs(donors[r._k, r._u1] - r._u2) for r in found]
    assert np.mean(gaps) < (0.06 if bucket == 4 else 0.01)
    if bucket == 1000:  # a cell is searched whole: the nearest of its donors
        cell = lambda k, u: math.floor(u * 8 + ccit.shifts(2)[k, 0])
        for r in got:
            here = [abs(u - r._u2) for (k, _), u in donors.items() if k == r._k and cell(k, u) == cell(k, r._u2)]
            if here:
                assert abs(donors[r._k, r._u1] - r._u2) == pytest.approx(min(here))
        alike = [r._u1 for r in got if r._u2 == 0.2 and r._k == 0]
        assert len(set(alike)) > len(alike) / 3  # rows of one z do not all take the same donor


def test_rounds_in_turns_equal_rounds_at_once(spark, monkeypatch):
    """A turn's rows are removed before the next, and the sums are the same."""
    rows = [(str(i), float(i * 7 % 31), float(i * i % 17), float(i % 5)) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double")
    kept, tables, got = session.passing_table, [], []
    monkeypatch.setattr(ccit, "passing_table", lambda d, n: tables.append(n) or kept(d, n))
    for bound in (1 << 23, 240 * 4):
        monkeypatch.setattr(ccit, "TOGETHER", bound)
        r = ccit.classifier_tests(df, "x", "y", ["z"], row_id="id", rounds=10, trees=8, depth=3).first()
        got.append((r["tested"], round(r["gap"], 9), round(r["p_val"], 9)))
    assert got[0] == got[1] and len(tables) == 3
    with kept(df, "gone") as table:
        path = table.inputFiles()[0].removeprefix("file:")
        assert Path(path).exists() and table.count() == 240
    assert not Path(path).exists()


@pytest.mark.parametrize("width", [0, 1, 2, 4])
def test_one_table_in_arrays_equals_tests_by_key(spark, monkeypatch, width):
    """Same rows tested and same gap as by joins, with cells that hold no donor, rows that come
    twice and numbers without bound; what is shuffled are blocks of rows."""
    monkeypatch.setattr(ccit, "BUCKET", 3)
    rng = np.random.default_rng(width)
    rows = []
    for i in range(900):
        z = [float(rng.choice([0.0, rng.normal(), 50.0 + i])) for _ in range(4)]
        rows.append((f"r{i}é" if i % 9 else "long" * 20 + str(i), float(rng.normal()), z[0] + float(rng.normal()), *z))
    rows += rows[:40] + [("wide", math.inf, 1.0, 1.0, math.inf, 0.0, 0.0), ("none", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double, a double, b double, c double, d double").withColumn("one", F.lit(1))
    z, options, dealt, kept = ["a", "b", "c", "d"][:width], {"row_id": "id", "rounds": 3, "trees": 9, "depth": 3}, [], neighbours._placed
    by_key = ccit.classifier_tests(df, "x", "y", z, keys=["one"], **options).first()
    monkeypatch.setattr(neighbours, "_placed", lambda *a: dealt.append(kept(*a)) or dealt[-1])
    whole = ccit.classifier_tests(df, "x", "y", z, **options).first()
    assert (whole.tested, round(whole.gap, 9), round(whole.p_val, 9)) == (by_key.tested, round(by_key.gap, 9), round(by_key.p_val, 9))
    assert len(dealt) == 1 and set(dealt[0].columns) == {"_task", "_rows"}


def test_only_cells_that_may_be_asked_are_reached():
    cells = neighbours.Cells(range(2, 4), [5, 2, 0], ccit.shifts(5)[:, :2])
    rng = np.random.default_rng(4)
    gives, asks = [list(np.round(rng.random((2, n)) ** 3, 9)) for n in (60, 400)]
    full, asked = (np.zeros(cells.size * 2, np.int64) for _ in range(2))
    for k in cells.some:
        for i in range(3):
            np.add.at(full, cells.of(gives, k, i), 1)
        np.add.at(asked, cells.of(asks, k, 0), 1)
    reached = cells.reached(full, asked)
    for k in cells.some:
        left = np.arange(400)
        for i in range(3):
            at = cells.of([x[left] for x in asks], k, i)
            assert reached[at].all()
            left = left[full[at] == 0]
        assert not len(left)
    finest = np.concatenate([np.arange(cells.starts[1]) + r * cells.size for r in range(2)])
    assert reached[finest].all() and not reached.all()
    assert cells.reached(full, np.zeros_like(asked)).sum() == len(finest)


def test_md5_of_many_keys():
    keys = [b"", b"x" * 39, b"x" * 40, b"y" * 55, b"y" * 56, b"z" * 200, *[b"%d|2024-01-01" % i for i in range(300)]]
    for got, ending in ((digests.md5_words(keys), b""), (digests.Prefixes(keys).words(b"|12|ccit"), b"|12|ccit")):
        assert got.T.astype(">u4").tobytes() == b"".join(hashlib.md5(k + ending).digest() for k in keys)
    column = pa.array([k.decode() for k in keys])
    for some in (column, column[3:20], column[:0]):
        got = digests.Prefixes(some).words(b"|3|s")
        assert got.T.astype(">u4").tobytes() == b"".join(hashlib.md5(k.encode() + b"|3|s").digest() for k in some.to_pylist())
    assert digests.md5_words([]).shape == (4, 0)
    at = np.arange(3 * len(keys))
    both = digests.paired_words(keys, [b"", b"|1", b"|23|ccit"], at // 3, at % 3)
    assert both.T.astype(">u4").tobytes() == b"".join(hashlib.md5(k + e).digest() for k in keys for e in (b"", b"|1", b"|23|ccit"))
