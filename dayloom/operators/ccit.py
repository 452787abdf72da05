"""Classifier test of conditional independence (Sen et al. 2017), many tests at once.

A round deals the rows into three parts by hash. The first stays as it is; a row of the
second takes its ``y`` from the nearest row in ``z`` of the third. If a classifier cannot
tell first and second part apart, x and y are independent given z.

Rounds and tests are keys, not loops. Neighbours meet in a locality-sensitive bucket join:
z is cut into cells, finer the more rows a test has, shifted by another offset in every
round; a row asks in the finest cell that holds a donor and takes the nearest of a bucket.
Buckets hold about ``BUCKET`` donors: fuller cells are dealt by hash, so rows of equal z
never meet in one task. The classifier is a forest of random splits: a tree sends a row to
one of ``2 ** depth`` leaves by fixed cuts of columns, sums and differences, so that training is one count by leaf for all
rounds, and scoring the mean over a row's leaves. Rounds of a large table come in turns of
about ``TOGETHER`` rows; what a turn wrote is removed before the next, only sums are kept. A table
that is one test does the same in arrays (``neighbours``); tests by key meet in joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from dayloom import session
from dayloom.functions import scalars as fn
from dayloom.operators import neighbours, sampling
from dayloom.operators.lookup import looked_up
from dayloom.session import cut_lineage, passing_shuffles, passing_table

#: Donors in a bucket, about; columns of z that make cells (distances take all).
BUCKET, CELL_COLUMNS = 32, 3
#: Rows of all rounds that are on disk together; with more, rounds come in turns. Those of tests by
#: key are wider and come ``WIDER`` times less together.
TOGETHER, WIDER = 1 << 25, 4


def shifts(rounds: int) -> np.ndarray:
    """Offset of the cells of each round and column."""
    return np.random.default_rng(17).uniform(0, 1, (rounds, CELL_COLUMNS)).round(6)


def cuts(columns: int, trees: int, depth: int) -> list[list[tuple[int, int, int, float]]]:
    """Per tree its cuts (column, sign, other column, value): a scaled column, its difference
    from another one or their sum, above a value. Scaled columns lie between 0 and 1."""
    rng, centre, out = np.random.default_rng(29), {0: 0.5, -1: 0.0, 1: 1.0}, []
    for _ in range(trees):
        tree = []
        for _ in range(depth):
            a, b = rng.permutation(columns)[:2]
            sign = int(rng.choice([0, -1, -1, 1]))
            tree.append((int(a), sign, int(b), round(centre[sign] + float(rng.uniform(-0.35, 0.35)), 6)))
        out.append(tree)
    return out


def _p_value(gap: Column, tested: Column, rounds: int) -> Column:
    @F.pandas_udf(DoubleType())
    def tail(g: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([0.5 * math.erfc(a / (0.5 / math.sqrt(max(b / rounds, 1))) / math.sqrt(2)) for a, b in zip(g, n)], dtype=float)

    return tail(gap, tested.cast("double"))


def classifier_tests(
    df: DataFrame, x: str, y: str, z: Sequence[str] = (), *, row_id: str, keys: Sequence[str] = (),
    rounds: int = 30, trees: int = 32, depth: int = 5, seed: str = "ccit",
) -> DataFrame:
    """One row per test (``keys``; without keys one test over all rows): rows tested, mean
    ``gap`` of the balanced accuracy over a coin flip, and ``p_val`` of independence.

    Rows with a null among the test's columns take no part; ``row_id`` tells a test's rows
    apart. A test without rows gives no row; a row whose bucket has no donor keeps its y.
    """
    keys, width = list(keys), min(len(z), CELL_COLUMNS)
    cols = [x, y, *z]
    data = df.select(
        *keys, F.col(row_id).cast("string").alias("_id"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)]
    ).dropna(subset=["_id", *[f"_c{i}" for i in range(len(cols))]])
    data = cut_lineage(data)  # read for its moments and for the rounds
    held = data.count()
    moments = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(f"_c{i}").alias(f"_{n}{i}") for i in range(len(cols)) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
    )
    data = looked_up(data, keys, moments, "_id") if keys else data.crossJoin(F.broadcast(moments))

    def scaled(i: int) -> Column:
        s = F.coalesce((F.col(f"_c{i}") - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0)), F.lit(0.0))
        return F.round(1 / (1 + F.exp(-1.702 * s)), 9).alias(f"_u{i}")

    us = [f"_u{i}" for i in range(len(cols))]
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("_n") / (3.0 * BUCKET)) / max(width, 1)).cast("int"))
    digest = sampling.hash_key("_id", "_k", seed=seed)
    data = data.select(*keys, "_id", *[scaled(i) for i in range(len(cols))], (level if width else F.lit(0)).alias("_fine"))
    tests = [*keys, "_k"]
    if not keys:
        turn = max(1, TOGETHER // max(held, 1))
        sides = _one_test(data, us, width, held, turn, rounds=rounds, trees=trees, depth=depth, seed=seed)
        return _results(sides, keys, rounds)

    def mixed(some: range) -> DataFrame:
        """Real and swapped rows of some rounds."""
        rows = data.withColumn("_k", F.explode(F.sequence(F.lit(some.start), F.lit(some.stop - 1)))).withColumns(
            {"_part": fn.md5_bits(digest) % 3, "_test": fn.md5_bits(digest, 9) % 3 == 0, "_deal": fn.md5_bits(digest, 17)}
        )
        real = rows.where("_part = 0").select(*tests, "_id", "_test", F.lit(1.0).alias("_label"), *us)
        fake = _swapped(rows, tests, us, width, rounds).withColumn("_label", F.lit(0.0))
        return real.unionByName(fake.select(*real.columns))

    def told(rows: DataFrame) -> DataFrame:
        hits = _hits(rows, tests, us, trees, depth)
        return hits.groupBy(*tests, "_label").agg(F.avg("_hit").alias("_a"), F.count(F.lit(1)).alias("_n"))

    turn = max(1, TOGETHER // WIDER // max(held, 1))
    if turn >= rounds:
        sides = told(cut_lineage(mixed(range(rounds))))
    else:
        with passing_shuffles(df.sparkSession):
            turns = []
            for first in range(0, rounds, turn):
                with passing_table(mixed(range(first, min(first + turn, rounds))), "ccit") as rows:
                    turns.append(cut_lineage(told(rows)))
            sides = reduce(DataFrame.unionByName, turns)
    return _results(sides, keys, rounds)


def _results(sides: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    gaps = sides.groupBy(*keys, "_k").agg((F.avg("_a") - 0.5).alias("_gap"), F.sum("_n").alias("_n"))
    out = gaps.groupBy(*keys).agg(F.sum("_n").alias("tested"), F.avg("_gap").alias("gap")).where("tested is not null")
    return out.withColumn("p_val", _p_value(F.col("gap"), F.col("tested"), rounds))


def _one_test(
    data: DataFrame, us: list[str], width: int, held: int, turn: int, *, rounds: int, trees: int, depth: int, seed: str
) -> DataFrame:
    """Per round and label the share of rows whose part the forest names, and their number."""
    if not held:
        return data.sparkSession.createDataFrame([], "_k int, _label double, _a double, _n long")
    forest, turns = cuts(len(us), trees, depth), []
    with passing_shuffles(data.sparkSession), session.passing_table(data, "ccit-rows") as rows:
        fine = rows.first()["_fine"]
        levels = list(dict.fromkeys([fine, fine // 2, fine // 4, 0]))
        for first in range(0, rounds, turn):
            some = range(first, min(first + turn, rounds))
            cells = neighbours.Cells(some, levels, shifts(rounds)[:, :width])
            found = neighbours.met(rows, us, cells, forest, held=held, bucket=BUCKET, seed=seed)
            told = lambda x: cut_lineage(neighbours.told(x, some, trees, 2**depth))
            if turn >= rounds:
                turns.append(told(cut_lineage(found)))
            else:
                with passing_table(found, "ccit") as kept:
                    turns.append(told(kept))
    return reduce(DataFrame.unionByName, turns)


def _swapped(rows: DataFrame, tests: list[str], us: list[str], width: int, rounds: int) -> DataFrame:
    """The second part of every round, each row with the y of its neighbour in the third."""
    offset = shifts(rounds)
    shift = [F.element_at(F.array(*[F.lit(float(o)) for o in offset[:, h]]), F.col("_k") + 1) for h in range(width)]
    corner = [F.floor(F.col(us[2 + h]) * F.pow(F.lit(2.0), F.col("_level")) + shift[h]).cast("string") for h in range(width)]
    levels = F.array_distinct(F.array(*[F.floor(F.col("_fine") / d).cast("int") for d in (1, 2, 4)], F.lit(0)))
    placed = (
        rows.where("_part > 0").withColumn("_level", F.explode(levels)).withColumn("_cell", F.concat_ws(",", *corner))
    )
    at = [*tests, "_level", "_cell"]
    count = placed.where("_part = 2").groupBy(*at).agg(F.count(F.lit(1)).alias("_full"))
    placed = looked_up(placed, at, count, "_id", "left")
    bucket = F.pmod(F.col("_deal"), F.ceil(F.col("_full") / BUCKET)).cast("int").alias("_bucket")
    donors = placed.where("_part = 2").select(
        *at, bucket, *[F.col(u).alias(f"_d{u}") for u in us[1:]], F.col("_deal").alias("_turn"), F.col("_id").alias("_from")
    )
    own = [*tests, "_id", "_test", "_deal", *us]
    finest = F.max(F.when(F.col("_full").isNotNull(), F.struct("_level", "_cell", "_full"))).alias("_at")
    asks = placed.where("_part = 1").groupBy(*own).agg(finest).select(*own, "_at.*").select(*own, "_level", "_cell", bucket)
    near = asks.join(donors, [*at, "_bucket"], "left")
    apart = sum(((F.col(u) - F.col(f"_d{u}")) * (F.col(u) - F.col(f"_d{u}")) for u in us[2:]), F.lit(0.0))
    # rows at equal distance come in another order for every row that asks
    order = F.struct(F.round(apart, 12), F.col("_deal").bitwiseXOR(F.col("_turn")), F.col("_from"))
    best = near.groupBy(*own).agg(F.min_by(f"_d{us[1]}", order).alias("_y"))
    return best.withColumn(us[1], F.coalesce("_y", us[1])).drop("_y", "_deal")


def _hits(mixed: DataFrame, tests: list[str], us: list[str], trees: int, depth: int) -> DataFrame:
    """Rows held out of training, with 1 where the forest names their part."""
    size, forest_cuts = 2**depth, cuts(len(us), trees, depth)

    @F.pandas_udf(ArrayType(IntegerType()))
    def leaves_of(*columns: pd.Series) -> pd.Series:
        """A row's leaf in every tree; an unknown number is above every value."""
        u = [c.to_numpy(float) for c in columns]
        out = np.empty((len(u[0]), trees), np.int32)
        for t, tree in enumerate(forest_cuts):
            out[:, t] = t * size
            for d, (a, sign, b, v) in enumerate(tree):
                out[:, t] += ~((u[a] + sign * u[b] if sign else u[a]) <= v) * np.int32(2**d)
        return pd.Series(list(out))

    # rows are chosen first, and a function called unsteady is not called again by filters on its result
    coded = lambda rows: rows.withColumn("_slots", leaves_of.asNondeterministic()(*us))
    train = coded(mixed.where(~F.col("_test"))).select(*tests, F.explode("_slots").alias("_slot"), "_label")
    leaves = train.groupBy(*tests, "_slot").agg(((F.sum("_label") + 1) / (F.count(F.lit(1)) + 2)).alias("_v"))
    known = leaves.groupBy(*tests).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_known"))
    every = F.transform(F.sequence(F.lit(0), F.lit(trees * size - 1)), lambda s: F.coalesce(F.try_element_at("_known", s), F.lit(0.5)))
    forest = known.select(*tests, every.alias("_leaf"))  # trees x leaves numbers a test and round
    asked = coded(mixed.where("_test")).drop(*us)
    # one test's forest has as many numbers as rounds, trees and leaves; forests of many tests meet their rows by key
    told = asked.join(F.broadcast(forest), tests) if tests == ["_k"] else looked_up(asked, tests, forest, "_id")
    score = F.aggregate("_slots", F.lit(0.0), lambda a, s: a + F.element_at("_leaf", s + 1)) / trees
    return told.withColumn("_hit", ((F.round(score, 9) >= 0.5).cast("double") == F.col("_label")).cast("double"))


def conditional_independence(
    df: DataFrame, x: str, y: str, z: Sequence[str], *, alpha: float | None = None, **options
) -> float | bool | None:
    """p-value of one test over the whole table; with ``alpha``, p >= alpha. None without rows."""
    row = classifier_tests(df, x, y, z, **options).first()
    if row is None:
        return None
    return row["p_val"] if alpha is None else row["p_val"] >= alpha
