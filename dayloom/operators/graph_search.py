"""Bootstrapped causal graphs for all entities at once.

One shuffle by entity carries the panel through gap filling, scaling, label
runs and bootstrap samples. A graph is then one row holding its correlation
matrix; the constraint-based search runs on batches of those rows in numpy,
so no level of the search joins or shuffles. Row and search size are
bounded by the number of features, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from dayloom.functions import tails
from dayloom.operators import ci_tests, graph_draws, panel, runs, sampling
from dayloom.session import cut_lineage

GRAPH = ["boot", "cond"]


# ---------------------------------------------------------------------- samples


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's shuffle width.

    The rows are few but their work is heavy, so adaptive execution must not
    merge the partitions by size; a given number keeps them apart.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def prepared_days(
    df: DataFrame, features: Sequence[str], label: Callable[[DataFrame], DataFrame], *,
    entity: str, date: str, backfill: str | None = None,
) -> DataFrame:
    """Filled days with a ``label`` column taken from unscaled values, features scaled and complete."""
    out = panel.fill_days(spread(df, entity), entity=entity, date=date)
    if backfill:
        out = panel.backward_fill(out, [backfill], 7, entity=entity, date=date)
    out = label(out)
    out = panel.z_score(out, features, entity=entity)
    out = panel.entity_means(out, features, entity=entity)
    out = panel.interpolate(out, features, entity=entity, date=date)
    out = panel.fill_with_mean(out, features, entity=entity, means_attached=True)
    return out.select(entity, date, "label", *features)


def sample_pool(
    days: DataFrame, features: Sequence[str], *, limit: int, boots: int, seed: str, entity: str, date: str,
    group: Sequence[str] = (), at_least: int = 0,
) -> DataFrame:
    """Run samples and all days per bootstrap, with the counts that decide what can be drawn.

    ``group`` names further keys that tell panels of one entity apart; draws do not depend on them.
    ``at_least`` leaves out, before the bootstraps, panels that ``draw_samples`` skips with as many ``min_rows``.
    """
    pool = runs.sample_runs(
        days, features, "label", limit=limit, boots=boots, seed=seed, entity=entity, date=date, with_days=True,
        group=group, at_least=at_least,
    )
    u = Window.partitionBy(entity, *group, "boot")
    size = lambda c: F.count(F.when(F.col("cond") == c, 1)).over(u)
    return pool.withColumns({c: size(k) for c, k in (("n_stress", "stress"), ("n_calm", "no_stress"), ("n_days", "day"))})


def status_of(min_rows: int) -> Column:
    n = F.least("n_stress", "n_calm")
    return (
        F.when((n < min_rows) | (F.col("n_days") < min_rows), "too few rows")
        .when(F.col("n_days") < 2 * n, "no room for two samples")
        .otherwise("ok")
    )


def entity_status(pool: DataFrame, min_rows: int, *, entity: str) -> DataFrame:
    """Per entity and bootstrap: the counts and why it was kept or skipped."""
    return (
        pool.groupBy(entity, "boot")
        .agg(*[F.first(c).alias(c) for c in ("n_stress", "n_calm", "n_days")])
        .withColumn("status", status_of(min_rows))
    )


def draw_samples(
    pool: DataFrame, *, min_rows: int, seed: str, entity: str, date: str, group: Sequence[str] = ()
) -> DataFrame:
    """n rows each for stress, no_stress and two disjoint reference samples a and b of days."""
    w = Window.partitionBy(entity, *group, "boot", "cond").orderBy(
        sampling.hash_order(entity, date, "boot", "cond", seed=seed), date
    )
    n = F.least("n_stress", "n_calm")
    ranked = pool.where(status_of(min_rows) == "ok").withColumns({"_r": F.row_number().over(w), "_n": n})
    r, n, day = F.col("_r"), F.col("_n"), F.col("cond") == "day"
    cond = F.when(~day, F.col("cond")).when(r <= n, "a").otherwise("b")
    kept = ranked.where((~day & (r <= n)) | (day & (r <= 2 * n))).withColumn("cond", cond)
    return kept.drop("_r", "_n", "n_stress", "n_calm", "n_days")


# ------------------------------------------------------------------ correlations


def correlations(samples: Sequence[np.ndarray], p: int) -> list[np.ndarray]:
    """Flat correlation matrix of every flat sample; samples of equal length go through together."""
    out: list[np.ndarray] = [np.empty(0)] * len(samples)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(samples):
        by_size.setdefault(len(v), []).append(i)
    for size, at in by_size.items():
        c = graph_draws.matrices(np.array([samples[i] for i in at], float).reshape(len(at), size // p, p))
        for i, row in zip(at, c.reshape(len(at), p * p)):
            out[i] = row
    return out


def correlation_rows(
    samples: DataFrame, features: Sequence[str], *, sigma: float, seed: str, entity: str, date: str,
    group: Sequence[str] = (), extra: Sequence[str] = (),
) -> DataFrame:
    """One row per graph: n, and flat correlation matrices with (``c``) and without (``w``) noise.

    ``extra`` may add ``s``, the correlations of the noisy sample's ranks, and ``x``, the
    noisy sample itself.

    A graph's sample is at most the calendar times the features, so it travels
    as one flat array and NumPy takes all pairs at once; hundreds of pairwise
    aggregates would outgrow generated code. ``w`` is null without spread.
    """
    noisy = [f"_e{i}" for i in range(len(features))]
    both = samples.withColumns({e: F.col(f) for e, f in zip(noisy, features)})
    both = sampling.add_noise(both, noisy, sigma, keys=[entity, date, "boot", "cond"], seed=seed)
    flat = lambda cols: F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])))
    p = len(features)

    @F.pandas_udf(ArrayType(DoubleType()))
    def matrix(values: pd.Series) -> pd.Series:
        return pd.Series(correlations(list(values), p), index=values.index, dtype=object)

    @F.pandas_udf(ArrayType(DoubleType()))
    def ranked(values: pd.Series) -> pd.Series:
        """Average ranks of every column of the flat samples."""

        def one(v):
            x = pd.DataFrame(np.asarray(v, float).reshape(-1, p))
            return x.rank().to_numpy().ravel()

        return values.map(one)

    grouped = both.groupBy(*group, entity, *GRAPH).agg(
        F.count(F.lit(1)).alias("n"), flat(noisy).alias("_c"), flat(features).alias("_w")
    )
    more = {"s": lambda: matrix(ranked("_c")).alias("s"), "x": lambda: F.col("_c").alias("x")}
    out = grouped.select(
        *group, entity, *GRAPH, "n", matrix("_c").alias("c"), matrix("_w").alias("w"), *[more[e]() for e in extra]
    )
    return out.withColumn("w", F.transform("w", lambda x: F.when(~F.isnan(x), x)))


def distinct_gate(df: DataFrame, features: Sequence[str], k: int, *, entity: str) -> DataFrame:
    """Per entity, the positions of the features with at least k distinct known values.

    The sets hold one value per day at most, so the calendar bounds them.
    """
    flags = [F.when(F.size(F.collect_set(f)) >= k, F.lit(i)) for i, f in enumerate(features)]
    return df.groupBy(entity).agg(F.array_compact(F.array(*flags)).alias("usable"))


def _critical(n: int, alpha: float) -> float:
    """Largest |r| that is still independent at level alpha; more than 1 if every r is."""
    if n < 3:
        return 2.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        t = mid * np.sqrt((n - 2) / (1 - mid * mid))
        if tails.t_two_sided(np.array([t]), np.array([n - 2.0]))[0] >= alpha:
            low = mid
        else:
            high = mid
    return low


def critical_r(n: Column, alpha: float) -> Column:
    @F.pandas_udf(DoubleType())
    def limits(ns: pd.Series) -> pd.Series:
        return ns.map({v: _critical(int(v), alpha) for v in ns.unique()}).astype(float)

    return limits(n)


# ---------------------------------------------------------------------- skeleton


_PAIR = [StructField("i", IntegerType()), StructField("j", IntegerType())]
EDGES, CUTS = ArrayType(StructType(_PAIR)), ArrayType(StructType([*_PAIR, StructField("z", ArrayType(IntegerType()))]))


def skeleton(graphs: DataFrame, features: Sequence[str], *, max_cond: int = 2) -> DataFrame:
    """Order-independent skeleton search, each row a graph and a batch of rows at a time.

    Adds ``edges`` (i < j) and ``cut``: the pairs a level of size one or two
    separated, with the first separating set. Neighbours are those at the start
    of a level; a set is taken from one end's neighbours, the lower end first.
    """
    schema = StructType([*graphs.schema.fields, StructField("edges", EDGES), StructField("cut", CUTS)])
    return graphs.mapInArrow(partial(_with_skeletons, p=len(features), max_cond=max_cond), schema)


def _with_skeletons(batches: Iterator[pa.RecordBatch], p: int, max_cond: int) -> Iterator[pa.RecordBatch]:
    edge, cut = [("i", pa.int32()), ("j", pa.int32())], ("z", pa.list_(pa.int32()))
    for b in batches:
        matrix = b.column("c").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p, p)
        limit = b.column("limit").to_numpy(zero_copy_only=False).astype(float)
        listed, usable = b.column("usable"), np.zeros((len(b), p), bool)
        usable[np.repeat(np.arange(len(b)), listed.value_lengths().fill_null(0).to_numpy()), listed.flatten().to_numpy()] = True
        left, gone = searched(matrix, limit, usable, max_cond)
        g, i, j, z, known = (gone[:, 0], gone[:, 1], gone[:, 2], gone[:, 3:], gone[:, 3:] >= 0)
        sets = pa.ListArray.from_arrays(_ends(known.sum(1)), pa.array(z[known].astype(np.int32)))
        rows, *ends = np.nonzero(left)
        yield pa.RecordBatch.from_arrays([
            *b.columns, _grouped(rows, len(b), [pa.array(x.astype(np.int32)) for x in ends], edge),
            _grouped(g, len(b), [pa.array(x.astype(np.int32)) for x in (i, j)] + [sets], [*edge, cut]),
        ], names=[*b.schema.names, "edges", "cut"])


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _grouped(rows: np.ndarray, n: int, columns: list[pa.Array], names: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Structs of sorted rows as one list for each of ``n``."""
    structs = pa.StructArray.from_arrays(columns, fields=[pa.field(*x) for x in names])
    return pa.ListArray.from_arrays(_ends(np.bincount(rows, minlength=n)), structs)


def _above(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x > y`` as in SQL, where an unknown number is above every other."""
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def searched(c: np.ndarray, limit: np.ndarray, usable: np.ndarray, max_cond: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of every graph (graphs, i < j), and what separated a pair, as rows (graph, i, j, z, z)
    in the order of graphs and levels; -1 for no second z. A level goes through all graphs at once."""
    n, p = usable.shape
    bound, before = limit * limit, np.triu(np.ones((p, p), bool), 1)
    known = usable[:, :, None] & usable[:, None, :]
    left = known & before & _above(np.abs(c), limit[:, None, None])
    out = [np.empty((0, 6), np.int64)]
    with np.errstate(all="ignore"):
        for level in range(1, max_cond + 1):
            near = left | left.transpose(0, 2, 1)
            for i, j in zip(*np.nonzero(before)):
                sides = []
                for own, far in ((i, j), (j, i)):
                    sides.append(near[:, own].copy())
                    sides[-1][:, far] = False
                rows = np.flatnonzero(left[:, i, j] & (np.maximum(sides[0].sum(1), sides[1].sum(1)) >= min(level, 2)))
                if not len(rows):
                    continue
                sides = [s[rows] for s in sides]
                r, x, y = c[rows, i, j][:, None], c[rows, i], c[rows, j]
                if level == 1:  # is the partial correlation within the limit? Squared, so no roots
                    gap = r - x * y
                    free = ~_above(gap * gap, bound[rows, None] * (1 - x * x) * (1 - y * y))
                    hits = [s & free for s in sides]
                else:  # the same given two, from the covariances left after the first
                    g, ux, uy, tx, ty = c[rows], x[:, None, :], y[:, None, :], x[:, :, None], y[:, :, None]
                    xy, xx, yy = r[:, :, None] - tx * ty, 1 - tx * tx, 1 - ty * ty
                    xw, yw, ww = ux - tx * g, uy - ty * g, 1 - g * g
                    gap = xy * ww - xw * yw
                    free = ~_above(gap * gap, bound[rows, None, None] * (xx * ww - xw * xw) * (yy * ww - yw * yw))
                    hits = [(s[:, :, None] & s[:, None, :] & free & before).reshape(len(rows), p * p) for s in sides]
                hits = np.concatenate(hits, axis=1)
                first = hits.argmax(1)
                cut = np.flatnonzero(hits[np.arange(len(rows)), first])
                z = first[cut] % (p if level == 1 else p * p)
                pair = (np.full(len(cut), i), np.full(len(cut), j))
                one, two = (z, np.full(len(cut), -1)) if level == 1 else np.divmod(z, p)
                out.append(np.stack([rows[cut], np.full(len(cut), level), *pair, one, two], axis=1))
            gone = np.concatenate([np.empty((0, 6), np.int64), *[x[x[:, 1] == level] for x in out]])
            left[gone[:, 0], gone[:, 2], gone[:, 3]] = False
    gone = np.concatenate(out)
    gone = gone[np.lexsort((gone[:, 3], gone[:, 2], gone[:, 1], gone[:, 0]))]
    return left, gone[:, [0, 2, 3, 4, 5]]


def _questions(edges: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Every edge with every set of ``level`` neighbours of one end, in the order of trial."""
    pair = edges.select(*keys, "i", "j")
    if level == 0:
        return pair.withColumns({"z": F.array().cast("array<int>"), "ord": F.array(F.lit(0))})
    arcs = pair.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("j").alias("nb")), F.struct(F.col("j").alias("v"), F.col("i").alias("nb")))).alias("a"))
    around = arcs.select(*keys, "a.v", "a.nb").groupBy(*keys, "v").agg(F.sort_array(F.collect_list("nb")).alias("near"))  # at most the features
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("v")), F.struct(F.lit(1).alias("side"), F.col("j").alias("v"))))
    asked = pair.withColumn("_e", ends).select(*keys, "i", "j", "_e.side", "_e.v").join(around, [*keys, "v"])
    rest = F.filter("near", lambda n: (n != F.col("i")) & (n != F.col("j")))
    sets = F.transform(rest, lambda a: F.array(a))
    for _ in range(level - 1):
        sets = F.flatten(F.transform(sets, lambda s: F.transform(
            F.filter(rest, lambda a: a > F.element_at(s, -1)), lambda a: F.concat(s, F.array(a)))))
    out = asked.select(*keys, "i", "j", "side", F.explode(sets).alias("z"))
    return out.select(*keys, "i", "j", "z", F.concat(F.array("side"), "z").alias("ord"))


def skeleton_by_test(
    graphs: DataFrame, features: Sequence[str], test: str, *, keys: Sequence[str], alpha: float, max_cond: int = 2
) -> DataFrame:
    """The search of ``skeleton`` as a table of questions per level, filled by a test by name.

    Adds the same ``edges`` and ``cut``. A level is one pass over all graphs: edges, their
    neighbours as they are at its start, the test, and an anti-join of what it set free.
    """
    keys, p = list(keys), len(features)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(p) for j in range(i + 1, p)])
    usable = F.filter(pairs, lambda e: F.array_contains("usable", e.i) & F.array_contains("usable", e.j))
    edges, cut = graphs.select(*keys, F.inline(usable)), None
    for level in range(max_cond + 1):
        asked = ci_tests.Asked(_questions(edges, keys, level), graphs, keys, p, level, alpha)
        free = ci_tests.TESTS[test](asked).groupBy(*keys, "i", "j").agg(F.min_by("z", "ord").alias("z"))
        free = cut_lineage(free)
        edges = cut_lineage(edges.join(free.select(*keys, "i", "j"), [*keys, "i", "j"], "left_anti"))
        if level:
            cut = free if cut is None else cut.unionByName(free)
    listed = lambda df, name, *cols: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = graphs.join(listed(edges, "edges", "i", "j"), keys, "left")
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    cut = listed(cut, "cut", "i", "j", "z") if cut is not None else None
    out = out.join(cut, keys, "left") if cut is not None else out.withColumn("cut", none("i:int,j:int,z:array<int>"))
    return out.withColumns({
        "edges": F.coalesce("edges", none("i:int,j:int")), "cut": F.coalesce("cut", none("i:int,j:int,z:array<int>"))
    })


# ------------------------------------------------------------------- orientation


def orient(edges: list[tuple[int, int]], cut: dict[tuple[int, int], set[int]]) -> list[tuple[int, int]]:
    """Direct one skeleton: colliders, propagation to a fixed point, acyclic extension.

    ``to[x]`` holds every y with x -> y still possible; both ways means undirected.
    """
    near: dict[int, set[int]] = {}
    for i, j in edges:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    nodes = sorted(near)
    to = {v: set(near[v]) for v in nodes}
    for z in nodes:
        for x, y in combinations(sorted(near[z]), 2):
            if y not in near[x] and z not in cut.get((x, y), ()):
                to[z] -= {x, y}
    for x in nodes:  # colliders that point one edge both ways leave it undirected
        for z in near[x]:
            if z not in to[x] and x not in to[z]:
                to[x].add(z)
                to[z].add(x)

    fixed = lambda x, y: y in to[x] and x not in to[y]
    loose = lambda x: [y for y in sorted(to[x]) if x in to[y]]
    while True:
        before = sum(map(len, to.values()))
        for z in nodes:  # x -> z - y without x -> y: z -> y
            heads = [x for x in nodes if fixed(x, z)]
            for y in loose(z):
                if any(x != y and y not in to[x] for x in heads):
                    to[y].discard(z)
        for x in nodes:  # x - y with a directed way round: x -> y
            for y in loose(x):
                if _reaches({(u, v) for u in nodes for v in to[u] if u not in to[v]}, x, y):
                    to[y].discard(x)
        for z in nodes:  # x - z - y, x -> w <- y, z - w: z -> w
            around = loose(z)
            for w in around:
                if sum(fixed(x, w) for x in around if x != w) >= 2:
                    to[w].discard(z)
        if sum(map(len, to.values())) == before:
            return _extend(nodes, to)


def _extend(nodes: list[int], to: dict[int, set[int]]) -> list[tuple[int, int]]:
    """Acyclic extension: take sinks off one by one, pointing what is undirected at them."""
    arcs = {(x, y) for x in nodes for y in to[x] if x not in to[y]}
    rest = {v: set(to[v]) for v in nodes}
    alive = list(nodes)
    while alive:
        for v in alive:
            into = {x for x in alive if v in rest[x]}
            if rest[v] - into:
                continue
            if all(z in rest[y] for y in rest[v] for z in into if y != z):
                arcs |= {(y, v) for y in into}
                for x in into:
                    rest[x].discard(v)
                alive.remove(v)
                break
        else:  # no acyclic extension keeps all colliders: point the rest one way without a cycle
            for x in alive:
                for y in sorted(rest[x]):
                    if (y, x) not in arcs and not _reaches(arcs, y, x):
                        arcs.add((x, y))
            # between nodes that are on a directed cycle already, either way closes one
            arcs |= {(x, y) for x in alive for y in rest[x] if x < y and not {(x, y), (y, x)} & arcs}
            break
    return sorted(arcs)


def _reaches(arcs: set[tuple[int, int]], start: int, goal: int) -> bool:
    out: dict[int, list[int]] = {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        if v == goal:
            return True
        for u in out.get(v, ()):
            if u not in seen:
                seen.add(u)
                todo.append(u)
    return False


#: Skeletons whose directions a task remembers.
REMEMBERED = 1 << 16
ARCS = ArrayType(StructType([StructField("src", IntegerType()), StructField("dst", IntegerType())]))


def directed(skeletons: DataFrame) -> DataFrame:
    """Add ``arcs``: the directed edges of each row's graph, by feature position.

    A batch-wise map rather than a column function: the optimizer would
    otherwise inline the whole search into the function's arguments.
    """
    schema = StructType([*skeletons.schema.fields, StructField("arcs", ARCS)])
    return skeletons.mapInArrow(_with_arcs, schema)


def directed_skeletons(graphs: DataFrame, features: Sequence[str], *, max_cond: int = 2) -> DataFrame:
    """``directed`` of ``skeleton``, with one way to Python and back for both."""
    more = [StructField("edges", EDGES), StructField("cut", CUTS), StructField("arcs", ARCS)]
    search = partial(_with_skeletons, p=len(features), max_cond=max_cond)
    return graphs.mapInArrow(lambda batches: _with_arcs(search(batches)), StructType([*graphs.schema.fields, *more]))


def _with_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[bytes, ...], bytes] = {}
    for b in batches:
        pairs, cuts = b.column("edges"), b.column("cut")
        sets = pc.struct_field(cuts.flatten(), "z")
        sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
        parts = [
            _sliced(pairs, _ends_of(pairs, "ij")), _sliced(cuts, _ends_of(cuts, "ij")), _sliced(cuts, sizes[:, None]),
            _slices(np.append(0, np.cumsum(sizes))[_offsets(cuts)], sets.flatten().to_numpy(zero_copy_only=False)[:, None]),
        ]
        arcs = []
        for skeleton in zip(*parts):
            if skeleton not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                ij, cut, size, z = (np.frombuffer(x, np.int32) for x in skeleton)
                apart = {tuple(e): set(x.tolist()) for e, x in zip(cut.reshape(-1, 2).tolist(), np.split(z, np.cumsum(size)[:-1]))}
                known[skeleton] = np.array(orient([*map(tuple, ij.reshape(-1, 2).tolist())], apart), np.int32).tobytes()
            arcs.append(known[skeleton])
        flat = np.frombuffer(b"".join(arcs), np.int32).reshape(-1, 2)
        rows = np.repeat(np.arange(len(b)), [len(x) // 8 for x in arcs])
        ends = [pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)]
        found = _grouped(rows, len(b), ends, [("src", pa.int32()), ("dst", pa.int32())])
        yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "arcs"])


def _offsets(rows: pa.ListArray) -> np.ndarray:
    return np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy()))


def _ends_of(rows: pa.ListArray, fields: str) -> np.ndarray:
    """Fields of all rows' structs, side by side."""
    return np.stack([pc.struct_field(rows.flatten(), f).to_numpy(zero_copy_only=False) for f in fields], axis=1)


def _sliced(rows: pa.ListArray, values: np.ndarray) -> list[bytes]:
    """Every row's values, which lie one after the other, as 32-bit integers."""
    return _slices(_offsets(rows), values)


def _slices(at: np.ndarray, values: np.ndarray) -> list[bytes]:
    flat, cuts = np.ascontiguousarray(values, np.int32).tobytes(), (at * values.shape[1] * 4).tolist()
    return [flat[x:y] for x, y in zip(cuts, cuts[1:])]


def unfold(graphs: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per entry of a graph's array of structs.

    The outer form keeps the optimizer from testing the array's size below the
    search, which would run the search twice.
    """
    first = graphs.schema[column].dataType.elementType.names[0]
    return graphs.select(*keep, F.inline_outer(column)).where(F.col(first).isNotNull())


# ---------------------------------------------------------------------- the job


def usable_features(df: DataFrame, features: Sequence[str], k: int, *, entity: str) -> DataFrame:
    """``distinct_gate`` as a column: a window of the entity's shuffle in place of a scan of its own."""
    u = Window.partitionBy(entity)
    flags = [F.when(F.size(F.collect_set(f).over(u)) >= k, F.lit(i)) for i, f in enumerate(features)]
    return df.withColumn("usable", F.array_compact(F.array(*flags)))


def definition_rows(
    df: DataFrame, definitions: dict[str, tuple[Sequence[str], Callable[[DataFrame], DataFrame]]], *,
    entity: str, date: str, boots: int = 100, limit: int = 3, min_rows: int = 10, min_distinct: int = 5,
    sigma: float = 0.001, alpha: float = 0.05, max_cond: int = 2, seed: str = "graph", backfill: Sequence[str] = (),
    ci_test: str = "pearsonr", label_after_scaling: bool = False,
) -> DataFrame:
    """One row per definition, entity, bootstrap and condition with its skeleton and directed graph.

    A definition is (features, label step). The panel is filled, scaled and completed once
    for the features of all definitions; then every day is repeated per definition with
    that definition's label, and a definition's features mask the pairs its graphs may
    have. ``ci_test`` names a test of ``ci_tests``. Labels are taken from unscaled values,
    or with ``label_after_scaling`` from the scaled and completed ones, as published.
    """
    keys = {"entity": entity, "date": date}
    features = list(dict.fromkeys(f for names, _ in definitions.values() for f in names))
    out = panel.fill_days(usable_features(spread(df, entity), features, min_distinct, entity=entity), **keys)
    if backfill:
        out = panel.backward_fill(out, list(backfill), 7, **keys)
    marks = {name: f"_label_{i}" for i, name in enumerate(definitions)}

    def labelled(days: DataFrame) -> DataFrame:
        for name, (_, label) in definitions.items():
            days = label(days).withColumnRenamed("label", marks[name])
        return days

    if not label_after_scaling:
        out = labelled(out)
        # entities that no definition can draw from end before they are scaled and completed
        for i, mark in enumerate(marks.values()):
            out = runs.with_drawable(out, mark, f"_drawable_{i}", limit=limit, **keys)
        out = out.where(F.greatest(F.lit(0), *[F.col(f"_drawable_{i}") for i in range(len(marks))]) >= min_rows)
    out = panel.z_score(out, features, entity=entity)
    out = panel.entity_means(out, features, entity=entity)
    out = panel.interpolate(out, features, **keys)
    out = panel.fill_with_mean(out, features, entity=entity, means_attached=True)
    if label_after_scaling:
        out = labelled(out)
    out = out.withColumn("usable", F.max("usable").over(Window.partitionBy(entity)))  # filled days have none
    each = [
        F.struct(
            F.lit(name).alias("definition"), F.col(marks[name]).cast("double").alias("label"),
            F.array(*[F.lit(features.index(f)) for f in names]).alias("mask"),
        )
        for name, (names, _) in definitions.items()
    ]
    days = out.select(entity, date, "usable", *features, F.explode(F.array(*each)).alias("_d")).select(
        entity, date, "_d.definition", "_d.label", F.array_intersect("usable", "_d.mask").alias("usable"), *features
    )
    # the mask is one value per entity and definition, so it can be a key
    group = ["definition", "usable"]
    extra = {"spearmanr": ["s"], "pearsonr": []}.get(ci_test, ["s", "x"])
    rows = graph_draws.drawn_correlations(
        days, features, limit=limit, boots=boots, min_rows=min_rows, sigma=sigma, seed=seed, group=group, extra=extra, **keys
    )
    graph = ["definition", entity, *GRAPH]
    ready = spread(rows.withColumn("limit", critical_r(F.col("n"), alpha)), *graph)
    # the matrices are what the whole pipeline cost so far: written once, the search and
    # whatever reads its result start from them
    ready = cut_lineage(ready)
    if ci_test == "pearsonr":  # needs nothing but the matrix: no level leaves the row
        found = directed_skeletons(ready, features, max_cond=max_cond)
    else:
        found = directed(skeleton_by_test(ready, features, ci_test, keys=graph, alpha=alpha, max_cond=max_cond))
    return found.withColumn("features", F.array(*[F.lit(f) for f in features]))


def graph_rows(
    df: DataFrame, features: Sequence[str], label: Callable[[DataFrame], DataFrame], *, entity: str, date: str,
    backfill: str | None = None, **options,
) -> DataFrame:
    """``definition_rows`` of one definition."""
    more = {"backfill": [backfill]} if backfill else {}
    rows = definition_rows(df, {"": (features, label)}, entity=entity, date=date, **more, **options)
    return rows.drop("definition", "features")


def discover(
    df: DataFrame, definitions: dict[str, tuple[Sequence[str], Callable[[DataFrame], DataFrame]]], **options
) -> DataFrame:
    """Graph rows of several stress definitions: (features, label step) by name."""
    return definition_rows(df, definitions, **options)


def definition_edges(graphs: DataFrame, *, entity: str) -> DataFrame:
    """Edge rows of ``discover`` with the features' names."""
    rows = unfold(graphs, "arcs", "definition", entity, *GRAPH, "w", "features")
    p = F.size("features")
    return rows.select(
        "definition", entity, *GRAPH,
        F.element_at("features", F.col("src") + 1).alias("src"),
        F.element_at("features", F.col("dst") + 1).alias("dst"),
        F.element_at("w", F.col("src") * p + F.col("dst") + 1).alias("weight"),
    )
