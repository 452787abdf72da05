"""Graphs as edge rows: frequencies, set operations, comparison, summaries.

Edge rows carry the graph's key columns, ``src``, ``dst`` and ``weight``. Edges
in either direction meet on (least, greatest), so every undirected match is an
equi-key. A graph has at most as many edges as there are feature pairs, so a
graph's edges may be collected; anything across graphs is aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from dayloom.operators import twosample

ARRAY_OF_EDGES = "array<struct<src:string,dst:string>>"


def canonical(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return df.withColumns({"lo": F.least(src, dst), "hi": F.greatest(src, dst)})


# ----------------------------------------------------------- counts, frequencies


def edges_per_graph(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))


def pair_flag(src: str, dst: str, first: Sequence[str], second: Sequence[str]) -> Column:
    """Does the edge join the two themes, in either direction? A flag, never a row count."""
    s, d = F.col(src), F.col(dst)
    a, b = list(first), list(second)
    return (s.isin(a) & d.isin(b)) | (s.isin(b) & d.isin(a))


def theme_flags(edges: DataFrame, themes: dict[str, list[str]], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return edges.withColumns({k: pair_flag("src", "dst", themes[a], themes[b]) for k, (a, b) in pairs.items()})


def theme_edges_per_graph(
    edges: DataFrame, keys: Sequence[str], themes: dict[str, list[str]], pairs: dict[str, tuple[str, str]]
) -> DataFrame:
    flagged = theme_flags(edges, themes, pairs)
    return flagged.groupBy(*keys).agg(*[F.count_if(F.col(k)).alias(k) for k in pairs])


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def edge_frequency(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge count over the number of graphs that hold both endpoints.

    The denominator counts node pairs inside each graph's node set, which the
    feature count bounds; only pairs that occur as an edge are kept.
    """
    per_graph = nodes.groupBy(*keys).agg(F.collect_set("node").alias("_n"))
    found = edge_counts(edges)
    pair = F.explode(F.flatten(F.transform("_n", lambda a: F.transform("_n", lambda b: F.struct(a.alias("src"), b.alias("dst"))))))
    both = per_graph.select(pair.alias("_p")).groupBy("_p.src", "_p.dst").agg(F.count(F.lit(1)).alias("_d"))
    return found.join(both, ["src", "dst"]).select("src", "dst", (F.col("n") / F.col("_d")).alias("freq"))


def undirected_frequency(edges: DataFrame, graphs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of graphs with an edge in either direction; ``graphs`` also counts empty graphs."""
    n = graphs.groupBy(*by).agg(F.count(F.lit(1)).alias("_g"))
    counts = canonical(edges).groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(n, list(by)) if by else counts.crossJoin(F.broadcast(n))  # one row without keys
    return joined.select(*by, "lo", "hi", (F.col("_n") / F.col("_g")).alias("freq"))


def undirected_weights(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undirected edge -> its weights, one row per graph; lists would grow with the data."""
    return canonical(edges).select(*by, "lo", "hi", "weight")


def above_cutoff(freq: DataFrame, cutoff: float) -> DataFrame:
    return freq.where(F.col("freq") >= cutoff)


def top_edges(freq: DataFrame, value: str, k: int, names: Sequence[str]) -> DataFrame:
    return freq.orderBy(F.desc(value), *names).limit(k)


def frequency_change(freq_by_cond: DataFrame) -> DataFrame:
    """Edges seen in both conditions with the direction and size of the change."""
    side = lambda c: F.max(F.when(F.col("cond") == c, F.col("freq"))).alias(c)
    both = freq_by_cond.groupBy("lo", "hi").agg(side("no_stress"), side("stress")).dropna()
    return both.withColumns({
        "decreasing": (F.col("stress") <= F.col("no_stress")).cast("int"),
        "difference": F.abs(F.col("no_stress") - F.col("stress")),
    })


def top_changes(change: DataFrame, k: int, by: str = "no_stress", decreasing: int | None = None) -> DataFrame:
    """Top k by base frequency or by change, optionally one direction only."""
    rows = change if decreasing is None else change.where(F.col("decreasing") == decreasing)
    return rows.orderBy(F.desc(by), "lo", "hi").limit(k)


def weights_in_both(edges: DataFrame, at_least: int = 10) -> DataFrame:
    """Weights by condition of edges with enough of them in both conditions."""
    rows = undirected_weights(edges, ["cond"])
    enough = rows.groupBy("lo", "hi").agg(
        F.count_if(F.col("cond") == "stress").alias("_s"), F.count_if(F.col("cond") == "no_stress").alias("_c")
    ).where((F.col("_s") >= at_least) & (F.col("_c") >= at_least))
    return rows.join(enough, ["lo", "hi"], "left_semi")


# ------------------------------------------------------------------- connectivity


def _disjoint_paths(out: list[list[int]], s: int, t: int) -> int:
    """Number of paths from s to t that share no inner node, a direct edge included.

    Augmenting paths in the graph whose nodes are split into an entry (2v) and
    an exit (2v + 1) joined by one unit.
    """
    spare: dict[int, set[int]] = {}
    for v, heads in enumerate(out):
        spare.setdefault(2 * v, set()).add(2 * v + 1)
        for h in heads:
            spare.setdefault(2 * v + 1, set()).add(2 * h)
    found, start, goal = 0, 2 * s + 1, 2 * t
    while True:
        came = {start: start}
        todo = [start]
        while todo and goal not in came:
            v = todo.pop()
            for u in spare.get(v, ()):
                if u not in came:
                    came[u] = v
                    todo.append(u)
        if goal not in came:
            return found
        v = goal
        while v != start:
            u = came[v]
            spare[u].discard(v)
            spare.setdefault(v, set()).add(u)
            v = u
        found += 1


def mean_disjoint_paths(edges: list[tuple[str, str]], n_nodes: int) -> float:
    """Average over ordered node pairs of the number of node-disjoint paths."""
    if n_nodes < 2:
        return 0.0
    index: dict[str, int] = {}
    for e in edges:
        for v in e:
            index.setdefault(v, len(index))
    out: list[list[int]] = [[] for _ in index]
    inward = [0] * len(index)
    for a, b in edges:
        out[index[a]].append(index[b])
        inward[index[b]] += 1
    total = 0
    for s in range(len(index)):
        for t in range(len(index)):
            if s != t and out[s] and inward[t]:
                total += _disjoint_paths(out, s, t)
    return total / (n_nodes * (n_nodes - 1))


#: Graphs whose connectivity a worker remembers.
REMEMBERED = 1 << 16


@lru_cache(REMEMBERED)
def _remembered(src: tuple[str, ...], dst: tuple[str, ...], n_nodes: int) -> float:
    return mean_disjoint_paths([*zip(src, dst)], n_nodes)


@F.pandas_udf(DoubleType())
def _connectivity(src: pd.Series, dst: pd.Series, n_nodes: pd.Series) -> pd.Series:
    return pd.Series([_remembered(tuple(a), tuple(b), int(n)) for a, b, n in zip(src, dst, n_nodes)], dtype=float)


def log_connectivity(edges: Column, n_nodes: Column | int) -> Column:
    """ln of the mean connectivity, -infinity for a graph without edges."""
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    ends = F.transform(edges, lambda e: e.src), F.transform(edges, lambda e: e.dst)
    c = _connectivity(*ends, n)
    return F.when(F.size(edges) == 0, F.lit(float("-inf"))).otherwise(F.ln(c))


def graph_connectivity(edges: DataFrame, graphs: DataFrame, keys: Sequence[str], n_nodes: int) -> DataFrame:
    """Log connectivity of every graph, empty ones included."""
    listed = edges.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("_e"))
    joined = graphs.select(*keys).distinct().join(listed, list(keys), "left")
    es = F.coalesce("_e", F.array().cast(ARRAY_OF_EDGES))
    return joined.withColumn("_e", es).withColumn("log_connectivity", log_connectivity(F.col("_e"), n_nodes)).drop("_e")


def padded_nodes(graphs: DataFrame, features: Sequence[str], keys: Sequence[str], target: str | None = None) -> DataFrame:
    """Every feature as a node of every graph; the target only joins reference graphs."""
    nodes = graphs.select(*keys).distinct().withColumn("node", F.explode(F.array(*[F.lit(f) for f in features])))
    if target is None:
        return nodes
    return nodes.where((F.col("node") != target) | F.col("cond").isin("a", "b"))


def last_boot(graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last bootstrap of every graph series."""
    return graphs.groupBy(*keys).agg(F.max("boot").alias("boot"))


# ------------------------------------------------------------------- comparison


def paired_edges(edges: DataFrame, graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per pair of graphs and undirected edge, with each side's direction and weight.

    Pairs are (no_stress, stress) as ``stress`` and (b, a) as ``reference``; the
    first of a pair is the base. Both graphs of a pair must exist; empty graphs
    come in through ``graphs`` as rows without an edge.
    """
    ident = [*keys, "boot"]
    shown = graphs.select(*ident, "cond").distinct().withColumns(
        {"src": F.lit(None).cast("string"), "dst": F.lit(None).cast("string"), "weight": F.lit(None).cast("double")}
    )
    return _sides(edges.select(*ident, "cond", "src", "dst", "weight").unionByName(shown), ident)


def paired_graphs(graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``paired_edges`` of a table with one row per graph and its ``edges`` in an array.

    The row that says a graph exists comes from the same array, so the table is read once.
    """
    kind = graphs.schema["edges"].dataType.simpleString()
    marked = F.concat(F.array(F.lit(None)).cast(kind), F.coalesce("edges", F.array().cast(kind)))
    ident = [*keys, "boot"]
    return _sides(graphs.select(*ident, "cond", F.inline(marked)), ident)


def _sides(rows: DataFrame, ident: list[str]) -> DataFrame:
    """Edges, and a row without an edge for every graph, by pair of graphs and undirected edge."""
    cond = F.col("cond")
    rows = rows.withColumns({
        "label": F.when(cond.isin("stress", "no_stress"), "stress").otherwise("reference"),
        "base": cond.isin("no_stress", "b"),
    })
    # one shuffle by graph pair serves both this grouping and the comparison after it
    rows = rows.repartition(*ident, "label")
    side = lambda base, c: F.max(F.when(F.col("base") == base, F.col(c)))
    return canonical(rows).groupBy(*ident, "label", "lo", "hi").agg(
        side(True, "src").alias("base_src"), side(True, "dst").alias("base_dst"), side(True, "weight").alias("base_weight"),
        side(False, "src").alias("other_src"), side(False, "dst").alias("other_dst"), side(False, "weight").alias("other_weight"),
        F.bool_or(F.col("base")).alias("_has_base"), F.bool_or(~F.col("base")).alias("_has_other"),
    )


def compare_pairs(
    pairs: DataFrame, keys: Sequence[str], themes: dict[str, list[str]], theme_pairs: dict[str, tuple[str, str]],
    n_nodes: Column | int,
) -> DataFrame:
    """All measures of a graph pair in one aggregate."""
    ident = [*keys, "boot", "label"]
    real = F.col("lo").isNotNull()
    base, other = F.col("base_src").isNotNull(), F.col("other_src").isNotNull()
    count = lambda c: F.count_if(c).cast("long")
    themed = {
        k: (
            F.count_if(base & pair_flag("base_src", "base_dst", themes[a], themes[b]))
            - F.count_if(other & pair_flag("other_src", "other_dst", themes[a], themes[b]))
        ).alias(k)
        for k, (a, b) in theme_pairs.items()
    }
    edge = lambda s: F.struct(F.col(f"{s}_src").alias("src"), F.col(f"{s}_dst").alias("dst"))
    gather = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
    shared = F.struct(edge("base").alias("key"), (F.col("base_weight") - F.col("other_weight")).alias("value"))
    out = pairs.groupBy(*ident).agg(
        count(base & other).alias("_both"), count(real).alias("_any"),
        *themed.values(),
        gather(base & other, shared).alias("_diffs"),
        gather(base & ~other, edge("base")).alias("only_in_base"),
        gather(other & ~base, edge("other")).alias("only_in_other"),
        gather(base, edge("base")).alias("_base"), gather(other, edge("other")).alias("_other"),
        F.bool_or(~real & F.col("_has_base")).alias("_b"), F.bool_or(~real & F.col("_has_other")).alias("_o"),
    ).where(F.col("_b") & F.col("_o"))
    gap = log_connectivity(F.col("_base"), n_nodes) - log_connectivity(F.col("_other"), n_nodes)
    return out.withColumns({
        "int_union": F.coalesce(F.col("_both") / F.nullif(F.col("_any"), F.lit(0)), F.lit(0.0)),
        "weight_diffs": F.map_from_entries("_diffs"),
        "difference": F.nanvl(gap, F.lit(None).cast("double")),
    }).drop("_both", "_any", "_diffs", "_base", "_other", "_b", "_o")


def edge_union(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undirected union; a shared edge is named as the base has it."""
    rows = pairs.where(F.col("lo").isNotNull())
    return rows.select(*keys, "boot", "label", F.coalesce("base_src", "other_src").alias("src"), F.coalesce("base_dst", "other_dst").alias("dst"))


def edge_intersection(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = pairs.where("base_src is not null and other_src is not null")
    return rows.select(
        *keys, "boot", "label", F.col("base_src").alias("src"), F.col("base_dst").alias("dst"),
        (F.col("base_weight") - F.col("other_weight")).alias("weight_diff"),
    )


def edge_difference(pairs: DataFrame, keys: Sequence[str], other: bool = False) -> DataFrame:
    """Edges of the base that the other graph lacks in either direction, or the reverse."""
    own, far = ("other", "base") if other else ("base", "other")
    rows = pairs.where(F.col(f"{own}_src").isNotNull() & F.col(f"{far}_src").isNull())
    return rows.select(*keys, "boot", "label", F.col(f"{own}_src").alias("src"), F.col(f"{own}_dst").alias("dst"))


# --------------------------------------------------------------------- summaries


def _changed(compare: DataFrame, entity: str) -> DataFrame:
    """Long form of the edges found on one side only, stress rows."""
    rows = compare.where(F.col("label") == "stress")
    part = lambda c, kind: rows.select(entity, F.explode(c).alias("_e")).select(
        entity, F.least("_e.src", "_e.dst").alias("lo"), F.greatest("_e.src", "_e.dst").alias("hi"), F.lit(kind).alias("kind")
    )
    return part("only_in_base", "added").unionByName(part("only_in_other", "removed"))


def unique_edges(compare: DataFrame, *, entity: str) -> DataFrame:
    """Distinct undirected edges that differ in any stress pair."""
    return _changed(compare, entity).select("lo", "hi").distinct()


def edge_summary(compare: DataFrame, entities: DataFrame, *, entity: str, boots: int | None = None) -> DataFrame:
    """Per entity and edge: share of bootstraps with the edge on one side only; zeros kept.

    All edges that differ anywhere are one row with an array, at most as long as there are
    pairs of features, so every entity gets them without a join of tables. ``boots`` is
    counted from the comparison where it is not given.
    """
    counts = _changed(compare, entity).groupBy(entity, "lo", "hi").agg(
        F.count_if(F.col("kind") == "added").alias("_a"), F.count_if(F.col("kind") == "removed").alias("_r")
    )
    known = counts.agg(F.collect_set(F.struct("lo", "hi")).alias("_edges")).crossJoin(_boots(compare, boots))  # two single rows
    spine = entities.select(entity).crossJoin(F.broadcast(known)).select(entity, "_boots", F.inline("_edges"))
    share = lambda c: F.coalesce(F.col(c) / F.col("_boots"), F.lit(0.0))
    return spine.join(counts, [entity, "lo", "hi"], "left").select(
        entity, "lo", "hi", share("_a").alias("percent_added"), share("_r").alias("percent_removed")
    )


def _boots(compare: DataFrame, boots: int | None) -> DataFrame:
    """One row: the given or the counted number of bootstraps."""
    return compare.agg((F.lit(boots) if boots else F.count_distinct("boot")).cast("long").alias("_boots"))


def frequent_edges(summary: DataFrame, cutoff: float, at_least: int = 10) -> DataFrame:
    """Edges at or above the cutoff in enough entities, for both kinds of change."""
    counts = summary.groupBy("lo", "hi").agg(
        F.count_if(F.col("percent_added") >= cutoff).alias("n_added"),
        F.count_if(F.col("percent_removed") >= cutoff).alias("n_removed"),
    )
    return counts.where((F.col("n_added") >= at_least) | (F.col("n_removed") >= at_least))


def weight_change(compare: DataFrame, *, entity: str, boots: int | None = None) -> DataFrame:
    """Weight change of edges shared in every stress pair, tested against the reference pairs.

    ``boots``, the number of stress pairs an edge must be in, is counted where it is not given.
    """
    long = compare.select(entity, "label", F.explode("weight_diffs").alias("_e", "_w")).select(
        entity, F.least("_e.src", "_e.dst").alias("lo"), F.greatest("_e.src", "_e.dst").alias("hi"), "_w",
        F.when(F.col("label") == "stress", "x").otherwise("y").alias("_side"),
    )
    keys = [entity, "lo", "hi"]
    seen = long.groupBy(*keys).agg(
        F.count_if(F.col("_side") == "x").alias("_s"), F.count_if(F.col("_side") == "y").alias("_r")
    ).crossJoin(F.broadcast(_boots(compare, boots))).where((F.col("_s") == F.col("_boots")) & (F.col("_r") > 0))  # one row
    tested = twosample.t_test(long.join(seen, keys, "left_semi"), "_w", "_side", keys, pooled=True)
    return tested.select(*keys, F.col("mean_x").alias("mean"), "p_val")
