"""A study as a chain of stored tables: the search's graphs, their comparison, summaries and tests.

A run is named by its parameters. Both tables go to the result store, with parameters and
definition as partitions, so a rerun replaces its own definitions only, and whatever comes
after reads the stored rows of the definitions it asks for, not the search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayloom import vocab
from dayloom.operators import graph_tables as gt, inference
from dayloom.operators.graph_search import GRAPH
from dayloom.sources import writers


def store_graphs(graphs: DataFrame, path: str, run: dict[str, object], *, entity: str) -> None:
    """Graph rows of ``graph_search.discover`` as one row per graph with its edges by name.

    Graphs without an edge are kept with an empty list. At most as many edges as pairs of
    features are in a row. An empty search leaves an empty table of no definition.
    """
    p = F.size("features")
    name = lambda at: F.element_at("features", at + 1)
    named = F.transform("arcs", lambda e: F.struct(
        name(e.src).alias("src"), name(e.dst).alias("dst"), F.element_at("w", e.src * p + e.dst + 1).alias("weight")
    ))
    slim = graphs.select("definition", entity, *GRAPH, named.alias("edges"))
    writers.write_results(slim, f"{path}/graphs", run, ["definition"])


def stored_graphs(spark: SparkSession, path: str, **run: object) -> DataFrame:
    """Stored graphs; parameters (and a definition) prune partitions."""
    return writers.read_results(spark, f"{path}/graphs", **run)


def store_comparison(
    spark: SparkSession, path: str, run: dict[str, object], *, entity: str, n_nodes: int,
    themes: dict[str, list[str]] = vocab.THEMES, theme_pairs: dict[str, tuple[str, str]] = vocab.THEME_PAIRS,
) -> None:
    """Compare the run's graphs: all measures of every pair, from one read and one exchange."""
    graphs = stored_graphs(spark, path, **run).drop(*run)
    keys = ["definition", entity]
    compared = gt.compare_pairs(gt.paired_graphs(graphs, keys), keys, themes, theme_pairs, n_nodes)
    writers.write_results(compared, f"{path}/comparison", run, ["definition"])


def stored_comparison(spark: SparkSession, path: str, **run: object) -> DataFrame:
    return writers.read_results(spark, f"{path}/comparison", **run)


def summarised(compare: DataFrame, *, entity: str, at_least: int = 2) -> DataFrame:
    """Edge summary of the entities that have stress pairs in enough bootstraps."""
    pairs = compare.where("label = 'stress'").groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    return gt.edge_summary(compare, pairs.where(F.col("_n") >= at_least), entity=entity)


def measure_tests(
    compare: DataFrame, measures: Sequence[str] = vocab.SCALAR_MEASURES, *, entity: str, **options
) -> DataFrame:
    """Do stress pairs differ from reference pairs in a measure? Per definition, entity and
    measure over the bootstraps, corrected within definition and measure."""
    return inference.significance(
        compare, list(measures), entity=entity, label="label", within=["definition"], **options
    )
