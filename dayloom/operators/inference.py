"""Many tests at once: corrections, rejection summaries, population traits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dayloom.operators import ordered, twosample
from dayloom.session import cut_lineage


def bonferroni(df: DataFrame, p: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """p times the number of tests in the group (not capped) and the reject flag."""
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    return df.join(m, list(keys)).withColumns({
        "p_value_bc": F.col(p) * F.col("_m"),
        "reject_bc": (F.col(p) < F.lit(alpha) / F.col("_m")).cast("int"),
    }).drop("_m")


def benjamini_hochberg(
    df: DataFrame, p: str, keys: Sequence[str], alpha: float = 0.1, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Adjusted p and reject flag within each group.

    A group is one measure over all entities, so it may hold most of the table:
    ranks run over distinct p-values in blocks, never over one task's window.
    """
    keys = list(keys)
    df = cut_lineage(df)  # read several times below; the tests upstream run once
    distinct = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    walk = ordered.Ordered(distinct, keys, p, largest=ordered.largest_group(df, keys), block_rows=block_rows)
    walk.running_sum("_rank", F.col("_c"))
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    walk.rows = walk.rows.join(m, keys)
    walk.reverse_min("p_value_fdr", F.col(p) * F.col("_m") / F.col("_rank"))
    q = walk.result().select(*keys, p, F.least(F.col("p_value_fdr"), F.lit(1.0)).alias("p_value_fdr"))
    return df.join(q, [*keys, p]).withColumn("reject_fdr", (F.col("p_value_fdr") <= alpha).cast("int"))


def correct(df: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    return benjamini_hochberg(bonferroni(df, p, keys), p, keys)


def significance(
    df: DataFrame, measures: Sequence[str], *, entity: str, label: str,
    within: Sequence[str] = (), method: str = "KS", gate: str | None = None, tail: str = "exact",
) -> DataFrame:
    """Stress against reference samples per entity and measure, corrected per measure.

    ``within`` adds key columns such as the stress definition, so all definitions
    run as one job. ``gate`` names the measure that must vary for an entity to be
    tested. ``tail`` is the KS test's way to its p. Direction is Loss for a stress mean
    at or above 0, else Gain.
    """
    within = list(within)
    keys = [*within, entity, "measure"]
    if gate:
        df = df.join(informative_entities(df, gate, entity=entity, label=label, within=within), [*within, entity], "left_semi")
    as_double = df.select(*within, entity, label, *[F.col(m).cast("double").alias(m) for m in measures])
    long = as_double.unpivot([*within, entity, label], list(measures), "measure", "_x")
    finite = long.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sides = finite.withColumn("_side", F.when(F.col(label) == "stress", "x").otherwise("y"))
    if method == "KS":  # a group is one entity's bootstraps
        tested = twosample.ks_test(sides, "_x", "_side", keys, method=tail, small_groups=True)
    else:
        tested = twosample.t_test(sides, "_x", "_side", keys)
    mean = F.col("mean_x")
    results = tested.select(
        *keys, "p_val", F.when(mean >= 0, "Loss").when(mean < 0, "Gain").alias("direction")
    ).dropna(subset=["p_val", "direction"])
    return correct(results, "p_val", [*within, "measure"])


def informative_entities(
    df: DataFrame, column: str, *, entity: str, label: str, within: Sequence[str] = ()
) -> DataFrame:
    """Entities whose stress rows show more than one value (null counts as a value)."""
    values = F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))
    return (
        df.where(F.col(label) == "stress").groupBy(*within, entity).agg(values.alias("_n"))
        .where(F.col("_n") > 1).select(*within, entity)
    )


def tested_for_all(results: DataFrame, definitions: Sequence[str], *, entity: str) -> DataFrame:
    """Entities that were tested under every one of the definitions."""
    chosen = results.where(F.col("definition").isin(list(definitions)))
    return chosen.groupBy(entity).agg(F.count_distinct("definition").alias("_n")).where(
        F.col("_n") == len(definitions)
    ).select(entity)


def viability(results: DataFrame, *, entity: str) -> DataFrame:
    """Per measure and entity: rejected definitions, their directions, gains and losses."""
    hit = F.col("reject_fdr") == 1
    lists = F.array_sort(F.collect_list(F.when(hit, F.struct("definition", "direction"))))
    out = results.groupBy("measure", entity).agg(
        lists.alias("_l"),
        F.count_if(hit).alias("number_rejected"),
        F.count_if(hit & (F.col("direction") == "Gain")).alias("number_gained"),
        F.count_if(hit & (F.col("direction") == "Loss")).alias("number_lost"),
    )
    return out.withColumns({"definitions": F.col("_l.definition"), "directions": F.col("_l.direction")}).drop("_l")


def viability_histogram(results: DataFrame, *, entity: str, most: int = 4) -> DataFrame:
    """Entities by number of rejected definitions, 0 to ``most``, for each measure."""
    per = results.groupBy("measure", entity).agg(F.sum("reject_fdr").alias("n_definitions"))
    counts = per.groupBy("measure", "n_definitions").agg(F.count(F.lit(1)).alias("n"))
    spine = per.select("measure").distinct().withColumn(
        "n_definitions", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")))
    )
    return spine.join(counts, ["measure", "n_definitions"], "left").na.fill(0, ["n"])


def rejection_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rejections per group, their share, and the share of them that are losses."""
    hit = F.col("reject_fdr") == 1
    out = results.groupBy(*keys).agg(
        F.count_if(hit).alias("n_rejected"), F.count(F.lit(1)).alias("n_tests"),
        F.count_if(hit & (F.col("direction") == "Loss")).alias("n_lower"),
    )
    return out.withColumns({
        "percent_rejected": F.col("n_rejected") / F.col("n_tests") * 100,
        "percent_lower": F.col("n_lower") / F.nullif(F.col("n_rejected"), F.lit(0)) * 100,
    })


def direction_table(results: DataFrame, measures: Sequence[str], *, entity: str) -> DataFrame:
    """One row per entity, one column per measure with the direction of its rejection."""
    rejected = results.where(F.col("reject_fdr") == 1)
    return rejected.groupBy(entity).pivot("measure", list(measures)).agg(F.min("direction"))


def patterns(directions: DataFrame, measures: Sequence[str]) -> DataFrame:
    """How often each combination of directions occurs; rows with a gap are left out."""
    return directions.dropna(subset=list(measures)).groupBy(*measures).agg(F.count(F.lit(1)).alias("freq"))


def pattern_overlap(first: DataFrame, second: DataFrame, measures: Sequence[str], *, entity: str) -> DataFrame:
    """Overlap coefficient of the entities that show each combination in two tables."""
    spine_side = lambda d: d.dropna(subset=list(measures)).select(entity, *measures)
    a, b = spine_side(first), spine_side(second)
    session = first.sparkSession
    both = ["Gain", "Loss"]
    combos = reduce(
        lambda d, m: d.withColumn(m, F.explode(F.array(*[F.lit(x) for x in both]))), measures, session.range(1).drop("id")
    )
    na = a.groupBy(*measures).agg(F.count(F.lit(1)).alias("n_first"))
    nb = b.groupBy(*measures).agg(F.count(F.lit(1)).alias("n_second"))
    nab = a.join(b, [entity, *measures]).groupBy(*measures).agg(F.count(F.lit(1)).alias("n_both"))
    joined = combos
    for d in (na, nb, nab):
        joined = joined.join(d, list(measures), "left")
    filled = joined.na.fill(0)
    least = F.nullif(F.least("n_first", "n_second"), F.lit(0))
    return filled.withColumn("overlap", F.col("n_both") / least)


def population_traits(
    results: DataFrame, traits: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *,
    entity: str, keys: Sequence[str] = ("definition", "measure"),
) -> DataFrame:
    """Do gainers and losers differ in a trait? One test per group and trait, corrected."""
    keys = list(keys)
    rejected = results.where(F.col("reject_fdr") == 1).select(*keys, entity, "direction")
    joined = rejected.join(traits, entity, "left")
    side = F.when(F.col("direction") == "Gain", "x").otherwise("y")
    num = joined.select(*keys, "direction", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [*keys, "direction"], list(numeric), "feature", "_x"
    )
    t = twosample.t_test(num.withColumn("_side", side), "_x", "_side", [*keys, "feature"], pooled=True)
    t = t.select(
        *keys, "feature", "p_val",
        F.when(F.col("mean_x") > F.col("mean_y"), "Gain Higher").otherwise("Loss Higher").alias("direction"),
    )
    cat = joined.select(*keys, "direction", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [*keys, "direction"], list(categorical), "feature", "_x"
    )
    chi = twosample.chi2_test(cat, "direction", "_x", [*keys, "feature"]).select(
        *keys, "feature", "p_val", F.lit("Categorical").alias("direction")
    )
    return correct(t.unionByName(chi).dropna(subset=["p_val"]), "p_val", keys)
