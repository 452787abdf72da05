"""Near-independent days: runs of equal labels, averaged or thinned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.operators import panel, sampling


def sized_runs(
    df: DataFrame, label: str, *, entity: str, date: str, group: Sequence[str] = (), limit: int = 0, at_least: int = 0
) -> DataFrame:
    """Days with their run and its length ``g``.

    ``at_least`` leaves out panels of which ``sample_runs`` cannot draw so many rows (``drawable``).
    """
    numbered = panel.label_runs(df, label, entity=[entity, *group], date=date)
    sized = numbered.withColumn("g", F.count(F.lit(1)).over(Window.partitionBy(entity, *group, "run")))
    if not at_least:
        return sized
    return drawable(sized, label, limit=limit, at_least=at_least, entity=entity, date=date, group=group)


def ranked_runs(
    df: DataFrame, label: str, *, boots: int, seed: str, entity: str, date: str, group: Sequence[str] = (),
    limit: int = 0, at_least: int = 0,
) -> DataFrame:
    """Runs with their length ``g`` and a random order ``r`` of their days per bootstrap."""
    sized = sized_runs(df, label, limit=limit, at_least=at_least, entity=entity, date=date, group=group)
    drawn = sampling.with_boots(sized, boots)
    order = sampling.hash_order(entity, date, "boot", seed=seed)
    w = Window.partitionBy(entity, *group, "boot", "run").orderBy(order, date)
    return drawn.withColumn("r", F.row_number().over(w))


def condition(label: Column) -> Column:
    return F.when(label == 0, "no_stress").when(label.isin(1, 2), "stress")


def drawable(
    sized: DataFrame, label: str, *, limit: int, at_least: int, entity: str, date: str, group: Sequence[str] = ()
) -> DataFrame:
    """Panels whose runs can give ``at_least`` rows of either condition, and that have as many days.

    How many rows a run gives depends on its length, not on the draw, so a panel that is too
    short is known before its days are repeated for every bootstrap.
    """
    sizes = _with_given(sized, label, "_rows", limit=limit, entity=entity, date=date, group=group)
    return sizes.where(F.col("_rows") >= at_least).drop("_rows")


def _with_given(
    sized: DataFrame, label: str, name: str, *, limit: int, entity: str, date: str, group: Sequence[str] = ()
) -> DataFrame:
    u = Window.partitionBy(entity, *group)
    nth = F.row_number().over(Window.partitionBy(entity, *group, "run").orderBy(date))  # a run has one condition
    most = F.when(F.col("g") <= limit, 1).otherwise(F.floor(F.col("g") / 2))
    counted = sized.withColumn("_given", F.when(nth <= most, condition(F.col(label))))
    given = lambda c: F.count_if(F.col("_given") == c).over(u)
    sizes = counted.withColumn(name, F.least(given("stress"), given("no_stress"), F.count(F.lit(1)).over(u)))
    return sizes.drop("_given")


def with_drawable(df: DataFrame, label: str, name: str, *, limit: int, entity: str, date: str) -> DataFrame:
    """Add how many rows of either condition an entity's runs can give, at most its days."""
    sized = panel.label_runs(df, label, entity=[entity], date=date)
    sized = sized.withColumn("g", F.count(F.lit(1)).over(Window.partitionBy(entity, "run")))
    return _with_given(sized, label, name, limit=limit, entity=entity, date=date).drop("run", "g")


def sample_runs(
    df: DataFrame, features: Sequence[str], label: str, *, limit: int, boots: int, seed: str,
    entity: str, date: str, with_days: bool = False, group: Sequence[str] = (), at_least: int = 0,
) -> DataFrame:
    """One row for a run of 1, one mean row for a run up to ``limit``, half the days of a longer one.

    Rows labelled 0 become ``no_stress``, 1 and 2 ``stress``, others are dropped.
    ``with_days`` also returns every single day as ``day``. Every step is keyed
    by the entity first, so one shuffle serves them all. ``group`` names further keys
    that tell panels of one entity apart; draws do not depend on them. ``at_least`` leaves out
    panels that cannot give so many rows of either condition.
    """
    rows = ranked_runs(
        df, label, boots=boots, seed=seed, entity=entity, date=date, group=group, limit=limit, at_least=at_least
    )
    g, r, y = F.col("g"), F.col("r"), F.col(label)
    cond = condition(y)
    kept = y.isin(0, 1, 2) & ((g <= limit) | (r <= F.floor(g / 2)))
    slot = F.when((g >= 2) & (g <= limit), 0).otherwise(r)
    role = lambda c, s: F.struct(c.alias("cond"), s.cast("int").alias("slot"))
    roles = [F.when(kept, role(cond, slot))]
    if with_days:
        roles.append(role(F.lit("day"), r))
    parts = rows.withColumn("_role", F.explode(F.array_compact(F.array(*roles))))
    return (
        parts.groupBy(entity, *group, "boot", F.col("_role.cond").alias("cond"), "run", F.col("_role.slot").alias("_slot"))
        .agg(F.min(date).alias(date), *[F.avg(c).alias(c) for c in features])
        .drop("run", "_slot")
    )
