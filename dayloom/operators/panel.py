"""Time-series operators on an (entity, day) panel.

A panel holds at most one row per entity and day, so a window over one entity
is bounded by the length of the calendar, however many raw rows that entity
has: raw rows are pre-aggregated to days before they reach these operators.
All windows are keyed by the entity, so a chain of operators needs one shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.functions import scalars as fn


def by_day(entity: str | list[str], date: str):
    return Window.partitionBy(entity).orderBy(date)


def whole(entity: str | list[str]):
    return Window.partitionBy(entity)


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Compute all expressions against the same input, keep column order."""
    kept = [exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in exprs.items() if c not in df.columns])


# ---------------------------------------------------------------- gap filling


def first_row_per_day(df: DataFrame, *, entity: str, date: str, order: Sequence[str]) -> DataFrame:
    """Keep the row that comes first in ``order`` for each entity and day.

    A struct minimum, so the shuffle carries at most one row per key and task.
    """
    rest = [c for c in df.columns if c not in (entity, date)]
    row = F.struct(*[F.col(c) for c in rest])
    key = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(entity, date).agg(F.min_by(row, key).alias("_row"))
    return out.select(entity, date, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def fill_days(df: DataFrame, *, entity: str, date: str) -> DataFrame:
    """Add an all-null row for every missing day between first and last day.

    Each row is stretched up to the day before the entity's next row. That
    needs no spine table and no join, only the window's shuffle.
    """
    following = F.lead(date).over(by_day(entity, date))
    upto = F.greatest(F.coalesce(F.date_sub(following, 1), F.col(date)), F.col(date))
    stretched = df.where(F.col(date).isNotNull()).withColumn("_upto", upto).select(
        "*", F.explode(F.sequence(F.col(date), F.col("_upto"), F.expr("interval 1 day"))).alias("_day")
    )
    real = F.col("_day") == F.col(date)
    cols = []
    for c in df.columns:
        if c == entity:
            cols.append(F.col(c))
        elif c == date:
            cols.append(F.col("_day").alias(c))
        else:
            cols.append(F.when(real, F.col(c)).alias(c))
    return stretched.select(*cols)


def _spine(first: Column, last: Column, freq: str) -> Column:
    """Array of the labels a pandas-style frequency puts between two days."""
    n, unit = re.fullmatch(r"(\d*)([DWM])", freq).groups()
    n = int(n or 1)
    if unit == "D":
        return F.sequence(first, last, F.expr(f"interval {n} day"))
    if unit == "W":  # weeks end on Sunday; dayofweek is 1 there
        start = F.date_add(first, F.pmod(8 - F.dayofweek(first), F.lit(7)).cast("int"))
        over = F.greatest(F.datediff(last, start), F.lit(0))
        steps = F.ceil(over / (7 * n)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps), lambda i: F.date_add(start, (i * 7 * n).cast("int")))
    start = F.last_day(first)
    months = F.months_between(F.last_day(last), start).cast("int")
    steps = F.ceil(months / n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), steps), lambda i: F.last_day(F.add_months(start, (i * n).cast("int")))
    )


def fill_periods(df: DataFrame, freq: str, *, entity: str, date: str) -> DataFrame:
    """Regular spine per entity; a row's values survive only on an exact match.

    ``freq`` is nD (from the entity's first day), nW (Sundays) or nM (month ends).
    """
    if freq in ("D", "1D"):
        return fill_days(df, entity=entity, date=date)
    spine = (
        df.groupBy(entity)
        .agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
        .select(entity, F.explode(_spine(F.col("_lo"), F.col("_hi"), freq)).alias(date))
    )
    return spine.join(df, [entity, date], "left").select(*df.columns)


# ------------------------------------------------------- scaling, missing values


def z_score(df: DataFrame, columns: Sequence[str], *, entity: str) -> DataFrame:
    """(x - mean) / sample std per entity; no spread makes the whole column 0."""
    u = whole(entity)

    def one(c: str) -> Column:
        sd = F.stddev_samp(c).over(u)
        return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col(c) - F.avg(c).over(u)) / sd)

    return _replace(df, {c: one(c) for c in columns})


def interpolate(
    df: DataFrame, columns: Sequence[str], *, entity: str, date: str, inside_only: bool = False
) -> DataFrame:
    """Linear interpolation by row position.

    Leading nulls stay; trailing nulls take the last value unless ``inside_only``.
    The look-ahead runs over the reversed order, because a frame that ends at
    "unbounded following" is re-read for every row.
    """
    forward = by_day(entity, date)
    backward = Window.partitionBy(entity).orderBy(F.desc(date))
    mark = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("i"), F.col(c).cast("double").alias("x")))
        mark[f"_p_{c}"] = F.last(at, True).over(forward.rowsBetween(Window.unboundedPreceding, 0))
        mark[f"_n_{c}"] = F.last(at, True).over(backward.rowsBetween(Window.unboundedPreceding, 0))

    def line(c: str) -> Column:
        p, n, x = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.col(c)
        step = (n.x - p.x) * (F.col("_rn") - p.i) / F.nullif(n.i - p.i, F.lit(0))
        tail = F.when(n.isNull() & p.isNotNull(), F.lit(None) if inside_only else p.x)
        return F.coalesce(x.cast("double"), p.x + step, tail)

    numbered = df.withColumn("_rn", F.row_number().over(forward))
    return numbered.withColumns(mark).withColumns({c: line(c) for c in columns}).select(*df.columns)


def forward_fill(df: DataFrame, columns: Sequence[str], limit: int, *, entity: str, date: str) -> DataFrame:
    w = by_day(entity, date).rowsBetween(-limit, 0)
    return _replace(df, {c: F.last(c, True).over(w) for c in columns})


def backward_fill(df: DataFrame, columns: Sequence[str], limit: int = 7, *, entity: str, date: str) -> DataFrame:
    w = by_day(entity, date).rowsBetween(0, limit)
    return _replace(df, {c: F.first(c, True).over(w) for c in columns})


def entity_means(df: DataFrame, columns: Sequence[str], *, entity: str) -> DataFrame:
    """Attach each column's entity mean as ``<column>_mean``."""
    u = whole(entity)
    return df.withColumns({f"{c}_mean": F.avg(c).over(u) for c in columns})


def fill_with_mean(
    df: DataFrame, columns: Sequence[str], *, entity: str, means_attached: bool = False
) -> DataFrame:
    """Nulls take the entity mean: the current one, or one attached earlier."""
    u = whole(entity)
    out = _replace(
        df,
        {
            c: F.coalesce(F.col(c), F.col(f"{c}_mean") if means_attached else F.avg(c).over(u))
            for c in columns
        },
    )
    return out.drop(*[f"{c}_mean" for c in columns]) if means_attached else out


def prepare(df: DataFrame, columns: Sequence[str], *, entity: str, date: str) -> DataFrame:
    """Fill days, z-score, interpolate, then entity mean for what is left."""
    out = z_score(fill_days(df, entity=entity, date=date), columns, entity=entity)
    out = entity_means(out, columns, entity=entity)
    out = interpolate(out, columns, entity=entity, date=date)
    return fill_with_mean(out, columns, entity=entity, means_attached=True)


# ------------------------------------------------------------------ percentiles


def percentile(c: str, *, entity: str) -> Column:
    """Average rank of ties over the number of known values; null stays null."""
    order = Window.partitionBy(entity).orderBy(F.col(c).asc_nulls_last())
    lowest = F.rank().over(order)
    highest = F.count(c).over(order)  # default frame: everything up to the last peer
    known = F.count(c).over(whole(entity))
    return F.when(F.col(c).isNotNull(), (lowest + highest) / 2 / known)


def add_percentiles(df: DataFrame, columns: Sequence[str], *, entity: str) -> DataFrame:
    return df.withColumns({f"{c}_percentile": percentile(c, entity=entity) for c in columns})


def add_quartile_bins(df: DataFrame, columns: Sequence[str], *, entity: str) -> DataFrame:
    return df.withColumns(
        {f"{c}_percentile": fn.quartile_bin(percentile(c, entity=entity)) for c in columns}
    )


def percentile_label(
    df: DataFrame, column: str, out: str, *, entity: str, hi: float, lo: float,
    reverse: bool = False, raw: bool = False,
) -> DataFrame:
    """Two-sided label on the entity percentile of a column (or on its raw value)."""
    x = F.col(column) if raw else percentile(column, entity=entity)
    return _replace(df, {out: fn.two_sided_label(x, hi, lo, reverse)})


def low_score_rolling(df: DataFrame, column: str, w: int, *, entity: str, date: str) -> DataFrame:
    """Days below the upper bins, summed over 2w rows, as a binned percentile."""
    frame = by_day(entity, date).rowsBetween(-(2 * w - 1), 0)
    out = df.withColumn("sleep_percentile", fn.quartile_bin(percentile(column, entity=entity)))
    out = out.withColumn("bad_sleep", fn.below(F.col("sleep_percentile"), 0.75))
    out = out.withColumn(
        "bad_sleep_rolling",
        F.when(F.count("bad_sleep").over(frame) == 2 * w, F.sum("bad_sleep").over(frame)),
    )
    return add_quartile_bins(out, ["bad_sleep_rolling"], entity=entity)


# -------------------------------------------------------------- rolling windows


def rolling(agg: Callable[[str], Column], c: str, before: int, after: int, *, entity: str, date: str) -> Column:
    """Rolling aggregate that is null unless the frame is full of known values."""
    frame = by_day(entity, date).rowsBetween(-before, after)
    return F.when(F.count(c).over(frame) == before + after + 1, agg(c).over(frame))


def trailing_mean(c: str, n: int, *, entity: str, date: str) -> Column:
    return rolling(F.avg, c, n - 1, 0, entity=entity, date=date)


def centred_mean(c: str, n: int, *, entity: str, date: str) -> Column:
    """Centred mean of n rows; an even frame has one more row before than after."""
    return rolling(F.avg, c, n // 2, (n - 1) // 2, entity=entity, date=date)


def downsample(df: DataFrame, columns: Sequence[str], length: int, *, entity: str, date: str) -> DataFrame:
    """Trailing mean of ``length`` rows at every ``length``-th row, the first left out."""
    means = {c: trailing_mean(c, length, entity=entity, date=date) for c in columns}
    at = F.row_number().over(by_day(entity, date)) - 1
    out = _replace(df, means | {"_at": at})
    return out.where((F.col("_at") > 0) & (F.col("_at") % length == 0)).drop("_at")


def rolling_band(df: DataFrame, c: str, *, entity: str, date: str, n: int = 7) -> DataFrame:
    """Centred mean and std of n rows with a band, raw and scaled within the entity."""
    u, half = whole(entity), n // 2
    mean, sd = f"rolling_{c}", f"rolling_{c}_std"
    out = df.withColumns({
        mean: rolling(F.avg, c, half, half, entity=entity, date=date),
        sd: rolling(F.stddev_samp, c, half, half, entity=entity, date=date),
    })
    centre = F.avg(mean).over(u)
    spread = F.nullif(F.stddev_pop(mean).over(u), F.lit(0.0))
    out = out.withColumns({
        f"{mean}_plus": F.col(mean) + F.col(sd) / 2,
        f"{mean}_minus": F.col(mean) - F.col(sd) / 2,
        f"z_{mean}": (F.col(mean) - centre) / spread,
        f"z_{sd}": F.col(sd) / spread,
    })
    return out.withColumns({
        f"z_{mean}_plus": F.col(f"z_{mean}") + F.col(f"z_{sd}") / 2,
        f"z_{mean}_minus": F.col(f"z_{mean}") - F.col(f"z_{sd}") / 2,
    })


def group_scalers(df: DataFrame, c: str, *, entity: str) -> DataFrame:
    """Entity min, max, mean and population std of a column on every row."""
    u = whole(entity)
    return df.withColumns({
        "min": F.min(c).over(u), "max": F.max(c).over(u),
        "mean": F.avg(c).over(u), "std": F.stddev_pop(c).over(u),
    })


def shift(c: str, k: int, *, entity: str, date: str) -> Column:
    w = by_day(entity, date)
    return F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)


# ------------------------------------------------------- two-sample change score


def _halves_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _kernel_mean(a: Column, b: Column, kernel: Callable[[Column, Column], Column]) -> Column:
    rows = F.transform(a, lambda x: _halves_mean(F.transform(b, lambda y: kernel(x, y))))
    return _halves_mean(rows)


def _kernel_mmd(kernel):
    return lambda a, b: _kernel_mean(a, a, kernel) + _kernel_mean(b, b, kernel) - 2 * _kernel_mean(a, b, kernel)


# two arrays of numbers -> squared discrepancy
ARRAY_MMD: dict[str, Callable[[Column, Column], Column]] = {
    "linear": lambda a, b: (_halves_mean(a) - _halves_mean(b)) * (_halves_mean(a) - _halves_mean(b)),
    "rbf": _kernel_mmd(lambda x, y: F.exp(-(x - y) * (x - y))),
    "poly": _kernel_mmd(lambda x, y: (x * y) * (x * y)),
}


def window_test(values: Column, size: int, test: Callable[[Column, Column], Column]) -> Column:
    """Apply a two-sample function to the halves of an array of exactly 2 * size."""
    return F.when(
        F.size(values) == 2 * size,
        test(F.slice(values, 1, size), F.slice(values, size + 1, size)),
    )


def rolling_mmd(c: str, w: int, *, entity: str, date: str, kind: str = "linear") -> Column:
    """Discrepancy between the w rows before a row and the w rows from it on."""
    base = by_day(entity, date)
    full = F.count(c).over(base.rowsBetween(-w, w - 1)) == 2 * w
    if kind == "linear":  # difference of two rolling means: nothing to collect
        gap = F.avg(c).over(base.rowsBetween(-w, -1)) - F.avg(c).over(base.rowsBetween(0, w - 1))
        return F.when(full, gap * gap)
    both = F.collect_list(c).over(base.rowsBetween(-w, w - 1))
    return F.when(full, window_test(both, w, ARRAY_MMD[kind]))


def rolling_mmd_average(
    df: DataFrame, columns: Sequence[str], w: int, *, entity: str, date: str, kind: str = "linear"
) -> DataFrame:
    """Rolling score of each column and the mean of the scores that are known."""
    out = df.withColumns(
        {f"{c}_MMD": rolling_mmd(c, w, entity=entity, date=date, kind=kind) for c in columns}
    )
    total = sum((F.coalesce(F.col(f"{c}_MMD"), F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.col(f"{c}_MMD").isNotNull().cast("int") for c in columns), F.lit(0))
    return out.withColumn("average_MMD", total / F.nullif(known, F.lit(0)))


# --------------------------------------------------------------- labels in time


def pad_label(df: DataFrame, label: str, buffer: int, *, entity: str, date: str) -> DataFrame:
    """Spread hits of a 0/1 label over ``buffer`` days on both sides.

    Hits are taken greedily in time order, the next one at least buffer + 1 rows
    later; the first and last ``buffer`` rows are not scanned. The fold runs over
    the positions of an entity's hits, which the calendar bounds.
    """
    w, u = by_day(entity, date), whole(entity)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(u)})
    scanned = (F.col("_i") >= buffer) & (F.col("_i") < F.col("_n") - buffer) & (F.col(label) == 1)
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("hits"))
    picked = F.aggregate(
        F.col("_at"),
        start,
        lambda s, i: F.when(
            i >= s.next,
            F.struct((i + buffer + 1).alias("next"), F.concat(s.hits, F.array(i)).alias("hits")),
        ).otherwise(s),
        lambda s: s.hits,
    )
    near = F.sequence(F.col("_hit") - buffer, F.col("_hit") + buffer)
    marked = (
        rows.where(scanned)
        .groupBy(entity)
        .agg(F.sort_array(F.collect_list("_i")).alias("_at"))
        .select(entity, F.explode(picked).alias("_hit"))
        .select(entity, F.explode(near).alias("_i"))
        .distinct()
        .withColumn("_mark", F.lit(True))
    )
    out = rows.join(marked, [entity, "_i"], "left")
    return _replace(out, {label: F.when(F.col("_mark"), 1.0).otherwise(F.col(label))}).select(*df.columns)


def label_runs(df: DataFrame, label: str, *, entity: str | list[str], date: str) -> DataFrame:
    """Number the runs of equal labels in time.

    Only labels 0, 1 and 2 form runs; the entity's last row is a run by itself.
    """
    w, u = by_day(entity, date), whole(entity)
    known = F.coalesce(F.col(label).isin(0, 1, 2), F.lit(False))
    same = known & F.coalesce(F.col(label) == F.lag(label).over(w), F.lit(False))
    last = F.row_number().over(w) == F.count(F.lit(1)).over(u)
    marked = df.withColumn("_new", F.when(same & ~last, 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(w).cast("int")).drop("_new")
