"""Two-sample statistics by group, for groups of any size.

Input is long: key columns, a sample flag (``"x"`` or ``"y"``) and a value or
vector. Every statistic is built from sums that combine map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import comb, factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from dayloom.functions import scalars as fn, tails
from dayloom.operators import ordered
from dayloom.operators.lookup import looked_up


def _by(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys)


# --------------------------------------------------------------------- kernels


def mmd_linear(df: DataFrame, vector: str, sample: str, keys: Sequence[str] = ()) -> DataFrame:
    """Squared distance of the two mean vectors."""
    long = df.select(*keys, sample, F.posexplode(vector).alias("_i", "_x"))
    side = lambda s: F.avg(F.when(F.col(sample) == s, F.col("_x").cast("double")))
    gap = long.groupBy(*keys, "_i").agg((side("x") - side("y")).alias("_d"))
    return _by(gap, keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("mmd"))


def mmd_poly(
    df: DataFrame, vector: str, sample: str, keys: Sequence[str] = (),
    degree: int = 2, gamma: float = 1.0, coef0: float = 0.0,
) -> DataFrame:
    """Polynomial-kernel discrepancy without looking at any pair of rows.

    The mean of <x, y>^k over all pairs is the inner product of the samples'
    k-th moment tensors, so the statistic is a weighted sum of squared moment
    differences. Tasks add up moments of their own rows in NumPy and ship one
    number per moment.
    """
    keys = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}

        def flush():
            out = []
            for key, got in held.items():
                for mono, total in zip(got["monos"], got["sums"]):
                    out.append((*key, ",".join(map(str, mono)), float(total), got["n"]))
            held.clear()
            return pd.DataFrame(out, columns=[*keys, sample, "_mono", "_sum", "_n"])

        for pdf in batches:
            for key, part in pdf.groupby([*keys, sample], sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(part[vector].to_numpy()).astype(float)
                monos = [m for k in range(1, degree + 1) for m in combinations_with_replacement(range(x.shape[1]), k)]
                if key not in held:
                    held[key] = {"monos": monos, "sums": np.zeros(len(monos)), "n": 0}
                sums, at = [x.sum(0)], 1
                if degree >= 2:
                    second = x.T @ x
                    sums.append(second[np.triu_indices(x.shape[1])])
                    at = 2
                for k in range(at + 1, degree + 1):
                    sums.append(np.array([x[:, list(m)].prod(1).sum() for m in combinations_with_replacement(range(x.shape[1]), k)]))
                held[key]["sums"] += np.concatenate(sums)
                held[key]["n"] += len(part)
            if len(held) > 200:
                yield flush()
        if held:
            yield flush()

    slim = df.select(*keys, sample, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != vector)
    moments = slim.mapInPandas(partial, f"{kinds}, _mono string, _sum double, _n long")
    side = lambda s: F.sum(F.when(F.col(sample) == s, F.col("_sum"))) / F.sum(F.when(F.col(sample) == s, F.col("_n")))
    gap = moments.groupBy(*keys, "_mono").agg((side("x") - side("y")).alias("_d"))

    @F.pandas_udf(DoubleType())
    def weight(mono: pd.Series) -> pd.Series:
        def one(m: str) -> float:
            parts = m.split(",")
            k = len(parts)
            repeats = factorial(k) // prod(factorial(parts.count(p)) for p in set(parts))
            return comb(degree, k) * gamma**k * float(coef0) ** (degree - k) * repeats

        return mono.map(one)

    return _by(gap, keys).agg(F.sum(weight("_mono") * F.col("_d") * F.col("_d")).alias("mmd"))


def mmd_rbf(
    df: DataFrame, vector: str, sample: str, keys: Sequence[str] = (), gamma: float = 1.0, block_rows: int = 8192
) -> DataFrame:
    """Gaussian-kernel discrepancy, diagonals included.

    The statistic is defined over all pairs, so its work is quadratic in the different
    vectors of a group. Equal vectors of a sample become one with a weight. The rest is
    hashed into blocks of some ``block_rows``, what a task may hold; every pair of blocks
    is one group of rows that returns three sums. A vector is sent once for every block,
    which is the square root of twice the number of these groups, and no pair of vectors
    is ever a row. Rows with a null vector or another sample take no part; a group that
    lacks a sample has a null result.
    """
    keys = list(keys)
    known = df.where(F.col(vector).isNotNull() & F.col(sample).isin("x", "y"))
    cast = F.transform(vector, lambda v: v.cast("double"))
    alike = known.select(*keys, F.col(sample).alias("_s"), cast.alias("_v")).groupBy(*keys, "_s", "_v").agg(
        F.count(F.lit(1)).alias("_w")
    )
    many = F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")
    if keys:
        one = F.struct(*keys).alias("_key")  # a struct of nulls is not null: groups without a key stay
        sized = looked_up(alike.withColumn("_key", one), "_key", alike.groupBy(one).agg(many), "_v").drop("_key")
    else:
        sized = alike.crossJoin(F.broadcast(alike.agg(many)))  # one row
    block = F.pmod(F.xxhash64("_v", "_s"), F.col("_blocks")).cast("int")
    sent = sized.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.select(
        *keys, F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_b", "_s", "_v", "_w"
    )

    def kernel_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], step: int = 1024) -> float:
        (av, aw), (bv, bw) = a, b
        total = 0.0
        for i in range(0, len(aw), step):
            for j in range(0, len(bw), step):
                x, y = av[i:i + step], bv[j:j + step]
                d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
                total += float(aw[i:i + step] @ np.exp(-gamma * np.maximum(d2, 0)) @ bw[j:j + step])
        return total

    names = ["_xx", "_yy", "_xy", "_nx", "_ny"]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[-2:]

        def side(block: int, s: str) -> tuple[np.ndarray, np.ndarray]:
            rows = pdf[(pdf["_b"] == block) & (pdf["_s"] == s)]
            if not len(rows):
                return np.zeros((0, 1)), np.zeros(0)
            return np.stack(rows["_v"].to_numpy()).astype(float), rows["_w"].to_numpy().astype(float)

        def pair(a, b) -> float:
            return kernel_sum(a, b) if len(a[1]) and len(b[1]) else 0.0

        x, y = side(lo, "x"), side(lo, "y")
        if lo == hi:
            got = (pair(x, x), pair(y, y), pair(x, y), x[1].sum(), y[1].sum())
        else:
            x2, y2 = side(hi, "x"), side(hi, "y")
            got = (2 * pair(x, x2), 2 * pair(y, y2), pair(x, y2) + pair(x2, y), 0.0, 0.0)
        return pd.DataFrame([(*key[:-2], *got)], columns=[*keys, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name in keys]
    part = sent.groupBy(*keys, "_lo", "_hi").applyInPandas(sums, ", ".join([*kinds, *[f"{c} double" for c in names]]))
    total = _by(part, keys).agg(*[F.sum(c).alias(c) for c in names])
    mean = lambda total_, a, b: F.col(total_) / F.nullif(F.col(a) * F.col(b), F.lit(0.0))
    mmd = mean("_xx", "_nx", "_nx") + mean("_yy", "_ny", "_ny") - 2 * mean("_xy", "_nx", "_ny")
    return total.select(*keys, mmd.alias("mmd"))


# ---------------------------------------------------------------------- t tests


def t_test(df: DataFrame, value: str, sample: str, keys: Sequence[str] = (), pooled: bool = False) -> DataFrame:
    """Welch (default) or pooled two-sample t: t, df, p and both means."""
    x, y = (F.when(F.col(sample) == s, F.col(value)) for s in ("x", "y"))
    m = _by(df.where(F.col(value).isNotNull()), keys).agg(
        F.avg(x).alias("mean_x"), F.var_samp(x).alias("_vx"), F.count(x).alias("nx"),
        F.avg(y).alias("mean_y"), F.var_samp(y).alias("_vy"), F.count(y).alias("ny"),
    )
    nx, ny, vx, vy = (F.col(c) for c in ("nx", "ny", "_vx", "_vy"))
    if pooled:
        # a sample of one has no variance of its own and adds nothing to the pool
        dof = (nx + ny - 2).cast("double")
        pool = (F.coalesce((nx - 1) * vx, F.lit(0.0)) + F.coalesce((ny - 1) * vy, F.lit(0.0))) / F.nullif(dof, F.lit(0.0))
        se = F.when((nx > 0) & (ny > 0), F.sqrt(pool * (1 / F.nullif(nx, F.lit(0)) + 1 / F.nullif(ny, F.lit(0)))))
    else:
        a, b = vx / F.nullif(nx, F.lit(0)), vy / F.nullif(ny, F.lit(0))
        se = F.sqrt(a + b)
        dof = (a + b) * (a + b) / F.nullif(
            a * a / F.nullif(nx - 1, F.lit(0)) + b * b / F.nullif(ny - 1, F.lit(0)), F.lit(0.0)
        )
    t = (F.col("mean_x") - F.col("mean_y")) / F.nullif(se, F.lit(0.0))
    out = m.withColumns({"t": t, "df": dof})
    return out.withColumn("p_val", tails.t_p_value(F.col("t"), F.col("df"))).drop("_vx", "_vy")


# ---------------------------------------------------------------------- KS, chi2


def ks_statistic(
    df: DataFrame, value: str, sample: str, keys: Sequence[str], *,
    block_rows: int = ordered.BLOCK_ROWS, small_groups: bool = False,
) -> DataFrame:
    """Largest gap of the two empirical distribution functions, and the mean of x.

    Equal values collapse to one row of counts before the running totals, and
    a group with very many distinct values runs in blocks of its value range.
    ``small_groups`` skips the size check where the caller bounds the groups.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    is_ = lambda s: F.count_if(F.col(sample) == s)
    counts = known.groupBy(*keys, value).agg(is_("x").alias("_cx"), is_("y").alias("_cy"))
    largest = 0 if small_groups else ordered.largest_group(known, keys)
    walk = ordered.Ordered(counts, keys, value, largest=largest, block_rows=block_rows)
    walk.running_sum("_sx", F.col("_cx")).running_sum("_sy", F.col("_cy"))
    totals = counts.groupBy(*keys).agg(
        F.sum("_cx").alias("nx"), F.sum("_cy").alias("ny"),
        (F.sum(F.col(value) * F.col("_cx")) / F.nullif(F.sum("_cx"), F.lit(0))).alias("mean_x"),
    ).where("nx > 0 and ny > 0")
    gap = F.abs(F.col("_sx") / F.col("nx") - F.col("_sy") / F.col("ny"))
    joined = walk.result().join(totals, keys)
    return joined.groupBy(*keys, "nx", "ny", "mean_x").agg(F.max(gap).alias("d"))


def ks_test(
    df: DataFrame, value: str, sample: str, keys: Sequence[str], *, method: str = "exact", **sizes
) -> DataFrame:
    """KS statistic with its two-sided p; ``method`` as in ``tails.ks_two_sided``."""
    out = ks_statistic(df, value, sample, keys, **sizes)
    return out.withColumn("p_val", tails.ks_p_value(F.col("d"), F.col("nx"), F.col("ny"), method))


def correlation_test(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = _by(both, keys).agg(F.count(F.lit(1)).alias("n"), fn.correlation(a, b).alias("r"))
    return out.withColumn("p_val", tails.pearson_p_value(F.col("r"), F.col("n")))


def contingency(df: DataFrame, a: str, b: str, levels: Sequence | None = None) -> DataFrame:
    """Counts of a (rows) by b (columns)."""
    grouped = df.dropna(subset=[a, b]).groupBy(a)
    return (grouped.pivot(b, list(levels)) if levels else grouped.pivot(b)).count().na.fill(0)


def chi2_test(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Independence test of two categories per group; 2 x 2 tables get Yates' correction.

    Works on the table's cells: empty cells need no rows, because the expected
    counts add up to n. A table with a single row or column gives statistic 0, p 1.
    """
    keys = list(keys)
    cells = df.dropna(subset=[a, b]).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_o"))
    per = lambda name, *c: cells.groupBy(*keys, *c).agg(F.sum("_o").cast("double").alias(name))
    rows, cols, total = per("_rm", a), per("_cm", b), per("_n")
    spread = lambda t, m, size, inverse: t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(size), F.sum(1 / F.col(m)).alias(inverse)
    )
    join = lambda left, right, on: left.join(right, on) if on else left.crossJoin(F.broadcast(right))  # one row
    e = join(join(join(cells, rows, [*keys, a]), cols, [*keys, b]), total, keys)
    e = e.withColumn("_e", F.col("_rm") * F.col("_cm") / F.col("_n"))
    stat = _by(e, keys).agg(
        F.sum(F.col("_o") * F.col("_o") / F.col("_e")).alias("_s"),
        F.max(F.abs(F.col("_o") - F.col("_e"))).alias("_d"),
        F.first("_n").alias("_n"),
    )
    full = join(join(stat, spread(rows, "_rm", "_r", "_ir"), keys), spread(cols, "_cm", "_c", "_ic"), keys)
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    moved = F.greatest(F.col("_d") - 0.5, F.lit(0.0))
    chi2 = (
        F.when(dof == 0, 0.0)
        .when(dof == 1, moved * moved * F.col("_n") * F.col("_ir") * F.col("_ic"))
        .otherwise(F.col("_s") - F.col("_n"))
    )
    out = full.select(*keys, F.col("_n").cast("long").alias("n"), dof.cast("long").alias("dof"), chi2.alias("chi2"))
    p = F.when(F.col("dof") == 0, 1.0).otherwise(tails.chi2_p_value(F.col("chi2"), F.col("dof")))
    return out.withColumn("p_val", p)


def proportions(df: DataFrame, by: str, value: str) -> DataFrame:
    """Percent of each value within each group."""
    counts = df.dropna(subset=[by, value]).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    return counts.join(total, by).select(by, value, (F.col("n") / F.col("_t") * 100).alias("proportion"))


def histogram(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """Counts by bins of width alpha, with the number of values below alpha."""
    bin_ = F.floor(F.col(p) / F.lit(alpha)).cast("int")
    counts = df.where(F.col(p).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    below = df.agg(F.count_if(F.col(p) < alpha).alias("n_below"), F.count(p).alias("n_tests"))  # one row
    return counts.crossJoin(F.broadcast(below))
