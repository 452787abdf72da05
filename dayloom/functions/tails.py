"""Tail probabilities as Arrow-batched pandas UDFs (NumPy and math only)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.lgamma, 1, 1)(x).astype(float)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1 + coef * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    low = inner < (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1 - inner)
    part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(low, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        p = incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(np.isinf(t), 0.0, p)


def chi2_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square law through the incomplete gamma function."""
    s, z = np.asarray(dof, float) / 2, np.asarray(x, float) / 2
    zz = np.maximum(z, 1e-300)
    front = np.exp(-zz + s * np.log(zz) - _lgamma(s))
    term = 1 / s
    series = term.copy()
    for k in range(1, 1000):
        term = term * zz / (s + k)
        series = series + term
        if np.all(term < 1e-16 * series):
            break
    b = zz + 1 - s
    c = np.full_like(zz, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    frac = d.copy()
    for k in range(1, 1000):
        an = -k * (k - s)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        frac = frac * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(zz < s + 1, 1 - front * series, front * frac)
    return np.where(z <= 0, 1.0, np.clip(out, 0, 1))


def ks_two_sided(d: float, m: int, n: int, method: str = "exact") -> float:
    """P(D >= d) for two samples of sizes m and n.

    ``exact`` counts lattice paths that stay inside the band, as shares of all
    paths; ``series`` is the asymptotic one. The caller chooses, the sizes never do.
    """
    if method == "series":
        z = d * math.sqrt(m * n / (m + n))
        if z < 0.2:
            return 1.0
        return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))
    if method != "exact":
        raise ValueError(f"unknown method {method}")
    return _ks_equal(round(d * n), n) if m == n else _ks_paths(d, m, n)


def _ks_equal(h: int, n: int) -> float:
    """Equal sizes: alternating sum of C(2n, n - kh) / C(2n, n), reflections at the band."""
    if h == 0:
        return 1.0
    p, ratio, at = 0.0, 1.0, 0
    for k in range(1, n // h + 1):
        steps = np.arange(at, k * h)
        ratio *= float(np.prod((n - steps) / (n + steps + 1)))
        at = k * h
        p += (-1) ** (k - 1) * ratio
        if ratio < 1e-18:
            break
    return min(1.0, max(0.0, 2 * p))


def _ks_paths(d: float, m: int, n: int) -> float:
    """Unequal sizes: walks the anti-diagonals i + j, each one vector over the band.

    ``inside[i]`` is the chance that a random path is at (low + i, step - low - i) and
    has not left the band; a step draws from what is left of either sample. The result
    is the sum of what each step puts beyond the band: only positive terms, so a small
    tail keeps its digits where 1 - inside would end at 1e-16.
    """
    lcm = m * n // math.gcd(m, n)
    limit = round(d * lcm)
    if limit == 0:
        return 1.0
    a, b = lcm // m, lcm // n
    inside, low, left = np.ones(1), 0, 0.0
    for step in range(1, m + n + 1):
        i = np.arange(low, low + len(inside) + 1)
        old = np.concatenate(([0.0], inside, [0.0]))
        reach = (old[:-1] * (m - i + 1) + old[1:] * (n - step + i + 1)) / (m + n - step + 1)
        # |i a - (step - i) b| < limit, 0 <= i <= m, 0 <= step - i <= n
        lo = max(low, step - n, (step * b - limit) // (a + b) + 1)
        hi = min(low + len(inside), m, -((-step * b - limit) // (a + b)) - 1)
        if lo > hi:
            return 1.0
        left += float(reach[: lo - low].sum() + reach[hi - low + 1 :].sum())
        inside, low = reach[lo - low : hi - low + 1], lo
    return min(1.0, left)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (~pd.isna(t) & ~pd.isna(df) & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok] = t_two_sided(t.to_numpy(float)[ok], df.to_numpy(float)[ok])
    return pd.Series(out).astype("Float64").where(pd.Series(ok), pd.NA)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    ok = (~pd.isna(x) & ~pd.isna(dof) & (dof > 0)).to_numpy()
    out = np.full(len(x), np.nan)
    if ok.any():
        out[ok] = chi2_tail(x.to_numpy(float)[ok], dof.to_numpy(float)[ok])
    return pd.Series(out).astype("Float64").where(pd.Series(ok), pd.NA)


def _ks_p(method: str):
    """KS tails; a batch computes every different (statistic, sizes) once."""

    @F.pandas_udf(DoubleType())
    def p(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        asked = pd.DataFrame({"d": d, "m": m, "n": n})
        known = asked[asked.notna().all(axis=1) & (asked[["m", "n"]] >= 1).all(axis=1)]
        different = known.drop_duplicates()
        tails = [ks_two_sided(float(x), int(y), int(z), method) for x, y, z in different.to_numpy()]
        named = known.merge(different.assign(p=tails), on=["d", "m", "n"], how="left").set_axis(known.index)
        return named["p"].reindex(asked.index).astype("Float64")

    return p


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p(t.cast("double"), df.cast("double"))


def chi2_p_value(x: Column, dof: Column) -> Column:
    return _chi2_p(x.cast("double"), dof.cast("double"))


def ks_p_value(d: Column, m: Column, n: Column, method: str = "exact") -> Column:
    """Two-sided KS tail; ``method`` is ``exact`` or ``series``."""
    return _ks_p(method)(d.cast("double"), m.cast("long"), n.cast("long"))


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation; two points always give 1."""
    dof = n - 2
    rest = F.lit(1.0) - r * r
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(r * F.sqrt(dof / rest))
    return F.when(r.isNull() | F.isnan(r), None).when(dof <= 0, 1.0).otherwise(t_p_value(t, dof))
