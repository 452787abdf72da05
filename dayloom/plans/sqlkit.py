"""SQL fragments shared by the twins of the panel queries."""

from __future__ import annotations

W = "PARTITION BY user_id ORDER BY date"


def z_score(src: str, out: str, cols) -> str:
    e = ", ".join(
        f"CASE WHEN coalesce(stddev_samp({c}) OVER (PARTITION BY user_id), 0) = 0 THEN 0 ELSE "
        f"({c} - avg({c}) OVER (PARTITION BY user_id)) / stddev_samp({c}) OVER (PARTITION BY user_id) END AS {c}"
        for c in cols
    )
    return f"{out} AS (SELECT * REPLACE ({e}) FROM {src})"


def interpolate(src: str, out: str, cols, inside_only: bool = False) -> str:
    fore = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    back = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    marks = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER {fore} AS p_{c}, first_value({c} IGNORE NULLS) OVER {back} AS n_{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER {fore} AS pi_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER {back} AS ni_{c}"
        for c in cols
    )
    tail = "NULL" if inside_only else "p_{c}"
    e = ", ".join(
        f"CAST(CASE WHEN {c} IS NOT NULL THEN {c} WHEN n_{c} IS NULL THEN {tail.format(c=c)} "
        f"WHEN p_{c} IS NULL THEN NULL "
        f"ELSE p_{c} + (n_{c} - p_{c}) * (rn - pi_{c}) / (ni_{c} - pi_{c}) END AS DOUBLE) AS {c}"
        for c in cols
    )
    drop = ", ".join(["rn"] + [f"{p}_{c}" for c in cols for p in ("p", "n", "pi", "ni")])
    return (
        f"{out}_rn AS (SELECT *, row_number() OVER ({W}) AS rn FROM {src}),\n"
        f"{out}_mk AS (SELECT *, {marks} FROM {out}_rn),\n"
        f"{out} AS (SELECT * EXCLUDE ({drop}) REPLACE ({e}) FROM {out}_mk)"
    )


def percentile(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY user_id ORDER BY {c} NULLS LAST) + "
        f"count({c}) OVER (PARTITION BY user_id ORDER BY {c} NULLS LAST)) / 2.0 / count({c}) OVER (PARTITION BY user_id) END"
    )


def bins(p: str) -> str:
    return f"CAST(CASE WHEN {p} <= 0.25 THEN 0.25 WHEN {p} <= 0.75 THEN 0.75 WHEN {p} IS NOT NULL THEN 1.0 END AS DOUBLE)"


def label(p: str, hi=0.75, lo=0.25, one=1, zero=0) -> str:
    return f"CASE WHEN {p} >= {hi} THEN {one} WHEN {p} < {lo} THEN {zero} END"


def mmd(c: str, w: int) -> str:
    return (
        f"CASE WHEN count({c}) OVER ({W} ROWS BETWEEN {w} PRECEDING AND {w - 1} FOLLOWING) = {2 * w} THEN "
        f"(avg({c}) OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) - "
        f"avg({c}) OVER ({W} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) ** 2 END"
    )


def full_frame(agg: str, c: str, before: int, after: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count({c}) {f} = {before + after + 1} THEN {agg}({c}) {f} END"


def runs(src: str, out: str, label_col: str) -> str:
    return (
        f"{out}_new AS (SELECT *, CASE WHEN {label_col} IN (0, 1, 2) AND {label_col} = lag({label_col}) OVER ({W}) "
        f"AND row_number() OVER ({W}) < count(*) OVER (PARTITION BY user_id) THEN 0 ELSE 1 END AS is_new FROM {src}),\n"
        f"{out} AS (SELECT * EXCLUDE (is_new), CAST(sum(is_new) OVER ({W}) AS INTEGER) AS run FROM {out}_new)"
    )


def student_p(t: str, nu: str, steps: int = 2000) -> str:
    """Two-sided t tail: ratio of two Simpson integrals of sin^(nu - 1).

    The angle is s^4, which makes the integrand flat at 0 for every nu >= 1.
    """
    f = lambda top: (
        f"list_sum(list_transform(range(0, {steps} + 1), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
        f"sin((sqrt(sqrt({top})) * i / {steps}) ** 4) ** ({nu} - 1) * 4 * (sqrt(sqrt({top})) * i / {steps}) ** 3)) * sqrt(sqrt({top}))"
    )
    return f"({f(f'atan2(sqrt({nu}), abs({t}))')}) / ({f('1.5707963267948966')})"


def ks_lattice(src: str, out: str) -> str:
    """Chance that a random lattice path from (0, 0) to (nx, ny) leaves the band, as ``p_val``.

    One row per different (nx, ny, h) of ``src``; ``s`` is a diagonal of chances to be
    still inside |i ny - j nx| < h, walked by recursion.
    """
    i, j = "i", "(step + 1 - i)"
    come = f"(CASE WHEN {i} > 0 THEN s[{i}] * (nx - {i} + 1) ELSE 0 END + s[{i} + 1] * (ny - step + {i}))"
    return (
        f"{out}_w AS (SELECT DISTINCT nx, ny, h, CAST(0 AS BIGINT) AS step, "
        f"list_transform(range(0, nx + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM {src} "
        f"UNION ALL SELECT nx, ny, h, step + 1, list_transform(range(0, nx + 1), lambda i: "
        f"CASE WHEN {i} <= step + 1 AND {j} <= ny AND abs({i} * ny - {j} * nx) < h THEN {come} / (nx + ny - step) ELSE 0.0::DOUBLE END) "
        f"FROM {out}_w WHERE step < nx + ny),\n"
        f"{out} AS (SELECT nx, ny, h, greatest(0, 1 - s[nx + 1]) AS p_val FROM {out}_w WHERE step = nx + ny)"
    )


def chi2_p(x: str, dof: str, steps: int = 4000, top: float = 40.0) -> str:
    """Upper chi-square tail: ratio of two Simpson integrals of u^(k-1) exp(-u^2/2)."""
    u = lambda lo: f"(({lo}) + ({top} - ({lo})) * i / {steps})"
    f = lambda lo: (
        f"list_sum(list_transform(range(0, {steps} + 1), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
        f"({u(lo)} ** ({dof} - 1)) * exp(-{u(lo)} * {u(lo)} / 2))) * ({top} - ({lo}))"
    )
    return f"({f(f'sqrt({x})')}) / ({f('0.0')})"


def noisy(c: str, i: int, sigma: float = 0.001) -> str:
    """Column plus the i-th draw of the md5 columns h0, h1, ..."""
    word = lambda k: f"CAST('0x' || substr(h{i // 4}, {8 * k + 1}, 8) AS BIGINT)"
    pair = 2 * ((i % 4) // 2)
    turn = "sin" if i % 2 else "cos"
    return (
        f"{c} + {sigma} * sqrt(-2.0 * ln(({word(pair)} + 1) / 4294967297.0)) * "
        f"{turn}(6.283185307179586 * ({word(pair + 1)} / 4294967296.0))"
    )
