"""Two-sample statistics, corrections, rejection tables and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.operators import inference, panel, spectrum, twosample
from dayloom.plans import fixtures as fx, sqlkit as sk
from dayloom.plans.fixtures import FILLED, ONCE, PANEL, PVALS
from dayloom.plans.registry import query, r6, r6s, tidy

K = {"entity": "user_id", "date": "date"}


# -------------------------------------------------------------- two-sample tests

def _vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings").where("label in (0, 1)")
    return e.select("vec_id", "embedding", F.when(F.col("label") == 0, "x").otherwise("y").alias("side"))


E = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label = 0 THEN 'x' ELSE 'y' END AS side FROM embeddings WHERE label IN (0, 1))"""


@query("ST01_mmd_linear", f"""WITH {E}, l AS (SELECT side, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
  m AS (SELECT i, avg(x) FILTER (WHERE side = 'x') - avg(x) FILTER (WHERE side = 'y') AS d FROM l GROUP BY i)
  SELECT {r6('sum(d * d)', 'mmd')} FROM m""")
def _(spark, sf):
    return tidy(twosample.mmd_linear(_vectors(spark, sf), "embedding", "side"))


def _pairs_sql(kernel: str) -> str:
    return f"""WITH {E}, p AS (SELECT a.side AS s1, b.side AS s2, {kernel} AS k FROM e a CROSS JOIN e b)
  SELECT {r6("avg(k) FILTER (WHERE s1 = 'x' AND s2 = 'x') + avg(k) FILTER (WHERE s1 = 'y' AND s2 = 'y') - 2 * avg(k) FILTER (WHERE s1 = 'x' AND s2 = 'y')", 'mmd')} FROM p"""


@query("ST02_mmd_rbf", _pairs_sql("exp(-1 * list_distance(a.v, b.v) * list_distance(a.v, b.v))"))
def _(spark, sf):
    return tidy(twosample.mmd_rbf(_vectors(spark, sf), "embedding", "side"))


@query("ST03_mmd_poly", _pairs_sql("(2 * list_dot_product(a.v, b.v) + 1) ** 2"))
def _(spark, sf):
    return tidy(twosample.mmd_poly(_vectors(spark, sf), "embedding", "side", gamma=2.0, coef0=1.0))


def _clicks(spark, sf):
    ev = fx.table(spark, sf, "events").where("event_type in ('click', 'view')")
    return ev.select("user_id", "value", F.when(F.col("event_type") == "click", "x").otherwise("y").alias("side"))


MOMENTS = """m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS mean_x, avg(value) FILTER (WHERE event_type = 'view') AS mean_y,
    var_samp(value) FILTER (WHERE event_type = 'click') AS vx, var_samp(value) FILTER (WHERE event_type = 'view') AS vy,
    count(*) FILTER (WHERE event_type = 'click') AS nx, count(*) FILTER (WHERE event_type = 'view') AS ny
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)"""


@query("ST04_welch_t", f"""WITH {MOMENTS}, s AS (SELECT *, (mean_x - mean_y) / nullif(sqrt(vx / nx + vy / ny), 0) AS t,
    (vx / nx + vy / ny) ** 2 / nullif((vx / nx) ** 2 / nullif(nx - 1, 0) + (vy / ny) ** 2 / nullif(ny - 1, 0), 0) AS df FROM m)
  SELECT user_id, nx, ny, {r6s('mean_x', 'mean_y', 't', 'df')}, {r6(sk.student_p('t', 'df', 2000), 'p_val')} FROM s""")
def _(spark, sf):
    return tidy(twosample.t_test(_clicks(spark, sf), "value", "side", ["user_id"]))


@query("ST05_pooled_t", f"""WITH {MOMENTS}, s AS (SELECT *, CAST(nx + ny - 2 AS DOUBLE) AS df,
    (mean_x - mean_y) / nullif(sqrt((coalesce((nx - 1) * vx, 0) + coalesce((ny - 1) * vy, 0)) / nullif(nx + ny - 2, 0) * (1 / nx + 1 / ny)), 0) AS t FROM m)
  SELECT user_id, nx, ny, {r6s('mean_x', 'mean_y', 't', 'df')}, {r6(sk.student_p('t', 'df', 2000), 'p_val')} FROM s""")
def _(spark, sf):
    return tidy(twosample.t_test(_clicks(spark, sf), "value", "side", ["user_id"], pooled=True))


KS = """c AS (SELECT user_id, value, count(*) FILTER (WHERE event_type = 'click') AS cx, count(*) FILTER (WHERE event_type = 'view') AS cy
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
  f AS (SELECT user_id, sum(cx) OVER w AS sx, sum(cy) OVER w AS sy, sum(cx) OVER u AS nx, sum(cy) OVER u AS ny FROM c
    WINDOW w AS (PARTITION BY user_id ORDER BY value), u AS (PARTITION BY user_id))"""


@query("ST06_ks_statistic", f"""WITH {KS} SELECT user_id, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, {r6('max(abs(sx / nx - sy / ny))', 'd')}
  FROM f WHERE nx > 0 AND ny > 0 GROUP BY ALL""")
def _(spark, sf):
    return tidy(twosample.ks_statistic(_clicks(spark, sf), "value", "side", ["user_id"]).drop("mean_x"))


@query("ST06_ks_one_group", """WITH c AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS cx, count(*) FILTER (WHERE event_type = 'view') AS cy
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), f AS (SELECT sum(cx) OVER (ORDER BY value) AS sx, sum(cy) OVER (ORDER BY value) AS sy, sum(cx) OVER () AS nx, sum(cy) OVER () AS ny FROM c)
  SELECT 1 AS one, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, """ + r6('max(abs(sx / nx - sy / ny))', 'd') + " FROM f GROUP BY ALL")
def _(spark, sf):
    one = _clicks(spark, sf).withColumn("one", F.lit(1))
    return tidy(twosample.ks_statistic(one, "value", "side", ["one"], block_rows=1000).drop("mean_x"))


def _halves(spark, sf):
    from dayloom.operators import sampling

    p = fx.daily_panel(spark, sf).select("user_id", "date", "v")
    ab = sampling.two_samples(sampling.with_boots(p, 2), 10, **K, seed="s1")
    return ab.withColumn("side", F.when(F.col("sample") == "a", "x").otherwise("y"))


@query("ST06_ks_test", f"""WITH {PANEL}, r AS (SELECT p.user_id, p.v, b.boot, row_number() OVER (PARTITION BY p.user_id, b.boot ORDER BY md5(concat_ws('|', CAST(p.user_id AS VARCHAR), CAST(p.date AS VARCHAR), CAST(b.boot AS VARCHAR), 's1')), p.date) AS rn
    FROM panel p CROSS JOIN (SELECT CAST(unnest(generate_series(0, 1)) AS INTEGER) AS boot) b),
  c AS (SELECT user_id, boot, v, count(*) FILTER (WHERE rn <= 10) AS cx, count(*) FILTER (WHERE rn > 10) AS cy FROM r WHERE rn <= 20 GROUP BY 1, 2, 3),
  f AS (SELECT user_id, boot, abs(sum(cx) OVER w - sum(cy) OVER w) AS g FROM c WINDOW w AS (PARTITION BY user_id, boot ORDER BY v)),
  d AS (SELECT user_id, boot, CAST(max(g) AS INTEGER) AS h FROM f GROUP BY 1, 2)
  SELECT user_id, boot, CAST(10 AS BIGINT) AS nx, CAST(10 AS BIGINT) AS ny, {r6('h / 10', 'd')},
    round(CASE WHEN h = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(1, 10 // h + 1), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) *
      list_product(list_transform(range(0, k * h), lambda i: (10 - i) / (11.0 + i)))))) END + 1e-9, 6) + 0.0 AS p_val FROM d""")
def _(spark, sf):
    return tidy(twosample.ks_test(_halves(spark, sf), "v", "side", ["user_id", "boot"]).drop("mean_x"))


KS_TAIL = f"""{KS}, g AS (SELECT user_id, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, CAST(max(abs(sx * ny - sy * nx)) AS BIGINT) AS h FROM f
    WHERE nx > 0 AND ny > 0 GROUP BY ALL),
  x AS (SELECT user_id, avg(value) AS mean_x FROM events WHERE event_type = 'click' GROUP BY 1), {sk.ks_lattice('g', 'w')}"""


@query("ST06_ks_unequal_sizes", f"""WITH RECURSIVE {KS_TAIL} SELECT user_id, nx, ny, {r6s('mean_x')}, {r6('h / (nx * ny)', 'd')}, {r6s('p_val')}
  FROM g JOIN w USING (nx, ny, h) JOIN x USING (user_id)""")
def _(spark, sf):
    return tidy(twosample.ks_test(_clicks(spark, sf), "value", "side", ["user_id"]))


@query("ST06_ks_series", f"""WITH RECURSIVE {KS_TAIL}, z AS (SELECT *, h / (nx * ny) * sqrt(nx * ny / (nx + ny)) AS z FROM g)
  SELECT user_id, nx, ny, {r6s('mean_x')}, {r6('h / (nx * ny)', 'd')}, {r6('CASE WHEN z < 0.2 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z)))) END', 'p_val')}
  FROM z JOIN x USING (user_id)""")
def _(spark, sf):
    return tidy(twosample.ks_test(_clicks(spark, sf), "value", "side", ["user_id"], method="series"))


@query("ST07_pearson", f"WITH {PANEL}, c AS (SELECT user_id, count(*) AS n, CASE WHEN isnan(corr(v, k)) THEN NULL ELSE corr(v, k) END AS r FROM panel WHERE v IS NOT NULL AND k IS NOT NULL GROUP BY 1) "
       f"SELECT user_id, n, {r6s('r')}, {r6(sk.student_p('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 'p_val')} FROM c")
def _(spark, sf):
    return tidy(twosample.correlation_test(fx.daily_panel(spark, sf), "v", "k", ["user_id"]))


def _chi2_sql(src: str, a: str, b: str) -> str:
    return f"""WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {src} GROUP BY 1, 2),
  ra AS (SELECT a, sum(o) AS m FROM o GROUP BY 1), cb AS (SELECT b, sum(o) AS m FROM o GROUP BY 1), t AS (SELECT sum(o) AS n FROM o),
  g AS (SELECT ra.a, cb.b, coalesce(o.o, 0) AS o, ra.m * cb.m / t.n AS e FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
  d AS (SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS BIGINT) AS dof),
  s AS (SELECT d.n, d.dof, sum((abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e) AS chi2 FROM g CROSS JOIN d GROUP BY 1, 2)
  SELECT n, dof, {r6s('chi2')}, {r6(sk.chi2_p('chi2', 'dof'), 'p_val')} FROM s"""


@query("ST08_chi2_yates", _chi2_sql("labels", "quality", "toxic"))
def _(spark, sf):
    return tidy(twosample.chi2_test(fx.table(spark, sf, "labels"), "quality", "toxic"))


@query("ST08_chi2", _chi2_sql("(SELECT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)", "c_mktsegment", "n_name"))
def _(spark, sf):
    return tidy(twosample.chi2_test(fx.once_dim(spark, sf), "c_mktsegment", "n_name"))


@query("A09_crosstab", "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS \"0\", count(*) FILTER (WHERE toxic = 1) AS \"1\" FROM labels GROUP BY 1")
def _(spark, sf):
    return twosample.contingency(fx.table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("A11_proportions", f"WITH {ONCE} SELECT c_mktsegment, n_regionkey, {r6('count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) * 100', 'proportion')} FROM once_dim GROUP BY 1, 2")
def _(spark, sf):
    return tidy(twosample.proportions(fx.once_dim(spark, sf), "c_mktsegment", "n_regionkey"))


@query("A13_p_value_histogram", f"WITH {PVALS} SELECT CAST(floor(p_val / 0.05::DOUBLE) AS INTEGER) AS bin, count(*) AS n, (SELECT count(*) FROM pvals WHERE p_val < 0.05) AS n_below, (SELECT count(*) FROM pvals) AS n_tests FROM pvals GROUP BY 1")
def _(spark, sf):
    return twosample.histogram(fx.p_values(spark, sf), "p_val", 0.05)


# ------------------------------------------------------------------ corrections

def correct_sql(src: str, out: str, keys: str, p: str = "p_val") -> str:
    return f"""{out}_a AS (SELECT *, {p} * count(*) OVER (PARTITION BY {keys}) AS p_value_bc,
    CASE WHEN {p} < 0.05::DOUBLE / count(*) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS reject_bc,
    {p} * count(*) OVER (PARTITION BY {keys}) / count(*) OVER (PARTITION BY {keys} ORDER BY {p}) AS q0 FROM {src}),
  {out}_b AS (SELECT * EXCLUDE (q0), least(1.0, min(q0) OVER (PARTITION BY {keys} ORDER BY {p} DESC)) AS p_value_fdr FROM {out}_a),
  {out} AS (SELECT *, CASE WHEN p_value_fdr <= 0.1 THEN 1 ELSE 0 END AS reject_fdr FROM {out}_b)"""


FDR = PVALS + ", " + correct_sql("pvals", "res", "definition, measure")
IDS = "user_id, definition, measure"


def results(spark, sf):
    return inference.correct(fx.p_values(spark, sf), "p_val", ["definition", "measure"])


@query("ST09_bonferroni", f"WITH {FDR} SELECT {IDS}, {r6s('p_value_bc')}, reject_bc FROM res")
def _(spark, sf):
    out = inference.bonferroni(fx.p_values(spark, sf), "p_val", ["definition", "measure"])
    return tidy(out.select("user_id", "definition", "measure", "p_value_bc", "reject_bc"))


@query("ST10_benjamini_hochberg", f"WITH {FDR} SELECT {IDS}, {r6s('p_value_fdr')}, reject_fdr FROM res")
def _(spark, sf):
    out = inference.benjamini_hochberg(fx.p_values(spark, sf), "p_val", ["definition", "measure"])
    return tidy(out.select("user_id", "definition", "measure", "p_value_fdr", "reject_fdr"))


@query("ST10_benjamini_hochberg_one_group", f"WITH {PVALS}, {correct_sql('pvals', 'res', '1')} SELECT {IDS}, {r6s('p_value_fdr')}, reject_fdr FROM res")
def _(spark, sf):
    one = fx.p_values(spark, sf).withColumn("one", F.lit(1))
    out = inference.benjamini_hochberg(one, "p_val", ["one"], block_rows=200)
    return tidy(out.select("user_id", "definition", "measure", "p_value_fdr", "reject_fdr"))


def _samples(spark, sf):
    p = fx.daily_panel(spark, sf)
    d = lambda name, c: p.select(
        F.lit(name).alias("definition"), "user_id", F.when(F.col(c) > 0, "stress").otherwise("reference").alias("label"),
        (F.col("v") - 50).alias("m_v"), (F.col("k") - 50).alias("m_k"), F.col("v_click").alias("m_click"))
    return d("lab", "lab").unionByName(d("lab3", "lab3"))


SAMPLES = f"""{PANEL}, s AS (SELECT 'lab' AS definition, user_id, CASE WHEN lab > 0 THEN 'stress' ELSE 'reference' END AS label, v - 50 AS m_v, k - 50 AS m_k, v_click AS m_click FROM panel
    UNION ALL SELECT 'lab3', user_id, CASE WHEN lab3 > 0 THEN 'stress' ELSE 'reference' END, v - 50, k - 50, v_click FROM panel),
  g AS (SELECT definition, user_id FROM s WHERE label = 'stress' GROUP BY 1, 2 HAVING count(DISTINCT m_v) + max((m_v IS NULL)::INT) > 1),
  l AS (SELECT * FROM (UNPIVOT (SELECT * FROM s SEMI JOIN g USING (definition, user_id)) ON m_v, m_k, m_click INTO NAME measure VALUE x)),
  m AS (SELECT definition, user_id, measure, avg(x) FILTER (WHERE label = 'stress') AS mx, avg(x) FILTER (WHERE label <> 'stress') AS my,
      var_samp(x) FILTER (WHERE label = 'stress') AS vx, var_samp(x) FILTER (WHERE label <> 'stress') AS vy,
      count(*) FILTER (WHERE label = 'stress') AS nx, count(*) FILTER (WHERE label <> 'stress') AS ny FROM l GROUP BY 1, 2, 3),
  t AS (SELECT *, (mx - my) / nullif(sqrt(vx / nx + vy / ny), 0) AS t,
      (vx / nx + vy / ny) ** 2 / nullif((vx / nx) ** 2 / nullif(nx - 1, 0) + (vy / ny) ** 2 / nullif(ny - 1, 0), 0) AS df FROM m),
  p AS (SELECT definition, user_id, measure, {sk.student_p('t', 'df', 8000)} AS p_val, CASE WHEN mx >= 0 THEN 'Loss' WHEN mx < 0 THEN 'Gain' END AS direction FROM t),
  pn AS (SELECT * FROM p WHERE p_val IS NOT NULL AND direction IS NOT NULL), {correct_sql('pn', 'res', 'definition, measure')}"""


@query("ST11_significance", f"WITH {SAMPLES} SELECT {IDS}, direction, {r6s('p_val', 'p_value_bc', 'p_value_fdr')}, reject_bc, reject_fdr FROM res")
def _(spark, sf):
    out = inference.significance(_samples(spark, sf), ["m_v", "m_k", "m_click"], entity="user_id", label="label",
                                 within=["definition"], method="t", gate="m_v")
    return tidy(out)


#: The samples with KS tests in place of t tests.
KS_SAMPLES = SAMPLES[: SAMPLES.index("  m AS (")] + f"""  kc AS (SELECT definition, user_id, measure, x, count(*) FILTER (WHERE label = 'stress') AS cx, count(*) FILTER (WHERE label <> 'stress') AS cy FROM l WHERE x IS NOT NULL GROUP BY ALL),
  kf AS (SELECT definition, user_id, measure, sum(cx) OVER w AS sx, sum(cy) OVER w AS sy, sum(cx) OVER u AS nx, sum(cy) OVER u AS ny, sum(x * cx) OVER u AS tx FROM kc
    WINDOW w AS (PARTITION BY definition, user_id, measure ORDER BY x), u AS (PARTITION BY definition, user_id, measure)),
  kg AS (SELECT definition, user_id, measure, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, max(tx) / nx AS mx, CAST(max(abs(sx * ny - sy * nx)) AS BIGINT) AS h FROM kf
    WHERE nx > 0 AND ny > 0 GROUP BY definition, user_id, measure, nx, ny),
  {sk.ks_lattice('kg', 'kw')},
  pn AS (SELECT definition, user_id, measure, p_val, CASE WHEN mx >= 0 THEN 'Loss' ELSE 'Gain' END AS direction FROM kg JOIN kw USING (nx, ny, h)),
  {correct_sql('pn', 'res', 'definition, measure')}"""


@query("ST11_significance_ks", f"WITH RECURSIVE {KS_SAMPLES} SELECT {IDS}, direction, {r6s('p_val', 'p_value_bc', 'p_value_fdr')}, reject_bc, reject_fdr FROM res")
def _(spark, sf):
    out = inference.significance(_samples(spark, sf), ["m_v", "m_k", "m_click"], entity="user_id", label="label",
                                 within=["definition"], method="KS", gate="m_v")
    return tidy(out)


@query("ST12_all_definitions", f"""WITH {SAMPLES}, c AS (SELECT measure, user_id, sum(reject_fdr) AS n FROM res
    WHERE user_id IN (SELECT user_id FROM res GROUP BY 1 HAVING count(DISTINCT definition) = 2) GROUP BY 1, 2)
  SELECT q.measure, q.n_definitions, count(c.user_id) AS n FROM (SELECT DISTINCT measure, CAST(i AS BIGINT) AS n_definitions FROM c CROSS JOIN generate_series(0, 4) g(i)) q
  LEFT JOIN c ON c.measure = q.measure AND c.n = q.n_definitions GROUP BY 1, 2""")
def _(spark, sf):
    res = inference.significance(_samples(spark, sf), ["m_v", "m_k", "m_click"], entity="user_id", label="label",
                                 within=["definition"], method="t", gate="m_v")
    both = inference.tested_for_all(res, ["lab", "lab3"], entity="user_id")
    return inference.viability_histogram(res.join(both, "user_id", "left_semi"), entity="user_id")


@query("A14_informative_entities", f"""WITH {SAMPLES.split(', g AS')[0].split('''  g AS''')[0].rstrip().rstrip(',')}
  SELECT definition, user_id FROM s WHERE label = 'stress' GROUP BY 1, 2 HAVING count(DISTINCT m_click) + max((m_click IS NULL)::INT) > 1""")
def _(spark, sf):
    return inference.informative_entities(_samples(spark, sf), "m_click", entity="user_id", label="label", within=["definition"])


# ------------------------------------------------------------- rejection tables

MEAS = ["click", "error", "view"]
WIDE = FDR + ", wide AS (SELECT user_id, " + ", ".join(
    f"min(direction) FILTER (WHERE measure = '{m}') AS {m}" for m in MEAS) + " FROM res WHERE reject_fdr = 1 AND definition = '{d}' GROUP BY 1)"


def _directions(spark, sf, d):
    return inference.direction_table(results(spark, sf).where(F.col("definition") == d), MEAS, entity="user_id")


EVERY = ["click", "error", "purchase", "signup", "view"]


@query("A07_direction_pivot", f"WITH {FDR} SELECT user_id, " + ", ".join(
    f"min(direction) FILTER (WHERE measure = '{m}') AS {m}" for m in EVERY) + " FROM res WHERE reject_fdr = 1 AND definition = 'd0' GROUP BY 1")
def _(spark, sf):
    return inference.direction_table(results(spark, sf).where("definition = 'd0'"), EVERY, entity="user_id")


@query("A08_pattern_frequency", f"WITH {WIDE.format(d='d0')} SELECT {', '.join(MEAS)}, count(*) AS freq FROM wide WHERE click IS NOT NULL AND error IS NOT NULL AND view IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return inference.patterns(_directions(spark, sf, "d0"), MEAS)


@query("U07_pattern_overlap", f"WITH {FDR}, w AS (SELECT definition, user_id, " + ", ".join(
    f"min(direction) FILTER (WHERE measure = '{m}') AS {m}" for m in ("click", "error")) + """ FROM res WHERE reject_fdr = 1 GROUP BY 1, 2),
  c AS (SELECT a.d AS click, b.d AS error FROM (SELECT unnest(['Gain', 'Loss']) AS d) a CROSS JOIN (SELECT unnest(['Gain', 'Loss']) AS d) b),
  x AS (SELECT c.click, c.error, (SELECT count(*) FROM w WHERE definition = 'd0' AND w.click = c.click AND w.error = c.error) AS n_first,
    (SELECT count(*) FROM w WHERE definition = 'd1' AND w.click = c.click AND w.error = c.error) AS n_second,
    (SELECT count(*) FROM w JOIN w w2 ON w.user_id = w2.user_id WHERE w.definition = 'd0' AND w2.definition = 'd1' AND w.click = c.click AND w.error = c.error
       AND w2.click = c.click AND w2.error = c.error) AS n_both FROM c)
  SELECT *, """ + r6("n_both / nullif(least(n_first, n_second), 0)", "overlap") + " FROM x")
def _(spark, sf):
    keep = ["user_id", "click", "error"]
    return tidy(inference.pattern_overlap(_directions(spark, sf, "d0").select(keep), _directions(spark, sf, "d1").select(keep),
                                          ["click", "error"], entity="user_id"))


@query("A10_definition_viability", f"""WITH {FDR} SELECT measure, user_id, count(*) FILTER (WHERE reject_fdr = 1) AS number_rejected,
    count(*) FILTER (WHERE reject_fdr = 1 AND direction = 'Gain') AS number_gained, count(*) FILTER (WHERE reject_fdr = 1 AND direction = 'Loss') AS number_lost,
    coalesce(list(definition ORDER BY definition) FILTER (WHERE reject_fdr = 1), []) AS definitions,
    coalesce(list(direction ORDER BY definition) FILTER (WHERE reject_fdr = 1), []) AS directions FROM res GROUP BY 1, 2""")
def _(spark, sf):
    return inference.viability(results(spark, sf), entity="user_id")


@query("A10_viability_histogram", f"""WITH {FDR}, c AS (SELECT measure, user_id, sum(reject_fdr) AS n FROM res GROUP BY 1, 2)
  SELECT q.measure, q.n_definitions, count(c.user_id) AS n FROM (SELECT DISTINCT measure, CAST(i AS BIGINT) AS n_definitions FROM c CROSS JOIN generate_series(0, 4) g(i)) q
  LEFT JOIN c ON c.measure = q.measure AND c.n = q.n_definitions GROUP BY 1, 2""")
def _(spark, sf):
    return inference.viability_histogram(results(spark, sf), entity="user_id")


@query("A12_rejection_summary", f"""WITH {FDR}, s AS (SELECT definition, measure, CAST(sum(reject_fdr) AS BIGINT) AS n_rejected, count(*) AS n_tests, count(*) FILTER (WHERE reject_fdr = 1 AND direction = 'Loss') AS n_lower FROM res GROUP BY 1, 2)
  SELECT *, {r6('n_rejected / n_tests * 100', 'percent_rejected')}, {r6('n_lower / nullif(n_rejected, 0) * 100', 'percent_lower')} FROM s""")
def _(spark, sf):
    return tidy(inference.rejection_summary(results(spark, sf), ["definition", "measure"]))


@query("U06_entities_in_all", f"WITH {FDR} SELECT user_id FROM res WHERE reject_fdr = 1 AND definition IN ('d0', 'd1', 'd2') GROUP BY 1 HAVING count(DISTINCT definition) = 3")
def _(spark, sf):
    rejected = results(spark, sf).where("reject_fdr = 1")
    return inference.tested_for_all(rejected, ["d0", "d1", "d2"], entity="user_id")


@query("U08_union_all", f"WITH {FDR} SELECT {IDS}, direction FROM res WHERE definition = 'd0' UNION ALL SELECT {IDS}, direction FROM res WHERE definition = 'd3'")
def _(spark, sf):
    r = results(spark, sf).select("user_id", "definition", "measure", "direction")
    return r.where("definition = 'd0'").unionByName(r.where("definition = 'd3'"))


TRAITS = f"""{FDR}, {ONCE}, j AS (SELECT definition, measure, direction, c_acctbal, c_mktsegment, CAST(n_regionkey AS VARCHAR) AS region FROM res LEFT JOIN once_dim USING (user_id) WHERE reject_fdr = 1),
  nm AS (SELECT definition, measure, avg(c_acctbal) FILTER (WHERE direction = 'Gain') AS mx, avg(c_acctbal) FILTER (WHERE direction = 'Loss') AS my,
    var_samp(c_acctbal) FILTER (WHERE direction = 'Gain') AS vx, var_samp(c_acctbal) FILTER (WHERE direction = 'Loss') AS vy,
    count(c_acctbal) FILTER (WHERE direction = 'Gain') AS nx, count(c_acctbal) FILTER (WHERE direction = 'Loss') AS ny FROM j GROUP BY 1, 2),
  nt AS (SELECT *, nx + ny - 2 AS df, (mx - my) / nullif(sqrt((coalesce((nx - 1) * vx, 0) + coalesce((ny - 1) * vy, 0)) / nullif(nx + ny - 2, 0) * (1 / nullif(nx, 0) + 1 / nullif(ny, 0))), 0) AS t FROM nm),
  num AS (SELECT definition, measure, 'c_acctbal' AS feature, {sk.student_p('t', 'df')} AS p_val, CASE WHEN mx > my THEN 'Gain Higher' ELSE 'Loss Higher' END AS direction FROM nt WHERE df > 0 AND t IS NOT NULL),
  lc AS (UNPIVOT (SELECT definition, measure, direction, c_mktsegment, region FROM j) ON c_mktsegment, region INTO NAME feature VALUE x),
  o AS (SELECT definition, measure, feature, direction, x, count(*) AS o FROM lc GROUP BY ALL),
  ra AS (SELECT definition, measure, feature, direction, sum(o) AS m FROM o GROUP BY ALL), cb AS (SELECT definition, measure, feature, x, sum(o) AS m FROM o GROUP BY ALL),
  tt AS (SELECT definition, measure, feature, sum(o) AS n, (count(DISTINCT direction) - 1) * (count(DISTINCT x) - 1) AS dof FROM o GROUP BY ALL),
  gg AS (SELECT ra.definition, ra.measure, ra.feature, tt.dof, coalesce(o.o, 0) AS o, ra.m * cb.m / tt.n AS e
    FROM ra JOIN cb USING (definition, measure, feature) JOIN tt USING (definition, measure, feature)
    LEFT JOIN o ON o.definition = ra.definition AND o.measure = ra.measure AND o.feature = ra.feature AND o.direction = ra.direction AND o.x = cb.x),
  cs AS (SELECT definition, measure, feature, dof, sum((abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e) AS chi2 FROM gg GROUP BY ALL),
  cat AS (SELECT definition, measure, feature, CASE WHEN dof = 0 THEN 1.0 ELSE {sk.chi2_p('chi2', 'dof')} END AS p_val, 'Categorical' AS direction FROM cs),
  alls AS (SELECT * FROM num UNION ALL SELECT * FROM cat), {correct_sql('alls', 'out', 'definition, measure')}"""


@query("ST13_population_traits", f"WITH {TRAITS} SELECT definition, measure, feature, direction, {r6s('p_val', 'p_value_bc', 'p_value_fdr')}, reject_bc, reject_fdr FROM out")
def _(spark, sf):
    traits = fx.once_dim(spark, sf).select("user_id", "c_acctbal", "c_mktsegment", F.col("n_regionkey").cast("string").alias("region"))
    return tidy(inference.population_traits(results(spark, sf), traits, ["c_acctbal"], ["c_mktsegment", "region"], entity="user_id"))


# ---------------------------------------------------------------------- periods

SIG = ["v", "v_click", "lab3"]
NZ = "nz AS (SELECT user_id, date, " + ", ".join(f"CASE WHEN {c} <> 0 THEN CAST({c} AS DOUBLE) END AS {c}" for c in SIG) + " FROM {src})"


def _dft(src: str) -> str:
    return f"""{NZ.format(src=src)}, {sk.interpolate('nz', 'ni', SIG, inside_only=True)},
  sl AS (UNPIVOT ni ON {', '.join(SIG)} INTO NAME signal VALUE x),
  si AS (SELECT *, row_number() OVER (PARTITION BY user_id, signal ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY user_id, signal) AS n FROM sl),
  sk AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM si),
  sp AS (SELECT user_id, signal, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k,
    round(sqrt(sum(x * cos(2 * pi() * ((k * t) % n) / n)) ** 2 + sum(x * sin(2 * pi() * ((k * t) % n) / n)) ** 2), 9) AS amp FROM sk GROUP BY 1, 2, 3, 4),
  keys AS (SELECT user_id, signal FROM (SELECT DISTINCT user_id FROM {src}) CROSS JOIN (SELECT unnest({SIG}) AS signal))"""


def _panel_sig(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", *SIG)
    return panel.fill_days(p, **K)


@query("ST15_inner_values", f"WITH {FILLED}, {NZ.format(src='filled')}, {sk.interpolate('nz', 'ni', SIG, inside_only=True)} SELECT user_id, CAST(date AS VARCHAR) AS date, {r6s(*SIG)} FROM ni")
def _(spark, sf):
    return tidy(spectrum.inner_values(_panel_sig(spark, sf), SIG, **K))


def _periods(kind, compat=False):
    def run(spark, sf):
        s = spectrum.signals(_panel_sig(spark, sf), SIG, **K)
        return tidy(s.select("user_id", "signal", spectrum.dominant_period(kind, compat).alias("period")))

    return run


PEAK = "SELECT keys.user_id, keys.signal, {e} AS period FROM keys LEFT JOIN ({q}) b ON b.user_id = keys.user_id AND b.signal = keys.signal"
TOP = "SELECT user_id, signal, n, arg_max(k, (amp, -k)) AS k FROM sp {w} GROUP BY 1, 2, 3"
query("ST16_peak_period", f"WITH {FILLED}, {_dft('filled')} " + PEAK.format(q=TOP.format(w=""), e="CASE WHEN k = 0 THEN CAST('inf' AS DOUBLE) ELSE round(n / k + 1e-9, 6) + 0.0 END"))(_periods("peak"))
query("ST17_half_period", f"WITH {FILLED}, {_dft('filled')} " + PEAK.format(q=TOP.format(w="WHERE k >= 1"), e="CASE WHEN k >= 2 THEN round(n / k + 1e-9, 6) + 0.0 END"))(_periods("half"))
query("ST17_half_period_compat", f"WITH {FILLED}, {_dft('filled')} " + PEAK.format(q=TOP.format(w=""), e="CASE WHEN k + 1 >= 2 AND k < n // 2 THEN round(n / (k + 1) + 1e-9, 6) + 0.0 END"))(_periods("half", True))
query("ST18_cutoff_period", f"WITH {FILLED}, {_dft('filled')} " + PEAK.format(q=TOP.format(w="WHERE k >= 2"), e="round(n / k + 1e-9, 6) + 0.0"))(_periods("cutoff"))
query("ST18_cutoff_period_compat", f"WITH {FILLED}, {_dft('filled')}, allk AS ({TOP.format(w='')}), midk AS ({TOP.format(w='WHERE k >= 1 AND k <= n // 2 - 1')}) " + PEAK.format(
    q="SELECT midk.user_id, midk.signal, midk.n, midk.k, allk.k AS ka FROM midk JOIN allk USING (user_id, signal)",
    e="CASE WHEN ka < n // 2 THEN round(n / (k + 1) + 1e-9, 6) + 0.0 END"))(_periods("cutoff", True))


STUDY_F = ["v", "v_click", "lab3"]
STUDY = f"""{FILLED}, {sk.z_score('filled', 'z', STUDY_F)}, {sk.interpolate('z', 'zi', STUDY_F)},
  zf AS (SELECT user_id, date, {', '.join(f'coalesce({c}, avg({c}) OVER (PARTITION BY user_id)) AS {c}' for c in STUDY_F)} FROM zi), {_dft('zf')}"""


@query("ST19_period_study", f"WITH {STUDY}, {ONCE}, pp AS (" + PEAK.format(q=TOP.format(w="WHERE k >= 1"), e="CASE WHEN k >= 2 THEN round(n / k + 1e-9, 6) + 0.0 END") +
       ") SELECT user_id, signal, c_mktsegment, period FROM pp JOIN once_dim USING (user_id)")
def _(spark, sf):
    p = spectrum.period_study(fx.daily_panel(spark, sf), STUDY_F, **K)
    return tidy(p.join(fx.once_dim(spark, sf).select("user_id", "c_mktsegment"), "user_id"))


@query("ST19_period_histogram", f"WITH {STUDY}, {ONCE}, pp AS (" + PEAK.format(q=TOP.format(w="WHERE k >= 2"), e="n / k") +
       ") SELECT signal, c_mktsegment, CAST(floor(period) AS BIGINT) AS period, count(*) AS n FROM pp JOIN once_dim USING (user_id) WHERE period IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, sf):
    p = spectrum.period_study(fx.daily_panel(spark, sf), STUDY_F, **K, kind="cutoff")
    j = p.join(fx.once_dim(spark, sf).select("user_id", "c_mktsegment"), "user_id")
    return spectrum.period_counts(j, ["signal", "c_mktsegment"])


@query("ST20_smoothed_periods", f"""WITH {FILLED}, {ONCE}, a AS (SELECT user_id, date, count(*) OVER (PARTITION BY user_id) AS nrow, {', '.join(f"{sk.full_frame('avg', c, 3, 3)} AS {c}" for c in SIG)} FROM filled),
  zz AS (SELECT user_id, date, nrow, {', '.join(f"({c} - avg({c}) OVER (PARTITION BY user_id)) / nullif(stddev_pop({c}) OVER (PARTITION BY user_id), 0) AS {c}" for c in SIG)} FROM a),
  {_dft('zz')}, best AS ({TOP.format(w='')}), nr AS (SELECT DISTINCT user_id, nrow FROM zz)
  SELECT user_id, signal, c_mktsegment, {r6('n / k', 'period')} FROM best JOIN nr USING (user_id) JOIN once_dim USING (user_id) WHERE k > 0 AND n / k <= nrow / 2""")
def _(spark, sf):
    p = spectrum.smoothed_period_study(_panel_sig(spark, sf), SIG, **K)
    return tidy(p.join(fx.once_dim(spark, sf).select("user_id", "c_mktsegment"), "user_id"))


@query("ST21_spectrum", f"WITH {FILLED}, {_dft('filled')} SELECT user_id, signal, n, k, {r6('amp', 'amplitude')}, {r6('k / n', 'freq')} FROM sp")
def _(spark, sf):
    return tidy(spectrum.spectrum_table(_panel_sig(spark, sf), SIG, **K))
