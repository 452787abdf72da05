"""Graph search on the daily panel and graph comparison on the stand-in edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom import vocab
from dayloom.operators import ci_tests, graph_search as gs, graph_tables as gt, labels, study
from dayloom.plans import fixtures as fx, sqlkit as sk
from dayloom.plans.fixtures import ALL_EDGES, EDGES, FILLED
from dayloom.plans.registry import query, r6, r6s, tidy
from dayloom.session import cut_lineage, scratch_table
from dayloom.sources import writers

K = {"entity": "user_id", "date": "date"}
G = ["user_id", "boot", "cond"]
PAIRS = {
    "between_phys": ("phys", "phys"), "between_sleep": ("sleep", "sleep"), "between_mental": ("mental", "mental"),
    "between_phys_sleep": ("phys", "sleep"), "between_phys_mental": ("phys", "mental"), "between_sleep_mental": ("sleep", "mental"),
}


def _in(col, theme):
    return f"{col} IN ({', '.join(repr(t) for t in fx.THEMES[theme])})"


def flag_sql(s: str, d: str, pair: str) -> str:
    a, b = PAIRS[pair]
    return f"coalesce(({_in(s, a)} AND {_in(d, b)}) OR ({_in(s, b)} AND {_in(d, a)}), false)"


# ------------------------------------------------------ counts and frequencies

@query("A15_edges_per_graph", f"WITH {EDGES} SELECT user_id, boot, cond, count(*) AS n_edges FROM edges GROUP BY ALL")
def _(spark, sf):
    return gt.edges_per_graph(fx.edges(spark, sf), G)


@query("A15_theme_edges_per_graph", f"WITH {EDGES} SELECT user_id, boot, cond, " + ", ".join(
    f"count(*) FILTER (WHERE {flag_sql('src', 'dst', p)}) AS {p}" for p in PAIRS) + " FROM edges GROUP BY ALL")
def _(spark, sf):
    return gt.theme_edges_per_graph(fx.edges(spark, sf), G, fx.THEMES, PAIRS)


@query("A16_edge_counts", f"WITH {EDGES} SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL")
def _(spark, sf):
    return gt.edge_counts(fx.edges(spark, sf))


FREQ = f"""{EDGES}, nodes AS (SELECT DISTINCT user_id, boot, cond, unnest([src, dst]) AS node FROM edges),
  freq AS (SELECT e.src, e.dst, e.n / (SELECT count(*) FROM nodes a JOIN nodes b USING (user_id, boot, cond) WHERE a.node = e.src AND b.node = e.dst) AS freq
    FROM (SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL) e)"""


def _freq(spark, sf):
    e = fx.edges(spark, sf)
    nodes = e.select(*G, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return gt.edge_frequency(e, nodes, G)


@query("A17_edge_frequency", f"WITH {FREQ} SELECT src, dst, {r6s('freq')} FROM freq")
def _(spark, sf):
    return tidy(_freq(spark, sf))


UND = f"""{EDGES}, und AS (SELECT cond, least(src, dst) AS lo, greatest(src, dst) AS hi, weight FROM edges),
  gcount AS (SELECT cond, count(*) AS g FROM (SELECT DISTINCT user_id, boot, cond FROM edges) GROUP BY 1),
  ufreq AS (SELECT cond, lo, hi, count(*) / g AS freq FROM und JOIN gcount USING (cond) GROUP BY cond, lo, hi, g)"""


def _ufreq(spark, sf):
    e = fx.edges(spark, sf)
    return gt.undirected_frequency(e, e.select(*G).distinct(), ["cond"])


@query("A18_undirected_frequency", f"WITH {UND} SELECT cond, lo, hi, {r6s('freq')} FROM ufreq")
def _(spark, sf):
    return tidy(_ufreq(spark, sf))


@query("A19_undirected_weights", f"WITH {UND} SELECT cond, lo, hi, {r6s('weight')} FROM und")
def _(spark, sf):
    return tidy(gt.undirected_weights(fx.edges(spark, sf), ["cond"]))


@query("A20_frequency_cutoff", f"WITH {FREQ} SELECT src, dst, {r6s('freq')} FROM freq WHERE freq >= 0.25")
def _(spark, sf):
    return tidy(gt.above_cutoff(_freq(spark, sf), 0.25))


@query("T03_top_edges", f"WITH {EDGES} SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, src, dst LIMIT 5")
def _(spark, sf):
    return gt.top_edges(gt.edge_counts(fx.edges(spark, sf)), "n", 5, ["src", "dst"])


@query("T03_top_undirected", f"WITH {UND} SELECT cond, lo, hi, {r6s('freq')} FROM ufreq WHERE cond = 'stress' ORDER BY ufreq.freq DESC, lo, hi LIMIT 5")
def _(spark, sf):
    return tidy(gt.top_edges(_ufreq(spark, sf).where("cond = 'stress'"), "freq", 5, ["lo", "hi"]))


@query("T02_sorted_results", f"WITH {UND} SELECT cond, lo, hi, {r6s('freq')} FROM ufreq ORDER BY ufreq.freq DESC NULLS LAST, lo, hi")
def _(spark, sf):
    return tidy(_ufreq(spark, sf).orderBy(F.desc_nulls_last("freq"), "lo", "hi"))


CHANGE = f"""{UND}, c0 AS (SELECT lo, hi, max(freq) FILTER (WHERE cond = 'no_stress') AS no_stress, max(freq) FILTER (WHERE cond = 'stress') AS stress FROM ufreq GROUP BY 1, 2),
  change AS (SELECT *, CASE WHEN stress <= no_stress THEN 1 ELSE 0 END AS decreasing, abs(no_stress - stress) AS difference FROM c0 WHERE no_stress IS NOT NULL AND stress IS NOT NULL)"""
CH = f"lo, hi, {r6('change.no_stress', 'no_stress')}, {r6('change.stress', 'stress')}, decreasing, {r6('change.difference', 'difference')}"

for _n, _by, _dec in (("T04_top_by_base", "no_stress", None), ("T04_top_by_change", "difference", None),
                      ("T04_top_decreasing", "difference", 1), ("T04_top_increasing", "difference", 0)):
    _w = "" if _dec is None else f"WHERE decreasing = {_dec}"

    @query(_n, f"WITH {CHANGE} SELECT {CH} FROM change {_w} ORDER BY change.{_by} DESC, lo, hi LIMIT 4")
    def _(spark, sf, by=_by, dec=_dec):
        return tidy(gt.top_changes(gt.frequency_change(_ufreq(spark, sf)), 4, by, dec))


@query("T05_weights_in_both", f"WITH {UND} SELECT cond, lo, hi, {r6s('weight')} FROM und WHERE (lo, hi) IN (SELECT (lo, hi) FROM und GROUP BY lo, hi HAVING count(*) FILTER (WHERE cond = 'stress') >= 10 AND count(*) FILTER (WHERE cond = 'no_stress') >= 10)")
def _(spark, sf):
    return tidy(gt.weights_in_both(fx.edges(spark, sf)))


# ------------------------------------------------------------------ comparison

PAIRED = f"""{ALL_EDGES}, t AS (SELECT *, CASE WHEN cond IN ('stress', 'no_stress') THEN 'stress' ELSE 'reference' END AS label, cond IN ('no_stress', 'b') AS base FROM all_edges),
  have AS (SELECT user_id, boot, label FROM t GROUP BY 1, 2, 3 HAVING bool_or(base) AND bool_or(NOT base)),
  bs AS (SELECT * FROM t WHERE base), ot AS (SELECT * FROM t WHERE NOT base),
  pairs AS (SELECT coalesce(b.user_id, o.user_id) AS user_id, coalesce(b.boot, o.boot) AS boot, coalesce(b.label, o.label) AS label,
      b.src AS bsrc, b.dst AS bdst, b.weight AS bw, o.src AS osrc, o.dst AS odst, o.weight AS ow
    FROM bs b FULL JOIN ot o ON b.user_id = o.user_id AND b.boot = o.boot AND b.label = o.label
      AND least(b.src, b.dst) = least(o.src, o.dst) AND greatest(b.src, b.dst) = greatest(o.src, o.dst))"""


def _paired(spark, sf):
    e = fx.all_edges(spark, sf)
    return gt.paired_edges(e, e.select(*G).distinct(), ["user_id"])


def _compare(spark, sf):
    return gt.compare_pairs(_paired(spark, sf), ["user_id"], fx.THEMES, PAIRS, len(fx.NODES))


ID = "user_id, boot, label"


@query("J08_undirected_match", f"WITH {PAIRED} SELECT {ID}, bsrc AS src, bdst AS dst, osrc AS other_src, odst AS other_dst FROM pairs WHERE bsrc IS NOT NULL AND osrc IS NOT NULL")
def _(spark, sf):
    p = _paired(spark, sf).where("base_src is not null and other_src is not null")
    return p.select("user_id", "boot", "label", F.col("base_src").alias("src"), F.col("base_dst").alias("dst"), "other_src", "other_dst")


@query("J10_anti", f"WITH {PAIRED} SELECT {ID}, osrc AS src, odst AS dst FROM pairs WHERE bsrc IS NULL")
def _(spark, sf):
    return gt.edge_difference(_paired(spark, sf), ["user_id"], other=True)


@query("J11_paired_graphs", f"WITH {PAIRED} SELECT user_id, boot, label FROM have")
def _(spark, sf):
    p = _paired(spark, sf).where("lo is null")
    return p.where("_has_base and _has_other").select("user_id", "boot", "label")


@query("U01_edge_union", f"WITH {PAIRED} SELECT {ID}, coalesce(bsrc, osrc) AS src, coalesce(bdst, odst) AS dst FROM pairs")
def _(spark, sf):
    return gt.edge_union(_paired(spark, sf), ["user_id"])


@query("U02_edge_intersection", f"WITH {PAIRED} SELECT {ID}, bsrc AS src, bdst AS dst FROM pairs WHERE bsrc IS NOT NULL AND osrc IS NOT NULL")
def _(spark, sf):
    return gt.edge_intersection(_paired(spark, sf), ["user_id"]).drop("weight_diff")


@query("U03_edge_jaccard", f"WITH {PAIRED} SELECT {ID}, {r6('count(*) FILTER (WHERE bsrc IS NOT NULL AND osrc IS NOT NULL) / count(*)', 'int_union')} FROM pairs SEMI JOIN have USING ({ID}) GROUP BY ALL")
def _(spark, sf):
    return tidy(_compare(spark, sf).select("user_id", "boot", "label", "int_union"))


@query("U04_edge_difference", f"WITH {PAIRED} SELECT {ID}, bsrc AS src, bdst AS dst FROM pairs WHERE osrc IS NULL")
def _(spark, sf):
    return gt.edge_difference(_paired(spark, sf), ["user_id"])


@query("U05_weight_difference", f"WITH {PAIRED} SELECT {ID}, bsrc AS src, bdst AS dst, {r6('bw - ow', 'weight_diff')} FROM pairs WHERE bsrc IS NOT NULL AND osrc IS NOT NULL")
def _(spark, sf):
    return tidy(gt.edge_intersection(_paired(spark, sf), ["user_id"]))


UNIQ = f"""{PAIRED}, chg AS (SELECT user_id, boot, least(coalesce(bsrc, osrc), coalesce(bdst, odst)) AS lo, greatest(coalesce(bsrc, osrc), coalesce(bdst, odst)) AS hi, osrc IS NULL AS added
    FROM pairs SEMI JOIN have USING ({ID}) WHERE label = 'stress' AND (bsrc IS NULL OR osrc IS NULL))"""


@query("U09_unique_edges", f"WITH {UNIQ} SELECT DISTINCT lo, hi FROM chg")
def _(spark, sf):
    return gt.unique_edges(_compare(spark, sf), entity="user_id")


@query("C01_last_graph", f"WITH {ALL_EDGES} SELECT user_id, cond, max(boot) AS boot FROM all_edges GROUP BY 1, 2")
def _(spark, sf):
    return gt.last_boot(fx.all_edges(spark, sf), ["user_id", "cond"])


@query("C02_padded_nodes", f"WITH {ALL_EDGES} SELECT DISTINCT user_id, boot, cond, node FROM all_edges CROSS JOIN (SELECT unnest({fx.NODES}) AS node) WHERE node <> 'view' OR cond IN ('a', 'b')")
def _(spark, sf):
    return gt.padded_nodes(fx.all_edges(spark, sf), fx.NODES, G, target="view")


# Menger: disjoint paths = direct edge + fewest inner nodes that cut every other path.
# Nodes are bits 0..4; every set of inner nodes is tried on every ordered pair.
def connectivity_sql(src: str) -> str:
    code = lambda c: f"CAST(list_position({fx.NODES}, {c}) - 1 AS INTEGER)"
    return f"""cg AS (SELECT DISTINCT user_id, boot, cond FROM {src}),
  ce AS MATERIALIZED (SELECT user_id, boot, cond, {code('src')} AS x, {code('dst')} AS y FROM {src}),
  uv AS (SELECT CAST(a.i AS INTEGER) AS u, CAST(b.i AS INTEGER) AS v, CAST(m.i AS INTEGER) AS s FROM range(5) a(i), range(5) b(i), range(32) m(i)
    WHERE a.i <> b.i AND (m.i >> a.i) % 2 = 0 AND (m.i >> b.i) % 2 = 0),
  reach AS (SELECT user_id, boot, cond, u, v, s, u AS at FROM cg CROSS JOIN uv
    UNION SELECT r.user_id, r.boot, r.cond, r.u, r.v, r.s, ce.y FROM reach r JOIN ce ON ce.user_id = r.user_id AND ce.boot = r.boot AND ce.cond = r.cond AND ce.x = r.at
    WHERE (r.s >> ce.y) % 2 = 0 AND NOT (r.at = r.u AND ce.y = r.v)),
  cuts AS (SELECT user_id, boot, cond, u, v, s, bool_or("at" = v) AS joined FROM reach GROUP BY ALL),
  kap AS (SELECT user_id, boot, cond, u, v, min(bit_count(s)) AS k FROM cuts WHERE NOT joined GROUP BY ALL),
  conn AS (SELECT k.user_id, k.boot, k.cond, (sum(k.k) + count(ce.x)) / 20.0 AS c FROM kap k LEFT JOIN ce ON ce.user_id = k.user_id AND ce.boot = k.boot
    AND ce.cond = k.cond AND ce.x = k.u AND ce.y = k.v GROUP BY ALL)"""


@query("C03_log_connectivity", f"WITH RECURSIVE {EDGES}, {connectivity_sql('edges')} SELECT user_id, boot, cond, CASE WHEN c = 0 THEN CAST('-inf' AS DOUBLE) ELSE {r6('ln(c)')} END AS log_connectivity FROM conn")
def _(spark, sf):
    e = fx.edges(spark, sf)
    return tidy(gt.graph_connectivity(e, e.select(*G).distinct(), G, len(fx.NODES)))


@query("C04_theme_flags", f"WITH {EDGES} SELECT user_id, boot, cond, src, dst, " + ", ".join(f"{flag_sql('src', 'dst', p)} AS {p}" for p in PAIRS) + " FROM edges")
def _(spark, sf):
    return gt.theme_flags(fx.edges(spark, sf).drop("weight"), fx.THEMES, PAIRS)


THEMED = ", ".join(f"count(*) FILTER (WHERE bsrc IS NOT NULL AND {flag_sql('bsrc', 'bdst', p)}) - count(*) FILTER (WHERE osrc IS NOT NULL AND {flag_sql('osrc', 'odst', p)}) AS {p}" for p in PAIRS)


@query("C05_theme_differences", f"WITH {PAIRED} SELECT {ID}, {THEMED} FROM pairs SEMI JOIN have USING ({ID}) GROUP BY ALL")
def _(spark, sf):
    return _compare(spark, sf).select("user_id", "boot", "label", *PAIRS)


@query("C06_edge_lists", f"""WITH {PAIRED} SELECT {ID}, coalesce(list({{'src': bsrc, 'dst': bdst}} ORDER BY bsrc, bdst) FILTER (WHERE osrc IS NULL), []) AS only_in_base,
    coalesce(list({{'src': osrc, 'dst': odst}} ORDER BY osrc, odst) FILTER (WHERE bsrc IS NULL), []) AS only_in_other FROM pairs SEMI JOIN have USING ({ID}) GROUP BY ALL""".replace(
    "list({'src': bsrc, 'dst': bdst} ORDER BY bsrc, bdst)", "list(bsrc || '>' || bdst ORDER BY bsrc, bdst)").replace(
    "list({'src': osrc, 'dst': odst} ORDER BY osrc, odst)", "list(osrc || '>' || odst ORDER BY osrc, odst)"))
def _(spark, sf):
    c = _compare(spark, sf)
    text = lambda col: F.transform(col, lambda e: F.concat(e.src, F.lit(">"), e.dst)).alias(col)
    return c.select("user_id", "boot", "label", text("only_in_base"), text("only_in_other"))


@query("C07_comparison", f"""WITH RECURSIVE {PAIRED}, {connectivity_sql('all_edges')},
  cl AS (SELECT user_id, boot, CASE WHEN cond IN ('stress', 'no_stress') THEN 'stress' ELSE 'reference' END AS label,
    max(c) FILTER (WHERE cond IN ('no_stress', 'b')) AS cb, max(c) FILTER (WHERE cond IN ('stress', 'a')) AS co FROM conn GROUP BY ALL),
  ms AS (SELECT {ID}, count(*) FILTER (WHERE bsrc IS NOT NULL AND osrc IS NOT NULL) / count(*) AS iu, {THEMED} FROM pairs SEMI JOIN have USING ({ID}) GROUP BY ALL)
  SELECT ms.* EXCLUDE (iu), {r6('iu', 'int_union')}, {r6('ln(cb) - ln(co)', 'difference')} FROM ms JOIN cl USING ({ID})""")
def _(spark, sf):
    c = _compare(spark, sf)
    return tidy(c.drop("weight_diffs", "only_in_base", "only_in_other"))


SUMMARY = f"""{UNIQ}, who AS (SELECT user_id FROM have WHERE label = 'stress' GROUP BY 1 HAVING count(*) >= 2),
  summ AS (SELECT w.user_id, u.lo, u.hi, (SELECT count(*) FROM chg c WHERE c.user_id = w.user_id AND c.lo = u.lo AND c.hi = u.hi AND added) / 3 AS percent_added,
    (SELECT count(*) FROM chg c WHERE c.user_id = w.user_id AND c.lo = u.lo AND c.hi = u.hi AND NOT added) / 3 AS percent_removed
    FROM who w CROSS JOIN (SELECT DISTINCT lo, hi FROM chg) u)"""


def _stored(spark, sf):
    """The comparison in the result store, written once and read as often as it is named."""
    path = scratch_table(spark, "comparison")
    writers.write_results(_compare(spark, sf), path, {"graphs": "steps"}, ["label"])
    return writers.read_results(spark, path, graphs="steps")


def _summary(spark, sf):
    return study.summarised(_stored(spark, sf), entity="user_id")


@query("C08_edge_shares", f"WITH {SUMMARY} SELECT user_id, lo, hi, {r6s('percent_added', 'percent_removed')} FROM summ")
def _(spark, sf):
    return tidy(_summary(spark, sf).select("user_id", "lo", "hi", "percent_added", "percent_removed"))


@query("C09_edge_summary", f"WITH {SUMMARY} SELECT user_id, lo, hi, {r6s('percent_added', 'percent_removed')} FROM summ")
def _(spark, sf):
    return tidy(_summary(spark, sf))


@query("C10_frequent_edges", f"""WITH {SUMMARY} SELECT lo, hi, count(*) FILTER (WHERE percent_added >= 0.5) AS n_added, count(*) FILTER (WHERE percent_removed >= 0.5) AS n_removed
  FROM summ GROUP BY 1, 2 HAVING count(*) FILTER (WHERE percent_added >= 0.5) >= 10 OR count(*) FILTER (WHERE percent_removed >= 0.5) >= 10""")
def _(spark, sf):
    return gt.frequent_edges(_summary(spark, sf), 0.5, 10)


WCHANGE = f"""{PAIRED}, d AS (SELECT user_id, label, least(bsrc, bdst) AS lo, greatest(bsrc, bdst) AS hi, bw - ow AS w FROM pairs WHERE bsrc IS NOT NULL AND osrc IS NOT NULL),
  m AS (SELECT user_id, lo, hi, avg(w) FILTER (WHERE label = 'stress') AS mx, avg(w) FILTER (WHERE label <> 'stress') AS my,
    var_samp(w) FILTER (WHERE label = 'stress') AS vx, var_samp(w) FILTER (WHERE label <> 'stress') AS vy,
    count(*) FILTER (WHERE label = 'stress') AS nx, count(*) FILTER (WHERE label <> 'stress') AS ny FROM d GROUP BY 1, 2, 3),
  tt AS (SELECT *, nx + ny - 2 AS df, (mx - my) / nullif(sqrt((coalesce((nx - 1) * vx, 0) + coalesce((ny - 1) * vy, 0)) / nullif(nx + ny - 2, 0) * (1 / nx + 1 / ny)), 0) AS t FROM m WHERE nx = 3 AND ny > 0)"""


@query("ST14_weight_change", f"WITH {WCHANGE} SELECT user_id, lo, hi, {r6('mx', 'mean')}, {r6(sk.student_p('t', 'df'), 'p_val')} FROM tt")
def _(spark, sf):
    return tidy(gt.weight_change(_stored(spark, sf), entity="user_id"))


# ---------------------------------------------------------------- graph search

FEATS = ["v", "n_events", "k", "v_click"]
BOOTS, LIMIT, MIN_ROWS = 2, 3, 6
LABELS = {"lab": lambda d: d.withColumn("label", F.col("lab")), "lab3": lambda d: d.withColumn("label", F.col("lab3"))}
OPTIONS = {"boots": BOOTS, "limit": LIMIT, "min_rows": MIN_ROWS}


def _panel(spark, sf):
    return fx.daily_panel(spark, sf).select("user_id", "date", "lab", "lab3", *FEATS)


def search_sql(
    label: str, ranks: bool = False, mask: list[str] | None = None, before: str = "", src: str = "filled",
    feats: list[str] | None = None, boots: int = BOOTS, min_rows: int = MIN_ROWS,
) -> str:
    """Samples, correlations (of ranks, if asked) and skeleton of one definition in SQL.

    ``mask`` names the definition's features; the others have no pairs. The label is an
    expression over ``src``, which ``before`` may define.
    """
    f = feats or FEATS
    noisy = ", ".join(f"{sk.noisy(c, i)} AS e{i}" for i, c in enumerate(f))
    by = "PARTITION BY user_id, boot, cond"
    ranked = ", ".join(f"CAST(rank() OVER ({by} ORDER BY e{i}) AS DOUBLE) AS e{i}" for i in range(len(f)))
    flat = f"noisy AS (SELECT * EXCLUDE ({', '.join(f'e{i}' for i in range(len(f)))}), {ranked} FROM plain)" if ranks else "noisy AS (SELECT * FROM plain)"
    masked = "".join(f" AND {i} NOT IN (i, j)" for i, c in enumerate(f) if mask and c not in mask)
    cols = ", ".join(f)
    key = lambda extra: f"md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR), CAST(boot AS VARCHAR), {extra}))"
    pairs = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f))]
    corrs = " UNION ALL ".join(
        f"SELECT user_id, boot, cond, {i} AS i, {j} AS j, count(*) AS n, corr(e{i}, e{j}) AS r, CASE WHEN stddev_pop({f[i]}) * stddev_pop({f[j]}) > 0 THEN corr({f[i]}, {f[j]}) END AS w FROM noisy GROUP BY ALL"
        for i, j in pairs)
    part = lambda a, b, c: f"(({a}) - ({b}) * ({c})) / sqrt(greatest((1 - ({b}) * ({b})) * (1 - ({c}) * ({c})), 1e-300))"
    indep = lambda r: f"({sk.student_p(f'({r}) * sqrt((n - 2) / (1 - ({r}) * ({r})))', '(n - 2)', 400)}) >= 0.05"
    return f"""{FILLED}, {before}lb AS (SELECT *, {label} AS label FROM {src}),
  {sk.z_score('lb', 'z', f)}, zm AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY user_id) AS m_{c}' for c in f)} FROM z), {sk.interpolate('zm', 'zi', f)},
  days AS (SELECT user_id, date, label, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in f)} FROM zi),
  {sk.runs('days', 'rr', 'label')}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS g FROM rr),
  bt AS (SELECT l.*, boot FROM l CROSS JOIN (SELECT CAST(unnest(generate_series(0, {boots - 1})) AS INTEGER) AS boot)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, boot, run ORDER BY {key("'graph'")}, date) AS r FROM bt),
  pool AS (SELECT user_id, boot, 'day' AS cond, date, {cols} FROM rk UNION ALL
    SELECT user_id, boot, cond, min(date), {', '.join(f'avg({c})' for c in f)} FROM (SELECT *, CASE WHEN label = 0 THEN 'no_stress' ELSE 'stress' END AS cond,
      CASE WHEN g BETWEEN 2 AND {LIMIT} THEN 0 ELSE r END AS slot FROM rk WHERE label IN (0, 1, 2) AND (g <= {LIMIT} OR r <= g // 2)) GROUP BY user_id, boot, cond, run, slot),
  ct AS (SELECT user_id, boot, count(*) FILTER (WHERE cond = 'stress') AS n_stress, count(*) FILTER (WHERE cond = 'no_stress') AS n_calm, count(*) FILTER (WHERE cond = 'day') AS n_days FROM pool GROUP BY 1, 2),
  st AS (SELECT *, least(n_stress, n_calm) AS nn, CASE WHEN least(n_stress, n_calm) < {min_rows} OR n_days < {min_rows} THEN 'too few rows' WHEN n_days < 2 * least(n_stress, n_calm) THEN 'no room for two samples' ELSE 'ok' END AS status FROM ct),
  dr AS (SELECT pool.*, nn, row_number() OVER (PARTITION BY user_id, boot, cond ORDER BY {key("cond, 'graph'")}, date) AS r FROM pool JOIN st USING (user_id, boot) WHERE status = 'ok'),
  smp AS (SELECT user_id, boot, date, CASE WHEN cond <> 'day' THEN cond WHEN r <= nn THEN 'a' ELSE 'b' END AS cond, {cols} FROM dr WHERE r <= nn OR (cond = 'day' AND r <= 2 * nn)),
  hs AS (SELECT *, {', '.join(f'''{key(f"cond, '{i}', 'graph'")} AS h{i}''' for i in range((len(f) + 3) // 4))} FROM smp),
  plain AS (SELECT *, {noisy} FROM hs), {flat},
  cr AS MATERIALIZED ({corrs}),
  use AS (SELECT user_id, {', '.join(f'count(DISTINCT {c}) >= 5 AS u{i}' for i, c in enumerate(f))} FROM panel GROUP BY 1),
  ok AS (SELECT cr.* FROM cr JOIN use USING (user_id) WHERE {' AND '.join(f'(NOT (i = {i} OR j = {i}) OR u{i})' for i in range(len(f)))}{masked}),
  sym AS (SELECT user_id, boot, cond, i AS x, j AS y, n, r FROM ok UNION ALL SELECT user_id, boot, cond, j, i, n, r FROM ok),
  e0 AS MATERIALIZED (SELECT * FROM ok WHERE NOT ({indep('r')})),
  a0 AS (SELECT user_id, boot, cond, i AS x, j AS y FROM e0 UNION ALL SELECT user_id, boot, cond, j, i FROM e0),
  t1 AS MATERIALIZED (SELECT DISTINCT e.user_id, e.boot, e.cond, e.i, e.j FROM (
    SELECT e0.*, a.y AS z, sx.r AS xz, sy.r AS yz FROM e0 JOIN a0 a ON a.user_id = e0.user_id AND a.boot = e0.boot AND a.cond = e0.cond AND a.x IN (e0.i, e0.j) AND a.y NOT IN (e0.i, e0.j)
    JOIN sym sx ON sx.user_id = e0.user_id AND sx.boot = e0.boot AND sx.cond = e0.cond AND sx.x = e0.i AND sx.y = a.y
    JOIN sym sy ON sy.user_id = e0.user_id AND sy.boot = e0.boot AND sy.cond = e0.cond AND sy.x = e0.j AND sy.y = a.y) e WHERE {indep(part('r', 'xz', 'yz'))}),
  e1 AS MATERIALIZED (SELECT * FROM e0 ANTI JOIN t1 USING (user_id, boot, cond, i, j)),
  a1 AS (SELECT user_id, boot, cond, i AS x, j AS y FROM e1 UNION ALL SELECT user_id, boot, cond, j, i FROM e1),
  q2 AS (SELECT e1.*, a.y AS z, b.y AS u FROM e1 JOIN a1 a ON a.user_id = e1.user_id AND a.boot = e1.boot AND a.cond = e1.cond AND a.x IN (e1.i, e1.j) AND a.y NOT IN (e1.i, e1.j)
    JOIN a1 b ON b.user_id = e1.user_id AND b.boot = e1.boot AND b.cond = e1.cond AND b.x = a.x AND b.y NOT IN (e1.i, e1.j) AND b.y > a.y),
  q3 AS (SELECT q2.*, {', '.join(f"(SELECT s.r FROM sym s WHERE s.user_id = q2.user_id AND s.boot = q2.boot AND s.cond = q2.cond AND s.x = q2.{x} AND s.y = q2.{y}) AS {x}{y}" for x, y in (('i', 'z'), ('j', 'z'), ('i', 'u'), ('j', 'u'), ('u', 'z')))} FROM q2),
  q4 AS (SELECT *, {part('r', 'iz', 'jz')} AS p_ij, {part('iu', 'iz', 'uz')} AS p_iu, {part('ju', 'jz', 'uz')} AS p_ju FROM q3),
  t2 AS (SELECT DISTINCT user_id, boot, cond, i, j FROM q4 WHERE {indep(part('p_ij', 'p_iu', 'p_ju'))}),
  e2 AS (SELECT * FROM e1 ANTI JOIN t2 USING (user_id, boot, cond, i, j))"""


@query("G01_skeleton", f"WITH {search_sql('lab')} SELECT user_id, boot, cond, i, j FROM e2")
def _(spark, sf):
    rows = gs.graph_rows(_panel(spark, sf), FEATS, LABELS["lab"], **K, **OPTIONS)
    return gs.unfold(rows, "edges", "user_id", "boot", "cond")


@query("G01_skeleton_by_test", f"WITH {search_sql('lab')} SELECT user_id, boot, cond, i, j FROM e2")
def _(spark, sf):
    """The same skeletons from the table of questions, filled by a test by name."""
    return _by_test(spark, sf, "pearsonr")


@query("G01_skeleton_ranks", f"WITH {search_sql('lab', ranks=True)} SELECT user_id, boot, cond, i, j FROM e2")
def _(spark, sf):
    rows = gs.graph_rows(_panel(spark, sf), FEATS, LABELS["lab"], ci_test="spearmanr", **K, **OPTIONS)
    return gs.unfold(rows, "edges", "user_id", "boot", "cond")


def _by_test(spark, sf, name):
    days = gs.prepared_days(_panel(spark, sf), FEATS, LABELS["lab"], **K)
    pool = gs.sample_pool(days, FEATS, limit=LIMIT, boots=BOOTS, seed="graph", at_least=MIN_ROWS, **K)
    samples = gs.draw_samples(pool, min_rows=MIN_ROWS, seed="graph", **K)
    rows = gs.correlation_rows(samples, FEATS, sigma=0.001, seed="graph", **K)
    gate = gs.distinct_gate(_panel(spark, sf), FEATS, 5, entity="user_id")
    ready = cut_lineage(rows.join(gate, "user_id").withColumn("limit", gs.critical_r(F.col("n"), 0.05)))
    found = gs.skeleton_by_test(ready, FEATS, name, keys=["user_id", "boot", "cond"], alpha=0.05)
    return gs.unfold(found, "edges", "user_id", "boot", "cond")


@query("G02_partial_correlation", f"""WITH {FILLED}, c AS (SELECT user_id, count(*) AS n, corr(v, k) AS vk, corr(v, n_events) AS vn, corr(k, n_events) AS kn FROM filled WHERE v IS NOT NULL GROUP BY 1),
  p AS (SELECT user_id, n, (vk - vn * kn) / nullif(sqrt((1 - vn * vn) * (1 - kn * kn)), 0) AS r FROM c)
  SELECT user_id, n, {r6s('r')}, {r6(sk.student_p('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 'p_val')} FROM p""")
def _(spark, sf):
    from dayloom.functions import scalars as fn, tails

    c = fx.daily_panel(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), *[fn.correlation(a, b).alias(n) for a, b, n in (("v", "k", "vk"), ("v", "n_events", "vn"), ("k", "n_events", "kn"))])
    out = c.select("user_id", "n", ci_tests.partial_correlation(F.col("vk"), F.col("vn"), F.col("kn")).alias("r"))
    return tidy(out.withColumn("p_val", tails.pearson_p_value(F.col("r"), F.col("n"))))


@query("G03_directed_edges")
def _(spark, sf):
    rows = gs.graph_rows(_panel(spark, sf), FEATS, LABELS["lab3"], **K, **OPTIONS)
    return gs.unfold(rows, "arcs", "user_id", "boot", "cond")


NAMES = f"{FEATS}"


@query("G04_edge_weights", f"WITH {search_sql('lab')} SELECT user_id, boot, cond, {NAMES}[i + 1] AS lo_feature, {NAMES}[j + 1] AS hi_feature, {r6s("w")} FROM e2")
def _(spark, sf):
    rows = gs.graph_rows(_panel(spark, sf), FEATS, LABELS["lab"], **K, **OPTIONS)
    names = F.array(*[F.lit(f) for f in FEATS])
    e = gs.unfold(rows, "edges", "user_id", "boot", "cond", "w")
    return tidy(e.select("user_id", "boot", "cond", F.element_at(names, F.col("i") + 1).alias("lo_feature"), F.element_at(names, F.col("j") + 1).alias("hi_feature"),
                         F.element_at("w", F.col("i") * len(FEATS) + F.col("j") + 1).alias("w")))


@query("G05_entity_status", f"WITH {search_sql('lab')} SELECT user_id, boot, n_stress, n_calm, n_days, status FROM st")
def _(spark, sf):
    days = gs.prepared_days(_panel(spark, sf), FEATS, LABELS["lab"], **K)
    pool = gs.sample_pool(days, FEATS, limit=LIMIT, boots=BOOTS, seed="graph", **K)
    return gs.entity_status(pool, MIN_ROWS, entity="user_id")


@query("G05_sample_correlations", f"WITH {search_sql('lab')} SELECT user_id, boot, cond, i, j, n, {r6s('r', 'w')} FROM cr")
def _(spark, sf):
    days = gs.prepared_days(_panel(spark, sf), FEATS, LABELS["lab"], **K)
    pool = gs.sample_pool(days, FEATS, limit=LIMIT, boots=BOOTS, seed="graph", at_least=MIN_ROWS, **K)
    samples = gs.draw_samples(pool, min_rows=MIN_ROWS, seed="graph", **K)
    rows = gs.correlation_rows(samples, FEATS, sigma=0.001, seed="graph", **K)
    p = len(FEATS)
    cell = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.element_at("c", i * p + j + 1).alias("r"), F.element_at("w", i * p + j + 1).alias("w"))
                              for i in range(p) for j in range(i + 1, p)]))
    return tidy(rows.select("user_id", "boot", "cond", "n", cell))


DEFINITIONS = {
    "lab": (FEATS, "lab"), "lab3": (FEATS, "lab3"), "calls": (FEATS[1:], "lab"), "values": (["v", "k", "v_click"], "lab3"),
}


def _discover(spark, sf):
    steps = {n: (feats, LABELS[l]) for n, (feats, l) in DEFINITIONS.items()}
    return gs.discover(_panel(spark, sf), steps, **K, **OPTIONS)


@query("G06_all_entities")
def _(spark, sf):
    return tidy(gs.definition_edges(_discover(spark, sf), entity="user_id"))


@query("G07_all_definitions", "WITH " + ", ".join(
    f"{n}_d AS (WITH {search_sql(l, mask=feats)} SELECT '{n}' AS definition, user_id, boot, cond, i, j FROM e2)" for n, (feats, l) in DEFINITIONS.items())
    + " " + " UNION ALL ".join(f"SELECT * FROM {n}_d" for n in DEFINITIONS))
def _(spark, sf):
    return gs.unfold(_discover(spark, sf), "edges", "definition", "user_id", "boot", "cond")


# ------------------------------------------------- search, comparison, tests as one chain

#: The study's job: eight features, the configured 100 bootstraps and 10 rows a sample.
STUDY = {"boots": 100, "limit": LIMIT, "min_rows": 10}
STUDY_LABELS = ["lab", "lab3"]


def _study_flag(a: str, b: str) -> str:
    at = lambda theme: ", ".join(str(fx.STUDY_FEATURES.index(f)) for f in fx.STUDY_THEMES[theme])
    return f"((i IN ({at(a)}) AND j IN ({at(b)})) OR (i IN ({at(b)}) AND j IN ({at(a)})))"


def _study_search(label: str) -> str:
    search = search_sql(label, feats=fx.STUDY_FEATURES, boots=STUDY["boots"], min_rows=STUDY["min_rows"])
    return f"""{label}_g AS (WITH {search} SELECT '{label}' AS definition, s.user_id, s.boot, s.cond, e2.i, e2.j FROM (SELECT DISTINCT user_id, boot, cond FROM smp) s
    LEFT JOIN e2 ON e2.user_id = s.user_id AND e2.boot = s.boot AND e2.cond = s.cond)"""


DID = "definition, user_id, boot, label"
#: Undirected, so no edge's direction is needed: ``pr`` has the pairs of graphs' edges, ``hv`` the pairs.
STUDY_SQL = f"""{', '.join(_study_search(label) for label in STUDY_LABELS)},
  tg AS MATERIALIZED (SELECT *, CASE WHEN cond IN ('stress', 'no_stress') THEN 'stress' ELSE 'reference' END AS label, cond IN ('no_stress', 'b') AS base
    FROM ({' UNION ALL '.join(f'SELECT * FROM {label}_g' for label in STUDY_LABELS)})),
  hv AS (SELECT {DID} FROM tg GROUP BY ALL HAVING bool_or(base) AND bool_or(NOT base)),
  pr AS (SELECT {DID}, i, j, bool_or(base) AS inb, bool_or(NOT base) AS ino FROM tg SEMI JOIN hv USING ({DID}) WHERE i IS NOT NULL GROUP BY ALL),
  cmp AS (SELECT {DID}, coalesce(count(*) FILTER (WHERE inb AND ino) / nullif(count(i), 0), 0) AS int_union,
    count(*) FILTER (WHERE inb AND NOT ino) AS n_added, count(*) FILTER (WHERE ino AND NOT inb) AS n_removed,
    {', '.join(f"count(*) FILTER (WHERE inb AND {_study_flag(a, b)}) - count(*) FILTER (WHERE ino AND {_study_flag(a, b)}) AS {k}" for k, (a, b) in vocab.THEME_PAIRS.items())}
    FROM hv LEFT JOIN pr USING ({DID}) GROUP BY ALL)"""


def _study(spark, sf):
    """Search, stored graphs, stored comparison of both definitions; the run's name is its parameters."""
    path, run = scratch_table(spark, "study"), {k: STUDY[k] for k in ("boots", "min_rows")}
    days = fx.daily_panel(spark, sf).select("user_id", "date", *STUDY_LABELS, *fx.STUDY_FEATURES)
    found = gs.discover(days, {n: (fx.STUDY_FEATURES, LABELS[n]) for n in STUDY_LABELS}, **K, **STUDY)
    study.store_graphs(found, path, run, entity="user_id")
    study.store_comparison(spark, path, run, entity="user_id", n_nodes=len(fx.STUDY_FEATURES), themes=fx.STUDY_THEMES)
    return path, run


@query("C07_study_comparison", f"WITH {STUDY_SQL} SELECT {DID}, {r6s('int_union')}, n_added, n_removed, {', '.join(vocab.THEME_PAIRS)} FROM cmp")
def _(spark, sf):
    path, run = _study(spark, sf)
    c = study.stored_comparison(spark, path, **run)
    return tidy(c.select(
        "definition", "user_id", "boot", "label", "int_union", F.size("only_in_base").cast("long").alias("n_added"),
        F.size("only_in_other").cast("long").alias("n_removed"), *vocab.THEME_PAIRS))


@query("C09_study_summary", f"""WITH {STUDY_SQL}, nm AS (SELECT {fx.STUDY_FEATURES} AS f),
  chg AS (SELECT user_id, least(f[i + 1], f[j + 1]) AS lo, greatest(f[i + 1], f[j + 1]) AS hi, inb AS added FROM pr CROSS JOIN nm WHERE label = 'stress' AND definition = 'lab3' AND inb <> ino),
  nb AS (SELECT count(DISTINCT boot) AS n FROM hv WHERE definition = 'lab3'),
  who AS (SELECT user_id FROM hv WHERE label = 'stress' AND definition = 'lab3' GROUP BY 1 HAVING count(*) >= 2),
  ct AS (SELECT user_id, lo, hi, count(*) FILTER (WHERE added) AS a, count(*) FILTER (WHERE NOT added) AS r FROM chg GROUP BY ALL)
  SELECT user_id, lo, hi, {r6('coalesce(a, 0) / n', 'percent_added')}, {r6('coalesce(r, 0) / n', 'percent_removed')}
  FROM who CROSS JOIN (SELECT DISTINCT lo, hi FROM chg) CROSS JOIN nb LEFT JOIN ct USING (user_id, lo, hi)""")
def _(spark, sf):
    path, run = _study(spark, sf)
    return tidy(study.summarised(study.stored_comparison(spark, path, **run, definition="lab3"), entity="user_id"))


#: ``difference`` needs the edges' directions, which the SQL search does not have.
UNDIRECTED = [m for m in vocab.SCALAR_MEASURES if m != "difference"]


@query("ST11_study_measures", f"""WITH {STUDY_SQL},
  ml AS (UNPIVOT (SELECT definition, user_id, label, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in UNDIRECTED)} FROM cmp) ON {', '.join(UNDIRECTED)} INTO NAME measure VALUE x),
  mm AS (SELECT definition, user_id, measure, avg(x) FILTER (WHERE label = 'stress') AS mx, avg(x) FILTER (WHERE label <> 'stress') AS my,
    var_samp(x) FILTER (WHERE label = 'stress') AS vx, var_samp(x) FILTER (WHERE label <> 'stress') AS vy,
    count(*) FILTER (WHERE label = 'stress') AS nx, count(*) FILTER (WHERE label <> 'stress') AS ny FROM ml GROUP BY ALL),
  tt AS (SELECT *, (mx - my) / nullif(sqrt(vx / nx + vy / ny), 0) AS t, (vx / nx + vy / ny) ** 2 / nullif((vx / nx) ** 2 / nullif(nx - 1, 0) + (vy / ny) ** 2 / nullif(ny - 1, 0), 0) AS df FROM mm)
  SELECT definition, user_id, measure, {r6(sk.student_p('t', 'df', 2000), 'p_val')}, CASE WHEN mx >= 0 THEN 'Loss' ELSE 'Gain' END AS direction FROM tt WHERE t IS NOT NULL""")
def _(spark, sf):
    path, run = _study(spark, sf)
    tests = study.measure_tests(study.stored_comparison(spark, path, **run), UNDIRECTED, entity="user_id", method="t")
    return tidy(tests.select("definition", "user_id", "measure", "p_val", "direction"))


#: Columns of the panel that play the roles of the named labels and of the features.
ROLES = {
    "daily_stressed": "lab", "daily_shifts": "lab", "shift_stress": "lab3", "control_cat": "v_view", "daily_control": "v",
    "ppe_6": "v_signup", "log_hrv": "k", "efficiency": "n_events", "hr_average": "v_click",
}
NAMED = ["total_stress", "daily_control", "ppe_6", "hrv_binary", "any_stress", "shift_stress"]
ROLE_FEATS = ["daily_control", "efficiency", "log_hrv", "hr_average"]


def _named_sql(name: str) -> str:
    """Label of a definition as (expression, tables before it, table it reads)."""
    extra = lambda what, e: (f"{what}_t AS (SELECT *, {e} AS {what} FROM filled), ", f"{what}_t")
    total = extra("total", "coalesce(lab, 0) / 2.0 + coalesce(lab3, 0) / 2.0 + coalesce(v_view, 0) / 3.0")
    back = extra("back", f"first_value(v_signup IGNORE NULLS) OVER ({sk.W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)")
    hrv = sk.label(sk.percentile("k"), one=0, zero=1)
    flags = extra("hrv", hrv)
    return {
        "total_stress": (sk.label(sk.percentile("total")), *total),
        "daily_control": (sk.label(sk.percentile("v")), "", "filled"),
        "ppe_6": (sk.label(sk.percentile("back")), *back),
        "hrv_binary": (hrv, "", "filled"),
        "any_stress": ("CASE WHEN lab = 1 OR lab3 = 1 OR hrv = 1 THEN 1 WHEN lab = 0 AND lab3 = 0 AND hrv = 0 THEN 0 END", *flags),
        "shift_stress": ("lab3", "", "filled"),
    }[name]


def _named(spark, sf):
    cols = [*dict.fromkeys(ROLES.values())]
    days = fx.daily_panel(spark, sf).select("user_id", "date", *cols)
    return gs.discover(days, labels.definitions(NAMED, ROLE_FEATS, ROLES, **K), **K, **OPTIONS)


_NAMED_FEATS = list(dict.fromkeys(ROLES[f] for n in NAMED for f in vocab.resolve_features(ROLE_FEATS, n)))


@query("G05_named_labels", "WITH " + ", ".join(
    f"{n}_d AS (WITH {search_sql(e, before=b, src=t, feats=_NAMED_FEATS, mask=[ROLES[f] for f in vocab.resolve_features(ROLE_FEATS, n)])} SELECT '{n}' AS definition, user_id, boot, cond, i, j FROM e2)"
    for n in NAMED for e, b, t in [_named_sql(n)]) + " " + " UNION ALL ".join(f"SELECT * FROM {n}_d" for n in NAMED))
def _(spark, sf):
    """Skeletons of six labels by name: percentiles, a back-filled one, composites and flags."""
    return gs.unfold(_named(spark, sf), "edges", "definition", "user_id", "boot", "cond")
