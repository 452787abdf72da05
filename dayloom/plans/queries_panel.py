"""Window and time-series operators on the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import scalars as fn
from dayloom.operators import change, panel, runs
from dayloom.plans import fixtures as fx, sqlkit as sk
from dayloom.plans.fixtures import FILLED, PANEL
from dayloom.plans.registry import query, r6, r6s, tidy

K = {"entity": "user_id", "date": "date"}
DAY = "CAST(date AS VARCHAR) AS date"
GAPPY = ["v", "v_click", "v_view"]
WF = f"WITH {FILLED} "


def _filled(spark, sf, *cols):
    p = fx.daily_panel(spark, sf)
    return panel.fill_days(p.select("user_id", "date", *cols) if cols else p, **K)


@query("A03_group_scalers", f"WITH {PANEL} SELECT user_id, {DAY}, {r6('v', 'v')}, {r6('min(v) OVER u', 'min')}, {r6('max(v) OVER u', 'max')}, "
       f"{r6('avg(v) OVER u', 'mean')}, {r6('stddev_pop(v) OVER u', 'std')} FROM panel WINDOW u AS (PARTITION BY user_id)")
def _(spark, sf):
    return tidy(panel.group_scalers(fx.daily_panel(spark, sf).select("user_id", "date", "v"), "v", entity="user_id"))


@query("W01_day_spine", WF + f"SELECT user_id, {DAY}, {r6s('v', 'v_click')}, lab FROM filled")
def _(spark, sf):
    return tidy(_filled(spark, sf, "v", "v_click", "lab"))


@query("W01_first_row_per_day", f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id, value,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events),
  one AS (SELECT * EXCLUDE (rn) FROM e WHERE rn = 1),
  spine AS (SELECT user_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM one GROUP BY 1)
  SELECT s.user_id, CAST(s.date AS VARCHAR) AS date, event_id, value FROM spine s LEFT JOIN one o ON s.user_id = o.user_id AND s.date = o.date""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("date"), "ts", "event_id", "value")
    one = panel.first_row_per_day(ev, **K, order=["ts", "event_id"]).drop("ts")
    return tidy(panel.fill_days(one, **K))


@query("W02_weekly_spine", f"""WITH {PANEL}, s AS (SELECT user_id, CAST(unnest(generate_series(
    min(date) + CAST((7 - isodow(min(date))) AS INTEGER), max(date) + CAST((7 - isodow(max(date))) AS INTEGER), INTERVAL 7 DAY)) AS DATE) AS date FROM panel GROUP BY 1)
  SELECT s.user_id, CAST(s.date AS VARCHAR) AS date, v, lab FROM s LEFT JOIN panel p ON s.user_id = p.user_id AND s.date = p.date""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v", "lab")
    return tidy(panel.fill_periods(p, "W", **K))


@query("W02_three_day_spine", f"""WITH {PANEL}, s AS (SELECT user_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 DAY)) AS DATE) AS date FROM panel GROUP BY 1)
  SELECT s.user_id, CAST(s.date AS VARCHAR) AS date, v, lab FROM s LEFT JOIN panel p ON s.user_id = p.user_id AND s.date = p.date""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v", "lab")
    return tidy(panel.fill_periods(p, "3D", **K))


@query("W03_z_score", WF + f", {sk.z_score('filled', 'z', GAPPY)} SELECT user_id, {DAY}, {r6s(*GAPPY)} FROM z")
def _(spark, sf):
    return tidy(panel.z_score(_filled(spark, sf, *GAPPY), GAPPY, entity="user_id"))


@query("W04_interpolate", WF + f", {sk.interpolate('filled', 'i', GAPPY)} SELECT user_id, {DAY}, {r6s(*GAPPY)} FROM i")
def _(spark, sf):
    return tidy(panel.interpolate(_filled(spark, sf, *GAPPY), GAPPY, **K))


@query("W05_forward_fill", WF + f"""SELECT user_id, {DAY}, {", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({sk.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c}" for c in GAPPY)} FROM filled""")
def _(spark, sf):
    return tidy(panel.forward_fill(_filled(spark, sf, *GAPPY), GAPPY, 2, **K))


@query("W06_backward_fill", WF + f"""SELECT user_id, {DAY}, {", ".join(
    f"first_value({c} IGNORE NULLS) OVER ({sk.W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS {c}" for c in GAPPY)} FROM filled""")
def _(spark, sf):
    return tidy(panel.backward_fill(_filled(spark, sf, *GAPPY), GAPPY, 7, **K))


@query("W07_entity_mean_fill", WF + f"SELECT user_id, {DAY}, {', '.join(r6(f'coalesce({c}, avg({c}) OVER (PARTITION BY user_id))', c) for c in GAPPY)} FROM filled")
def _(spark, sf):
    return tidy(panel.fill_with_mean(_filled(spark, sf, *GAPPY), GAPPY, entity="user_id"))


PREP = f"""{sk.z_score('filled', 'z', GAPPY)},
  zm AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY user_id) AS m_{c}' for c in GAPPY)} FROM z),
  {sk.interpolate('zm', 'zi', GAPPY)},
  prep AS (SELECT * EXCLUDE ({', '.join('m_' + c for c in GAPPY)}) REPLACE ({', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in GAPPY)}) FROM zi)"""


@query("W07_prepared_panel", WF + f", {PREP} SELECT user_id, {DAY}, {r6s(*GAPPY)} FROM prep")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", *GAPPY)
    return tidy(panel.prepare(p, GAPPY, **K))


@query("W08_percentile", WF + f"SELECT user_id, {DAY}, {r6(sk.percentile('v'), 'v_percentile')}, {r6(sk.percentile('v_click'), 'v_click_percentile')}, {r6(sk.percentile('lab3'), 'lab3_percentile')} FROM filled")
def _(spark, sf):
    out = panel.add_percentiles(_filled(spark, sf, "v", "v_click", "lab3"), ["v", "v_click", "lab3"], entity="user_id")
    return tidy(out.drop("v", "v_click", "lab3"))


@query("W09_percentile_bins", WF + f", q AS (SELECT *, {sk.percentile('lab3')} AS p, {sk.percentile('v')} AS pv FROM filled) SELECT user_id, {DAY}, {sk.bins('p')} AS lab3_percentile, {sk.bins('pv')} AS v_percentile FROM q")
def _(spark, sf):
    out = panel.add_quartile_bins(_filled(spark, sf, "lab3", "v"), ["lab3", "v"], entity="user_id")
    return tidy(out.select("user_id", "date", "lab3_percentile", "v_percentile"))


@query("W09_composite_percentile", WF + f""", t AS (SELECT user_id, date, coalesce(lab, 0) / 2.0 + coalesce(lab3, 0) / 2.0 + coalesce(v_click, 0) / 3.0 AS total_stress FROM filled),
  q AS (SELECT *, {sk.percentile('total_stress')} AS p FROM t)
  SELECT user_id, {DAY}, {r6s('total_stress')}, {sk.bins('p')} AS total_stress_percentile FROM q""")
def _(spark, sf):
    p = _filled(spark, sf, "lab", "lab3", "v_click")
    t = p.withColumn("total_stress", fn.composite_stress("lab", "lab3", "v_click")).drop("lab", "lab3", "v_click")
    return tidy(panel.add_quartile_bins(t, ["total_stress"], entity="user_id"))


@query("W10_percentile_labels", WF + f""", t AS (SELECT *, coalesce(lab, 0) / 2.0 + coalesce(lab3, 0) / 2.0 + coalesce(v_click, 0) / 3.0 AS total FROM filled),
  q AS (SELECT *, {sk.percentile('total')} AS p_total, {sk.percentile('v')} AS p_v, {sk.percentile('k')} AS p_k FROM t)
  SELECT user_id, {DAY}, {sk.label('p_total')} AS total_stress, {sk.label('p_v')} AS daily_control,
    {sk.label('p_k', one=0, zero=1)} AS hrv_binary, {sk.label('v_click', 75, 25)} AS control_cat FROM q""")
def _(spark, sf):
    p = _filled(spark, sf, "lab", "lab3", "v_click", "v", "k")
    p = p.withColumn("total", fn.composite_stress("lab", "lab3", "v_click"))
    cut = {"entity": "user_id", "hi": 0.75, "lo": 0.25}
    p = panel.percentile_label(p, "total", "total_stress", **cut)
    p = panel.percentile_label(p, "v", "daily_control", **cut)
    p = panel.percentile_label(p, "k", "hrv_binary", **cut, reverse=True)
    p = panel.percentile_label(p, "v_click", "control_cat", entity="user_id", hi=75, lo=25, raw=True)
    return tidy(p.select("user_id", "date", "total_stress", "daily_control", "hrv_binary", "control_cat"))


@query("W11_low_score_rolling", WF + f""", a AS (SELECT *, {sk.percentile('v')} AS p FROM filled),
  b AS (SELECT *, CASE WHEN {sk.bins('p')} < 0.75 THEN 1 ELSE 0 END AS bad FROM a),
  c AS (SELECT *, CAST({sk.full_frame('sum', 'bad', 3, 0)} AS BIGINT) AS roll FROM b),
  d AS (SELECT *, {sk.percentile('roll')} AS p2 FROM c)
  SELECT user_id, {DAY}, {sk.bins('p')} AS sleep_percentile, bad AS bad_sleep, roll AS bad_sleep_rolling, {sk.bins('p2')} AS bad_sleep_rolling_percentile FROM d""")
def _(spark, sf):
    return tidy(panel.low_score_rolling(_filled(spark, sf, "v"), "v", 2, **K).drop("v"))


@query("W12_downsample", WF + f""", r AS (SELECT user_id, date, {sk.full_frame('avg', 'v', 2, 0)} AS v, {sk.full_frame('avg', 'k', 2, 0)} AS k, row_number() OVER ({sk.W}) - 1 AS pos FROM filled)
  SELECT user_id, {DAY}, {r6s('v', 'k')} FROM r WHERE pos > 0 AND pos % 3 = 0""")
def _(spark, sf):
    return tidy(panel.downsample(_filled(spark, sf, "v", "k"), ["v", "k"], 3, **K))


@query("W13_rolling_band", WF + f""", a AS (SELECT user_id, date, {sk.full_frame('avg', 'v', 3, 3)} AS m, {sk.full_frame('stddev_samp', 'v', 3, 3)} AS s FROM filled),
  b AS (SELECT *, avg(m) OVER (PARTITION BY user_id) AS c, nullif(stddev_pop(m) OVER (PARTITION BY user_id), 0) AS d FROM a)
  SELECT user_id, {DAY}, {r6('m', 'rolling_v')}, {r6('s', 'rolling_v_std')}, {r6('m + s / 2', 'rolling_v_plus')}, {r6('m - s / 2', 'rolling_v_minus')},
    {r6('(m - c) / d', 'z_rolling_v')}, {r6('s / d', 'z_rolling_v_std')}, {r6('(m - c) / d + s / d / 2', 'z_rolling_v_plus')}, {r6('(m - c) / d - s / d / 2', 'z_rolling_v_minus')} FROM b""")
def _(spark, sf):
    return tidy(panel.rolling_band(_filled(spark, sf, "v"), "v", **K).drop("v"))


@query("W14_rolling_means", WF + f"SELECT user_id, {DAY}, {r6(sk.full_frame('avg', 'v', 4, 0), 'trailing')}, {r6(sk.full_frame('avg', 'v', 3, 2), 'centred')} FROM filled")
def _(spark, sf):
    p = _filled(spark, sf, "v")
    return tidy(p.select("user_id", "date", panel.trailing_mean("v", 5, **K).alias("trailing"), panel.centred_mean("v", 6, **K).alias("centred")))


MMD_COLS = ["v", "k"]
MMD_SQL = WF + f""", {sk.interpolate('filled', 'i', MMD_COLS)},
  m AS (SELECT user_id, date, {sk.mmd('v', 3)} AS a, {sk.mmd('k', 3)} AS b FROM i)"""


@query("W15_rolling_mmd", MMD_SQL + f"SELECT user_id, {DAY}, {r6('a', 'v_MMD')}, {r6('b', 'k_MMD')}, {r6('(coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0)', 'average_MMD')} FROM m")
def _(spark, sf):
    p = panel.interpolate(_filled(spark, sf, *MMD_COLS), MMD_COLS, **K)
    return tidy(panel.rolling_mmd_average(p, MMD_COLS, 3, **K).drop(*MMD_COLS))


@query("W15_rolling_mmd_rbf", WF + f""", {sk.interpolate('filled', 'i', ['v'])}, z AS (SELECT user_id, date, v / 100 AS v FROM i),
  r AS (SELECT *, list(v) OVER ({sk.W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS l FROM z),
  h AS (SELECT user_id, date, l[1:3] AS a, l[4:6] AS b, len(l) = 6 AND list_count(l) = 6 AS whole FROM r)
  SELECT user_id, {DAY}, {r6("CASE WHEN whole THEN (SELECT avg(exp(-1 * (x - y) * (x - y))) FROM (SELECT unnest(a) AS x) JOIN (SELECT unnest(a) AS y) ON true) + (SELECT avg(exp(-1 * (x - y) * (x - y))) FROM (SELECT unnest(b) AS x) JOIN (SELECT unnest(b) AS y) ON true) - 2 * (SELECT avg(exp(-1 * (x - y) * (x - y))) FROM (SELECT unnest(a) AS x) JOIN (SELECT unnest(b) AS y) ON true) END", 'v_MMD')} FROM h""")
def _(spark, sf):
    p = panel.interpolate(_filled(spark, sf, "v"), ["v"], **K).withColumn("v", F.col("v") / 100)
    return tidy(p.select("user_id", "date", panel.rolling_mmd("v", 3, **K, kind="rbf").alias("v_MMD")))


@query("W16_window_test", f"""WITH {PANEL}, l AS (SELECT user_id, list(v ORDER BY date) AS vs, count(*) AS n FROM panel GROUP BY 1)
  SELECT user_id, CASE WHEN n = 26 THEN round((list_avg(vs[1:13]) - list_avg(vs[14:26])) ** 2, 6) + 0.0 END AS mmd FROM l""")
def _(spark, sf):
    # an entity's days: bounded by the calendar
    l = fx.daily_panel(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("date", "v"))).alias("vs"))
    return tidy(l.select("user_id", panel.window_test(F.col("vs.v"), 13, panel.ARRAY_MMD["linear"]).alias("mmd")))


def _corr_sql(shift: int) -> str:
    other = f"lag(k, {shift}) OVER ({sk.W})" if shift >= 0 else f"lead(k, {-shift}) OVER ({sk.W})"
    keep = f"rn > {shift}" if shift >= 0 else f"rn <= nn - {-shift}"
    return WF + f""", a AS (SELECT user_id, v, {other} AS b, row_number() OVER ({sk.W}) AS rn, count(*) OVER (PARTITION BY user_id) AS nn FROM filled WHERE v IS NOT NULL),
  c AS (SELECT user_id, corr(v, b) AS r, count(*) AS n, count(b) AS kn FROM a WHERE {keep} GROUP BY 1),
  d AS (SELECT user_id, n, CASE WHEN n >= 2 AND kn = n AND NOT isnan(r) THEN r END AS r FROM c)
  SELECT user_id, n, {r6s('r')}, {r6(sk.student_p('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 'p_val')} FROM d"""


for _name, _shift in (("W17_correlation", 0), ("W17_correlation_lag", 2), ("W17_correlation_lead", -1)):

    @query(_name, _corr_sql(_shift))
    def _(spark, sf, shift=_shift):
        return tidy(change.lagged_correlation(_filled(spark, sf, "v", "k"), "v", "k", **K, shift=shift))


@query("W18_shift", WF + f"SELECT user_id, {DAY}, lag(v, 2) OVER ({sk.W}) AS before, lead(v, 1) OVER ({sk.W}) AS after FROM filled")
def _(spark, sf):
    p = _filled(spark, sf, "v")
    return tidy(p.select("user_id", "date", panel.shift("v", 2, **K).alias("before"), panel.shift("v", -1, **K).alias("after")))


@query("W19_pad_label", f"""WITH RECURSIVE {FILLED}, r AS (SELECT user_id, date, lab, row_number() OVER ({sk.W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM filled),
  g AS (SELECT user_id, i, CASE WHEN i >= 2 AND i < n - 2 AND lab = 1 THEN 1 ELSE 0 END AS cand FROM r),
  walk AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS nxt, false AS hit FROM (SELECT DISTINCT user_id FROM g)
    UNION ALL SELECT w.user_id, w.i + 1, CASE WHEN g.cand = 1 AND w.i >= w.nxt THEN w.i + 3 ELSE w.nxt END, g.cand = 1 AND w.i >= w.nxt
    FROM walk w JOIN g ON g.user_id = w.user_id AND g.i = w.i),
  hits AS (SELECT user_id, i - 1 AS at FROM walk WHERE hit)
  SELECT r.user_id, CAST(r.date AS VARCHAR) AS date, CAST(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.user_id = r.user_id AND abs(h.at - r.i) <= 2) THEN 1 ELSE lab END AS DOUBLE) AS lab FROM r""")
def _(spark, sf):
    return tidy(panel.pad_label(_filled(spark, sf, "lab"), "lab", 2, **K))


RUN_SQL = FILLED + f""", {sk.runs('filled', 'rr', 'lab3')}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS g FROM rr WHERE lab3 IN (0, 1, 2)),
  b AS (SELECT l.*, boot, row_number() OVER (PARTITION BY user_id, boot, run ORDER BY md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR), CAST(boot AS VARCHAR), 'runs')), date) AS r
    FROM l CROSS JOIN (SELECT CAST(unnest(generate_series(0, 1)) AS INTEGER) AS boot)),
  kept AS (SELECT *, CASE WHEN g BETWEEN 2 AND 3 THEN 0 ELSE r END AS slot FROM b WHERE g <= 3 OR r <= g // 2),
  iid AS (SELECT user_id, boot, CASE WHEN lab3 = 0 THEN 'no_stress' ELSE 'stress' END AS cond, min(date) AS date, avg(v) AS v, avg(k) AS k FROM kept GROUP BY user_id, boot, run, lab3, slot)"""


@query("W20_run_sampling", f"WITH {RUN_SQL} SELECT user_id, boot, cond, {DAY}, {r6s('v', 'k')} FROM iid")
def _(spark, sf):
    out = runs.sample_runs(_filled(spark, sf, "v", "k", "lab3"), ["v", "k"], "lab3", limit=3, boots=2, seed="runs", **K)
    return tidy(out)


@query("T07_long_run_sample", f"WITH {RUN_SQL} SELECT user_id, boot, {DAY}, run FROM kept WHERE g > 3")
def _(spark, sf):
    out = runs.ranked_runs(_filled(spark, sf, "lab3"), "lab3", boots=2, seed="runs", **K)
    return tidy(out.where((F.col("g") > 3) & (F.col("r") <= F.floor(F.col("g") / 2))).select("user_id", "boot", "date", "run"))


@query("W21_label_timeline", WF + f""", q AS (SELECT *, {sk.percentile('k')} AS p FROM filled), h AS (SELECT *, {sk.label('p', one=0, zero=1)} AS hrv FROM q)
  SELECT user_id, {DAY}, {', '.join(f"CAST(CASE WHEN {c} = 1 THEN 1 WHEN {c} = 0 THEN -1 ELSE 0 END AS DOUBLE) AS {o}" for c, o in (('lab', 'daily_stressed'), ('lab3', 'daily_shifts'), ('hrv', 'hrv_binary')))},
    CAST(CASE WHEN lab3 IN (1, 2) THEN 1 ELSE lab3 END AS DOUBLE) AS daily_shifts_binary FROM h""")
def _(spark, sf):
    p = panel.percentile_label(_filled(spark, sf, "lab", "lab3", "k"), "k", "hrv", entity="user_id", hi=0.75, lo=0.25, reverse=True)
    return tidy(p.select("user_id", "date", fn.sign_code("lab").alias("daily_stressed"), fn.sign_code("lab3").alias("daily_shifts"),
                         fn.sign_code("hrv").alias("hrv_binary"), fn.any_shift("lab3").alias("daily_shifts_binary")))


@query("W22_change_vs_condition", WF + f""", {sk.interpolate('filled', 'i', MMD_COLS)}, {sk.z_score('i', 'z', MMD_COLS)},
  q AS (SELECT *, coalesce({sk.percentile('lab3')}, 0) AS cond FROM z),
  m AS (SELECT user_id, date, {sk.mmd('v', 3)} AS a, {sk.mmd('k', 3)} AS b, {sk.mmd('cond', 3)} AS c FROM q),
  n AS (SELECT user_id, date, c, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS f FROM m),
  o AS (SELECT user_id, f, lag(c, 1) OVER ({sk.W}) AS c, row_number() OVER ({sk.W}) AS rn FROM n WHERE f IS NOT NULL),
  e AS (SELECT user_id, corr(f, c) AS r0, count(*) AS n, count(c) AS kn FROM o WHERE rn > 1 GROUP BY 1),
  d AS (SELECT user_id, n, CASE WHEN n >= 2 AND kn = n AND NOT isnan(r0) THEN r0 END AS r FROM e)
  SELECT user_id, n, {r6s('r')}, {r6(sk.student_p('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 'p_val')} FROM d""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", *MMD_COLS, "lab3")
    return tidy(change.change_vs_condition(p, MMD_COLS, "lab3", 3, **K, shift=1))
