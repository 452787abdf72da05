"""Scans, row functions, joins and profiles on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom import vocab
from dayloom.functions import scalars as fn
from dayloom.operators import merge, profile, sampling
from dayloom.operators.ordered import dense_codes
from dayloom.plans import fixtures as fx, sqlkit as sk
from dayloom.plans.fixtures import ONCE, PANEL
from dayloom.plans.registry import query, r6, r6s, tidy
from dayloom.session import scratch_table
from dayloom.sources import readers, writers

WP = f"WITH {PANEL} "
DAY = "CAST(date AS VARCHAR) AS date"


def rows(name: str, exprs, sql_cols: str, source=fx.daily_panel, keys=("user_id", "date"), sql_from=None):
    """Register a row-function query: keys plus computed columns."""
    frm = sql_from or f"WITH {PANEL} SELECT user_id, {DAY}, {{}} FROM panel"

    @query(name, frm.format(sql_cols))
    def _(spark, sf):
        return tidy(source(spark, sf).select(*keys, *[e.alias(c) for c, e in exprs().items()]))


# ------------------------------------------------------------------- scans

@query("S01_parquet_scan", "SELECT user_id, event_type, value FROM events")
def _(spark, sf):
    return readers.read_table(spark, f"{sf}/events.parquet", ["user_id", "event_type", "value"])


CUSTOMER = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"


@query("S02_gzip_csv_scan", CUSTOMER)
def _(spark, sf):
    path = scratch_table(spark, "survey")
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    c.write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_survey_csv(spark, path, c.schema)


@query("S03_parquet_sink", f"WITH {PANEL} SELECT user_id, {DAY}, v, lab FROM panel")
def _(spark, sf):
    path = scratch_table(spark, "panel")
    writers.write_panel(fx.daily_panel(spark, sf).select("user_id", "date", "v", "lab"), path, entity="user_id")
    return tidy(readers.read_table(spark, path))


@query("S04_result_store", f"WITH {fx.EDGES} SELECT user_id, boot, cond, src, dst, weight, 'steps' AS definition FROM edges WHERE cond = 'stress'")
def _(spark, sf):
    path = scratch_table(spark, "edges")
    writers.write_results(fx.edges(spark, sf), path, {"definition": "steps"}, ["cond"])
    writers.write_results(fx.edges(spark, sf), path, {"definition": "other"}, ["cond"])
    return writers.read_results(spark, path, definition="steps", cond="stress")


@query("S05_panel_scan", "SELECT user_id, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events")
def _(spark, sf):
    return tidy(readers.read_panel(spark, f"{sf}/events.parquet", "ts", ["user_id", "event_id"]))


@query(
    "S06_daily_derived",
    f"""WITH {PANEL},
    d AS (SELECT user_id, date, v_click AS a, lab AS b, lab3 AS c, lab3 + lab AS sam7, k FROM panel)
    SELECT user_id, {DAY}, CASE WHEN a IS NULL OR a <> 0 THEN a WHEN b <> 0 THEN b ELSE c END AS covid_shift_any,
      CASE WHEN sam7 IN (1, 2) THEN 1 WHEN sam7 IN (3, 4, 5, 6) THEN 0 ELSE sam7 END AS shift_stress,
      CASE WHEN k >= 75 THEN 0 WHEN k >= 50 THEN 1 WHEN k >= 25 THEN 2 WHEN k < 25 THEN 3 ELSE 0 END AS control_cat
    FROM d""",
)
def _(spark, sf):
    p = fx.daily_panel(spark, sf)
    renamed = p.select(
        "user_id", "date",
        F.col("v_click").alias("daily_covid_shifts___1"), F.col("lab").alias("daily_covid_shifts___2"),
        F.col("lab3").alias("daily_covid_shifts___3"), (F.col("lab3") + F.col("lab")).alias("sam7"),
        F.col("k").alias("daily_control"),
    )
    out = readers.daily_scores(renamed)
    return tidy(out.select("user_id", "date", "covid_shift_any", "shift_stress", "control_cat"))


ITEMS = ["c_acctbal", "c_nationkey", "c_custkey"]


@query(
    "S07_entity_item_scores",
    "SELECT c_custkey AS user_id, "
    + ", ".join(
        f"round({' + '.join(f'(c_acctbal + {i})' for i in range(1, n + 1))}, 6) + 0.0 AS {s}"
        for s, n in (("ace_score", 10), ("ptsd_score", 17), ("life_events_score", 10))
    )
    + " FROM customer",
)
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    item = {x: F.col("c_acctbal") + i for s in vocab.ONCE_SCORES for i, x in enumerate(vocab.items(s), 1)}
    out = readers.item_scores(c.withColumns(item), vocab.ONCE_SCORES)
    return tidy(out.select("user_id", *vocab.ONCE_SCORES))


@query("S08_feed_ingest_day", f"""SELECT event_id, user_id, {r6('value', 'value')}, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events
  UNION ALL SELECT o_orderkey, o_custkey, {r6('o_totalprice')}, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders""")
def _(spark, sf):
    feeds = {"events": (f"{sf}/events.parquet", "ts"), "orders": (f"{sf}/orders.parquet", "o_orderdate")}
    out = scratch_table(spark, "feeds")
    writers.ingest_feeds(spark, feeds, out, period="month")
    done = writers.ingest_feeds(spark, feeds, out, period="month")  # a second run changes nothing
    a = readers.read_table(spark, done["events"], ["event_id", "user_id", "value", "date"])
    b = readers.read_table(spark, done["orders"], ["o_orderkey", "o_custkey", "o_totalprice", "date"])
    return tidy(a.union(b))


# ------------------------------------------------------------ row functions

@query("P01_day", """SELECT doc_id, CAST(TRY_CAST(s AS DATE) AS VARCHAR) AS date FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not a day' ELSE '2024-01-0' || (1 + doc_id % 9) || ' 10:00:00' END AS s
  FROM documents)""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    text = F.when(F.col("doc_id") % 3 == 0, "not a day").otherwise(
        F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" 10:00:00"))
    )
    return tidy(d.select("doc_id", fn.day(text).alias("date")))


@query("P02_schedule_column", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("daily858_scheduledate"), F.col("ts").alias("other_scheduledate")
    )
    return tidy(readers.with_schedule_day(ev).select("event_id", "date"))


@query("P03_rename", "SELECT c_custkey AS user_id, c_mktsegment AS hx_none, c_acctbal AS alcohol FROM customer")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("med_4___1"),
        F.col("c_acctbal").alias("lifestyle1"),
    )
    return c.withColumnsRenamed(vocab.coded_columns())


@query("P04_repeated_columns", f"WITH {PANEL} SELECT a.user_id, CAST(a.date AS VARCHAR) AS date, a.v, a.k FROM panel a")
def _(spark, sf):
    p = fx.daily_panel(spark, sf)
    left, right = p.select("user_id", "date", "v"), p.select("user_id", "date", F.lit(0.0).alias("v"), "k")
    return tidy(merge.left_chain(left, [right], ["user_id", "date"]))


rows("P05_truthy_or", lambda: {"any_flag": fn.first_truthy("lab", "lab3", "v_click")},
     "CASE WHEN lab IS NULL OR lab <> 0 THEN lab WHEN lab3 IS NULL OR lab3 <> 0 THEN lab3 ELSE v_click END AS any_flag")
rows("P06_item_sum", lambda: {"score": fn.item_sum(["v", "v_click", "v_view", "k"])},
     r6("v + v_click + v_view + k", "score"))
rows("P07_log", lambda: {"log_v": fn.natural_log("lab3"), "log_k": fn.natural_log("v")},
     "CASE WHEN lab3 = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(ln(lab3) + 1e-9, 6) + 0.0 END AS log_v, "
     "CASE WHEN v = 0 THEN CAST('-inf' AS DOUBLE) WHEN v > 0 THEN round(ln(v) + 1e-9, 6) + 0.0 END AS log_k")
rows("P08_zero", lambda: {"zeroes": fn.zero_like("v_click")}, "v_click - v_click AS zeroes")
rows("P09_mannequin_recode", lambda: {"shift_stress": fn.mannequin_stress("n_events")},
     "CASE WHEN n_events IN (1, 2) THEN 1 WHEN n_events IN (3, 4, 5, 6) THEN 0 ELSE n_events END AS shift_stress")
rows("P10_control_bin", lambda: {"control_cat": fn.control_bin("v_click")},
     "CASE WHEN v_click >= 75 THEN 0 WHEN v_click >= 50 THEN 1 WHEN v_click >= 25 THEN 2 WHEN v_click < 25 THEN 3 ELSE 0 END AS control_cat")
rows("P11_shift_recode", lambda: {"any_shift": fn.any_shift("n_events"), "folded": fn.two_to_one("lab3")},
     "CAST(CASE WHEN n_events IN (1, 2) THEN 1 WHEN n_events = 0 THEN 0 ELSE n_events END AS DOUBLE) AS any_shift, "
     "CAST(CASE WHEN lab3 = 2 THEN 1 ELSE lab3 END AS DOUBLE) AS folded")
rows("P12_sign_code", lambda: {"code": fn.sign_code("lab3")},
     "CAST(CASE WHEN lab3 = 1 THEN 1 WHEN lab3 = 0 THEN -1 ELSE 0 END AS DOUBLE) AS code")
rows("P13_two_sided_label", lambda: {"label": fn.two_sided_label(F.col("k"), 75, 25)},
     "CASE WHEN k >= 75 THEN 1 WHEN k < 25 THEN 0 END AS label")
rows("P14_two_sided_label_reversed", lambda: {"label": fn.two_sided_label(F.col("k"), 75, 25, reverse=True)},
     "CASE WHEN k >= 75 THEN 0 WHEN k < 25 THEN 1 END AS label")
rows("P15_any_of", lambda: {"any_stress": fn.any_of("lab", "lab3", "v_click", "n_events")},
     "CAST(CASE WHEN lab = 1 OR lab3 = 1 OR v_click = 1 OR n_events = 1 THEN 1 "
     "WHEN lab = 0 AND lab3 = 0 AND v_click = 0 AND n_events = 0 THEN 0 END AS DOUBLE) AS any_stress")
rows("P16_composite", lambda: {"total_stress": fn.composite_stress("lab", "lab3", "v_click")},
     r6("lab / 2.0 + lab3 / 2.0 + coalesce(v_click, 0) / 3.0", "total_stress"))
rows("P17_below", lambda: {"bad": fn.below(F.col("v_click"), 50.0)}, "CASE WHEN v_click < 50 THEN 1 ELSE 0 END AS bad")
rows("P18_derived_column", lambda: {"out": fn.derived("k", lambda c: F.when(c % 2 == 0, c / 2).otherwise(3 * c + 1))},
     r6("CASE WHEN k % 2 = 0 THEN k / 2 ELSE 3 * k + 1 END", "out"))
rows("P19_code_label", lambda: {"sex": fn.code_label("n_events", vocab.GENDERS)},
     "['female', 'male', 'non-binary', 'other', 'prefer not to say'][n_events] AS sex")
rows("P20_number_or_zero", lambda: {"x": fn.number_or_zero("s")}, "coalesce(TRY_CAST(s AS DOUBLE), 0) AS x",
     source=lambda spark, sf: fx.table(spark, sf, "events").select(
         "event_id", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("s")),
     keys=("event_id",),
     sql_from="SELECT event_id, {} FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS s FROM events)")


@query("P21_not_null", WP + f"SELECT user_id, {DAY}, v_click, v_view FROM panel WHERE v_click IS NOT NULL AND v_view IS NOT NULL")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v_click", "v_view")
    return tidy(p.dropna(subset=["v_click", "v_view"]))


@query("P22_equality", WP + f"SELECT user_id, {DAY}, v FROM panel WHERE user_id = 7")
def _(spark, sf):
    return tidy(fx.daily_panel(spark, sf).where(F.col("user_id") == 7).select("user_id", "date", "v"))


SHOWN = {"click": "score", "view": "log_hrv", "error": "pss4_score", "purchase": "total", "signup": "sam8"}


@query(
    "P23_display_names",
    "SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{t}' THEN '{vocab.DISPLAY[n][0]}'" for t, n in SHOWN.items())
    + " END AS long_name, CASE event_type "
    + " ".join(f"WHEN '{t}' THEN '{vocab.DISPLAY[n][1]}'" for t, n in SHOWN.items())
    + " END AS short_name FROM events",
)
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", fn.rename_value("event_type", SHOWN).alias("node"))
    return ev.select(
        "event_id",
        fn.rename_value("node", {k: v[0] for k, v in vocab.DISPLAY.items()}).alias("long_name"),
        fn.rename_value("node", {k: v[1] for k, v in vocab.DISPLAY.items()}).alias("short_name"),
    )


@query("P24_gain_loss", f"WITH {fx.PVALS} SELECT user_id, definition, measure, CASE direction WHEN 'Gain' THEN 0 WHEN 'Loss' THEN 1 END AS code FROM pvals")
def _(spark, sf):
    return fx.p_values(spark, sf).select("user_id", "definition", "measure", fn.gain_loss_code("direction").alias("code"))


@query("P25_global_mean_fill", WP + f"SELECT user_id, {DAY}, " + ", ".join(
    r6(f"coalesce({c}, (SELECT avg({c}) FROM panel))", c) for c in ("v_click", "v_view")) + " FROM panel")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v_click", "v_view")
    return tidy(merge.fill_with_global_mean(p, ["v_click", "v_view"]))


@query("P26_feature_sets", WP + f"SELECT user_id, {DAY}, v_click AS score, v AS total FROM panel")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).withColumnsRenamed(
        {"v_click": "score", "v": "total", "lab": "daily_shifts", "lab3": "shift_stress"})
    keep = [c for c in vocab.resolve_features("oura+surveys", "shift_stress") if c in p.columns]
    return tidy(p.select("user_id", "date", *keep))


rows("P27_pair_change", lambda: {"decreasing": fn.is_decreasing(F.col("v_click"), F.col("v_view")),
                                 "difference": F.abs(F.col("v_click") - F.col("v_view"))},
     "CASE WHEN v_view <= v_click THEN 1 WHEN v_view > v_click THEN 0 END AS decreasing, " + r6("abs(v_click - v_view)", "difference"))


@query("P28_threshold_flag", WP + f""", q AS (SELECT *, (rank() OVER (PARTITION BY user_id ORDER BY k) +
    count(*) OVER (PARTITION BY user_id ORDER BY k)) / 2.0 / count(k) OVER (PARTITION BY user_id) AS p FROM panel)
  SELECT user_id, {DAY}, CASE WHEN k >= 60 THEN 1 ELSE 0 END AS by_value, CASE WHEN p >= 0.75 THEN 1 ELSE 0 END AS by_percentile,
    CASE WHEN p <= 0.25 THEN 0.25::DOUBLE WHEN p <= 0.75 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS bin FROM q""")
def _(spark, sf):
    from dayloom.operators.panel import percentile

    p = fx.daily_panel(spark, sf).withColumn("p", percentile("k", entity="user_id"))
    return tidy(p.select("user_id", "date", fn.threshold_flag(F.col("k"), 60).alias("by_value"),
                         fn.threshold_flag(F.col("p"), 0.75).alias("by_percentile"), fn.quartile_bin(F.col("p")).alias("bin")))


@query("P29_projection", WP + f"SELECT user_id, {DAY}, v AS HR, k AS HRV FROM panel")
def _(spark, sf):
    return tidy(fx.daily_panel(spark, sf).select("user_id", "date", F.col("v").alias("HR"), F.col("k").alias("HRV")))


# -------------------------------------------------------------------- joins

SPLIT = """, base AS (SELECT user_id, date, v AS rmssd, k FROM panel WHERE lab = 1),
  p1 AS (SELECT user_id, date, v_click FROM panel WHERE v_click IS NOT NULL),
  p2 AS (SELECT user_id, date, v_view, lab3 FROM panel WHERE lab3 > 0),
  p3 AS (SELECT user_id, date, k AS item FROM panel WHERE v_view IS NOT NULL) """


def _split(spark, sf):
    p = fx.daily_panel(spark, sf)
    return (
        p.where("lab = 1").select("user_id", "date", F.col("v").alias("rmssd"), "k"),
        p.where("v_click is not null").select("user_id", "date", "v_click"),
        p.where("lab3 > 0").select("user_id", "date", "v_view", "lab3"),
        fx.once_dim(spark, sf).select("user_id", "c_acctbal", "c_mktsegment"),
    )


def _survey(spark, sf):
    """Stand-in survey: the i-th item of every score is k + i."""
    items = [(F.col("k") + i).alias(c) for s in vocab.ITEM_SCORES for i, c in enumerate(vocab.items(s), 1)]
    return fx.daily_panel(spark, sf).where("v_view is not null").select("user_id", "date", *items)


def _without_items(df):
    return tidy(df.drop(*[c for s in vocab.ITEM_SCORES for c in vocab.items(s)]))


LOG = "CASE WHEN rmssd = 0 THEN CAST('-inf' AS DOUBLE) WHEN rmssd > 0 THEN round(ln(rmssd) + 1e-9, 6) + 0.0 END AS log_hrv, rmssd - rmssd AS zeroes"


def _scored(merged: str) -> str:
    """SQL twin of ``study_scores`` over a merged table that carries ``item``."""
    sums = ", ".join(r6(" + ".join(f"(item + {i})" for i in range(1, n + 1)), s) for s, (_p, n, _w) in vocab.ITEM_SCORES.items())
    return f"""SELECT * EXCLUDE (item) REPLACE (CAST(date AS VARCHAR) AS date), {LOG}, {sums},
    CASE WHEN user_id IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY md5(CAST(user_id AS VARCHAR)) NULLS LAST, user_id) - 1 END AS p_id FROM {merged}"""


@query("J01_left_chain", f"WITH {PANEL}, {ONCE} {SPLIT}, led AS (SELECT b.user_id, b.date, rmssd, k, c_acctbal, c_mktsegment, v_click, v_view, lab3, item "
       "FROM base b LEFT JOIN once_dim o ON b.user_id = o.user_id LEFT JOIN p1 ON b.user_id = p1.user_id AND b.date = p1.date "
       "LEFT JOIN p2 ON b.user_id = p2.user_id AND b.date = p2.date LEFT JOIN p3 ON b.user_id = p3.user_id AND b.date = p3.date) " + _scored("led"))
def _(spark, sf):
    base, p1, p2, once = _split(spark, sf)
    return _without_items(merge.merge_watch_led(base, once, p1, [p2, _survey(spark, sf)], entity="user_id"))


def _full_join(left: str, right: str, out: str) -> str:
    return f"""{out} AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.date, r.date) AS date, l.* EXCLUDE (user_id, date), r.* EXCLUDE (user_id, date)
    FROM {left} l FULL JOIN {right} r ON l.user_id IS NOT DISTINCT FROM r.user_id AND l.date IS NOT DISTINCT FROM r.date)"""


FULL = """, led AS (SELECT coalesce(b.user_id, o.user_id) AS user_id, b.date, b.rmssd, b.k, o.c_acctbal, o.c_mktsegment
    FROM base b FULL JOIN once_dim o ON b.user_id = o.user_id), """ + _full_join("led", "p1", "f1")


@query("J02_full_chain", f"WITH {PANEL}, {ONCE} {SPLIT} {FULL}, {_full_join('f1', 'p2', 'f2')}, {_full_join('f2', 'p3', 'f3')} {_scored('f3')}")
def _(spark, sf):
    base, p1, p2, once = _split(spark, sf)
    return _without_items(merge.merge_everything(base, once, [p1, p2, _survey(spark, sf)], entity="user_id"))


@query("J03_full_chain_one_left_out", f"WITH {PANEL}, {ONCE} {SPLIT} {FULL}, {_full_join('f1', 'p3', 'f3')} {_scored('f3')}")
def _(spark, sf):
    base, p1, _p2, once = _split(spark, sf)
    return _without_items(merge.merge_everything(base, once, [p1, _survey(spark, sf)], entity="user_id"))


@query("J04_sleep_daily", f"""WITH {PANEL} {SPLIT} SELECT b.user_id, CAST(b.date AS VARCHAR) AS date, rmssd, k, v_click, {LOG}
  FROM base b LEFT JOIN p1 ON b.user_id = p1.user_id AND b.date = p1.date""")
def _(spark, sf):
    base, p1, _p2, _o = _split(spark, sf)
    return tidy(merge.merge_sleep_daily(base, p1, entity="user_id"))


@query("J05_survey_merge", f"""WITH {PANEL} {SPLIT}, d AS (SELECT user_id, date, unnest([1, 2]) AS copy FROM p1)
  SELECT coalesce(a.user_id, d.user_id) AS user_id, CAST(coalesce(a.date, d.date) AS VARCHAR) AS date, a.k, d.copy
  FROM (SELECT user_id, date, k FROM base) a FULL JOIN d ON a.user_id = d.user_id AND a.date = d.date""")
def _(spark, sf):
    base, p1, _p2, _o = _split(spark, sf)
    twice = p1.select("user_id", "date", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return tidy(merge.merge_period_surveys([base.drop("rmssd"), twice], entity="user_id", date="date"))


@query("J06_inner_demographics", f"WITH {PANEL}, {ONCE} SELECT user_id, {DAY}, v, c_mktsegment FROM panel JOIN once_dim USING (user_id)")
def _(spark, sf):
    once = fx.once_dim(spark, sf).select("user_id", "c_mktsegment")
    return tidy(fx.daily_panel(spark, sf).select("user_id", "date", "v").join(once, "user_id"))


@query("J07_left_results", f"WITH {fx.PVALS}, {ONCE} SELECT user_id, definition, measure, {r6('p_val', 'p_val')}, c_mktsegment FROM pvals LEFT JOIN once_dim USING (user_id)")
def _(spark, sf):
    once = fx.once_dim(spark, sf).select("user_id", "c_mktsegment")
    return tidy(fx.p_values(spark, sf).drop("direction").join(once, "user_id", "left"))


@query("J09_semi", WP + f"SELECT user_id, {DAY}, v FROM panel WHERE user_id IN (SELECT user_id FROM panel GROUP BY user_id HAVING count(*) >= 27)")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v")
    long = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 27")
    return tidy(p.join(long, "user_id", "left_semi"))


# ----------------------------------------------------------------- profiles

@query("A01_distinct_gate", WP + """, l AS (UNPIVOT (SELECT user_id, v, v_click, k, CAST(lab AS DOUBLE) AS lab FROM panel) ON v, v_click, k, lab INTO NAME feature VALUE x)
  SELECT user_id, feature, count(DISTINCT x) AS n_values FROM l GROUP BY 1, 2 HAVING count(DISTINCT x) >= 5""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).withColumn("lab", F.col("lab").cast("double"))
    return profile.distinct_gate(p, ["v", "v_click", "k", "lab"], 5, entity="user_id")


@query("A01_active_days_gate", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 27")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("date"))
    return profile.active_entities(ev, 27, entity="user_id", date="date")


@query("A02_half_length", WP + "SELECT user_id, count(*) AS n, count(*) / 2.0::DOUBLE AS half_n FROM panel GROUP BY 1")
def _(spark, sf):
    return tidy(profile.half_lengths(fx.daily_panel(spark, sf), entity="user_id"))


@query("A04_coverage", WP + f""", e AS (SELECT user_id, count(*) AS n, date_diff('day', min(date), max(date)) + 1 AS filled FROM panel GROUP BY 1)
  SELECT count(*) FILTER (WHERE n >= 27) AS n_long, {r6('avg(n)', 'mean_days')}, {r6('stddev_pop(n)', 'std_days')},
    {r6('avg(filled)', 'mean_filled')}, {r6('stddev_pop(filled)', 'std_filled')},
    {r6('avg(n / filled)', 'mean_share')}, {r6('stddev_pop(n / filled)', 'std_share')} FROM e""")
def _(spark, sf):
    return tidy(profile.coverage(fx.daily_panel(spark, sf), 27, entity="user_id", date="date"))


@query("A05_period_completeness", WP + f""", s AS (SELECT event_type AS survey, user_id, CAST(ts AS DATE) AS date FROM events),
  e AS (SELECT survey, user_id, count(*) / (floor(date_diff('day', min(date), max(date)) / 7) + 1) AS share FROM s GROUP BY 1, 2)
  SELECT survey, {r6('avg(share)', 'mean_share')}, {r6('stddev_pop(share)', 'std_share')} FROM e GROUP BY 1""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("survey"), "user_id", F.col("ts").cast("date").alias("date"))
    return tidy(profile.period_completeness(ev, "7D", survey="survey", entity="user_id", date="date"))


@query("A06_once_completeness", """WITH s AS (SELECT 'labels' AS survey, doc_id FROM labels UNION ALL SELECT 'documents', doc_id FROM documents)
  SELECT survey, count(DISTINCT doc_id) * 1.0::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS share FROM s GROUP BY 1""".replace(
    "count(DISTINCT doc_id) * 1.0::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS share",
    "round(count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents), 6) + 0.0 AS share"))
def _(spark, sf):
    s = fx.table(spark, sf, "labels").select(F.lit("labels").alias("survey"), "doc_id").unionByName(
        fx.table(spark, sf, "documents").select(F.lit("documents").alias("survey"), "doc_id"))
    return tidy(profile.once_completeness(s, fx.table(spark, sf, "documents"), survey="survey", entity="doc_id"))


# ------------------------------------------------------------------ samples

@query("T01_first_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return readers.first_per_key(ev, "user_id", ["ts", "event_id"]).drop("ts")


@query("T06_two_samples", WP + f""", r AS (SELECT p.user_id, p.date, b.boot, row_number() OVER (PARTITION BY p.user_id, b.boot ORDER BY md5(concat_ws('|', CAST(p.user_id AS VARCHAR), CAST(p.date AS VARCHAR), CAST(b.boot AS VARCHAR), 's1')), p.date) AS rn
    FROM panel p CROSS JOIN (SELECT CAST(unnest(generate_series(0, 2)) AS INTEGER) AS boot) b)
  SELECT user_id, {DAY}, boot, CASE WHEN rn <= 8 THEN 'a' ELSE 'b' END AS sample FROM r WHERE rn <= 16""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date")
    return tidy(sampling.two_samples(sampling.with_boots(p, 3), 8, entity="user_id", date="date", seed="s1"))


@query("T08_random_entities", WP + f""", ok AS (SELECT user_id FROM panel GROUP BY 1 HAVING count(v_click) >= 10 AND count(v_view) >= 10),
  pick AS (SELECT user_id FROM ok ORDER BY md5(CAST(user_id AS VARCHAR) || '|r'), user_id LIMIT 6)
  SELECT user_id, {DAY}, v_click, v_view FROM panel WHERE user_id IN (SELECT user_id FROM pick)""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", "v_click", "v_view")
    return tidy(sampling.random_entities(p, 6, entity="user_id", seed="r", at_least=10, columns=["v_click", "v_view"]))


@query("T09_boots", WP + f"SELECT user_id, {DAY}, boot FROM panel CROSS JOIN (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS boot)")
def _(spark, sf):
    return tidy(sampling.with_boots(fx.daily_panel(spark, sf).select("user_id", "date"), 5))


@query("T10_time_split", WP + f"SELECT user_id, {DAY}, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY date) <= floor(0.8 * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'test' END AS part FROM panel")
def _(spark, sf):
    return tidy(sampling.time_split(fx.daily_panel(spark, sf).select("user_id", "date"), 0.8, entity="user_id", date="date"))


@query("T11_hash_split", WP + f"SELECT user_id, {DAY}, CASE WHEN CAST('0x' || substr(md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR), '7')), 1, 8) AS BIGINT) / 4294967296.0 < 0.33 THEN 'test' ELSE 'train' END AS part FROM panel")
def _(spark, sf):
    return tidy(sampling.hash_split(fx.daily_panel(spark, sf).select("user_id", "date"), 0.33, keys=["user_id", "date"], seed="7"))


NOISY = ["v", "k", "v_sum", "n_events", "lab"]


@query("T12_noise", WP + f""", u AS (SELECT *, md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR), '0', 'n')) AS h0, md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR), '1', 'n')) AS h1 FROM panel)
  SELECT user_id, {DAY}, {', '.join(f"{r6(sk.noisy(c, i), c)}" for i, c in enumerate(NOISY))} FROM u""")
def _(spark, sf):
    p = fx.daily_panel(spark, sf).select("user_id", "date", *NOISY)
    return tidy(sampling.add_noise(p, NOISY, 0.001, keys=["user_id", "date"], seed="n"))


@query("T13_entity_codes", WP + f"SELECT user_id, {DAY}, dense_rank() OVER (ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) - 1 AS p_id FROM panel")
def _(spark, sf):
    return tidy(dense_codes(fx.daily_panel(spark, sf).select("user_id", "date"), "user_id", "p_id"))
