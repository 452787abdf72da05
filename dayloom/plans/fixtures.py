"""Bindings of the operators' inputs to the given tables (see FIXTURES.md).

Each binding exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dayloom.operators.ordered import next_in_order

PANEL_COLS = [
    "n_events", "v", "v_sum", "v_click", "v_error", "v_purchase", "v_signup", "v_view", "k",
    "lab", "lab3",
]
TYPES = ["click", "error", "purchase", "signup", "view"]
FEATURES = ["v", "n_events", "k", "v_click", "v_view"]
NODES = TYPES

# stand-in themes: one node sits in two themes, as in the study
THEMES = {"phys": ["click", "view", "purchase"], "sleep": ["signup"], "mental": ["error", "purchase"]}

# the same for the panel's own columns, under the study's names of themes
STUDY_FEATURES = ["v", "n_events", "k", "v_click", "v_view", "v_error", "v_purchase", "v_signup"]
STUDY_THEMES = {
    "oura": ["v", "v_click", "v_view", "v_error"], "survey": ["n_events", "k", "v_purchase", "v_signup"],
    "phys": ["v", "n_events", "v_click"], "sleep": ["k", "v_view", "v_click"], "mental": ["v_error", "v_purchase", "v_signup", "n_events"],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """events -> one row per user and day; the aggregation combines map-side."""
    ev = table(spark, sf, "events")
    of_type = lambda t: F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6)
    return (
        ev.groupBy("user_id", F.col("ts").cast("date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.round(F.avg("value"), 6).alias("v"),
            F.round(F.sum("value"), 6).alias("v_sum"),
            *[of_type(t).alias(f"v_{t}") for t in TYPES],
            F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("k"),
            F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("lab"),
            F.least(F.count_if(F.col("event_type") == "purchase"), F.lit(2)).cast("int").alias("lab3"),
        )
    )


PANEL = """panel AS (
  SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n_events,
    round(avg(value), 6) AS v, round(sum(value), 6) AS v_sum,
    round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS v_click,
    round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS v_error,
    round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS v_purchase,
    round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS v_signup,
    round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS v_view,
    round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS lab,
    CAST(least(count(*) FILTER (WHERE event_type = 'purchase'), 2) AS INTEGER) AS lab3
  FROM events GROUP BY 1, 2)"""

FILLED = PANEL + """,
spine AS (SELECT user_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM panel GROUP BY user_id),
filled AS (SELECT s.user_id, s.date, p.* EXCLUDE (user_id, date)
  FROM spine s LEFT JOIN panel p ON s.user_id = p.user_id AND s.date = p.date)"""


def once_dim(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment",
        F.col("n_regionkey"), F.col("n_name"),
    )


ONCE = """once_dim AS (
  SELECT c_custkey AS user_id, c_acctbal, c_mktsegment, n_regionkey, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    stepped = next_in_order(
        ev, entity="user_id", block=F.date_trunc("hour", F.col("ts")),
        order=["ts", "event_id"], values=["event_type", "value"],
    )
    return stepped.where(F.col("next_event_type") != F.col("event_type"))


def _with_boot(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Stand-in bootstrap: blocks of ten days, counted from the day of the first event."""
    first = table(spark, sf, "events").agg(F.min(F.to_date("ts")).alias("_first"))
    days = F.datediff(F.to_date("ts"), "_first")
    return df.crossJoin(F.broadcast(first)).withColumn("boot", F.floor(days / 10).cast("int")).drop("_first")


def bootstraps(spark: SparkSession, sf: str) -> int:
    """How many bootstraps the events have."""
    boots = _with_boot(spark, sf, table(spark, sf, "events").select("ts")).where("boot is not null")
    return boots.select(F.count_distinct("boot")).first()[0]


def _edges(spark: SparkSession, sf: str, conditions) -> DataFrame:
    """Stand-in graphs: steps between event types, one direction kept per pair."""
    dom = F.dayofmonth("ts")
    counted = (
        _with_boot(spark, sf, _steps(spark, sf))
        .withColumn("cond", F.explode(F.array(*conditions(dom))))
        .groupBy(
            "user_id",
            "boot",
            "cond",
            F.col("event_type").alias("src"),
            F.col("next_event_type").alias("dst"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("next_value") - F.col("value")), 6).alias("weight"))
    )
    # both directions of a pair meet in one row; nothing is ordered or ranked
    pair = counted.groupBy(
        "user_id", "boot", "cond", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    ).agg(F.max_by(F.struct("src", "dst", "weight"), F.struct("n", "dst")).alias("e"))
    return pair.select("user_id", "boot", "cond", "e.src", "e.dst", "e.weight")


def _by_stress(dom):
    return F.when(dom % 2 == 0, "stress").otherwise("no_stress")


def _by_reference(dom):
    return F.when(F.floor(dom / 2) % 2 == 0, "a").otherwise("b")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, lambda dom: [_by_stress(dom)])


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Stress and reference graphs in one pass over the steps."""
    return _edges(spark, sf, lambda dom: [_by_stress(dom), _by_reference(dom)])


def _edges_sql(name: str, cond: str) -> str:
    return f"""{name}_n AS (
  SELECT user_id, CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS boot, {cond} AS cond,
    event_type AS src, nxt AS dst, count(*) AS n, round(avg(nval - value), 6) AS weight
  FROM steps GROUP BY ALL),
{name} AS (SELECT user_id, boot, cond, src, dst, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, boot, cond, least(src, dst), greatest(src, dst)
    ORDER BY n DESC, dst DESC) AS rn FROM {name}_n) WHERE rn = 1)"""


STEPS = """steps AS (SELECT * FROM (
  SELECT user_id, ts, event_type, value,
    lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt,
    lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nval
  FROM events) WHERE nxt <> event_type)"""
EDGES = STEPS + ",\n" + _edges_sql("edges", "CASE WHEN day(ts) % 2 = 0 THEN 'stress' ELSE 'no_stress' END")
REF_EDGES = _edges_sql("ref_edges", "CASE WHEN floor(day(ts) / 2) % 2 = 0 THEN 'a' ELSE 'b' END")
ALL_EDGES = EDGES + ",\n" + REF_EDGES + ",\nall_edges AS (SELECT * FROM edges UNION ALL SELECT * FROM ref_edges)"


def p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in test results: one p-value per user, event type and region-named definition."""
    ev = table(spark, sf, "events")
    by_user = ev.groupBy("user_id", F.col("event_type").alias("measure")).agg(
        F.round(F.avg("value"), 6).alias("m")
    )
    by_type = ev.groupBy(F.col("event_type").alias("measure")).agg(F.round(F.avg("value"), 6).alias("mm"))
    definitions = F.explode(F.array(*[F.lit(d) for d in ("d0", "d1", "d2", "d3")]))
    key = F.concat_ws("|", F.col("user_id").cast("string"), "measure", "definition")
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return (
        by_user.join(by_type, "measure")
        .withColumn("definition", definitions)
        .select(
            "user_id", "definition", "measure",
            (u * u * u * u).alias("p_val"),
            F.when((F.col("m") < F.col("mm")), "Gain").otherwise("Loss").alias("direction"),
        )
    )


PVALS = """pvals AS (
  SELECT user_id, definition, measure, u * u * u * u AS p_val, direction FROM (
    SELECT a.user_id, d.definition, a.measure, CASE WHEN a.m < b.mm THEN 'Gain' ELSE 'Loss' END AS direction,
      CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(a.user_id AS VARCHAR), a.measure, d.definition)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
    FROM (SELECT user_id, event_type AS measure, round(avg(value), 6) AS m FROM events GROUP BY 1, 2) a
    JOIN (SELECT event_type AS measure, round(avg(value), 6) AS mm FROM events GROUP BY 1) b ON a.measure = b.measure
    CROSS JOIN (SELECT unnest(['d0', 'd1', 'd2', 'd3']) AS definition) d))"""
