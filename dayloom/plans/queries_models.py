"""Classification on the daily panel, labels and traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.operators import ccit, classify
from dayloom.plans import fixtures as fx, sqlkit as sk
from dayloom.plans.fixtures import FILLED, ONCE, PANEL
from dayloom.plans.queries_stats import FDR, results
from dayloom.plans.registry import query, r6, r6s, tidy
from dayloom.session import cut_lineage

K = {"entity": "user_id", "date": "date"}
FEATS = ["v", "k", "v_click"]
TARGETS = {
    "stressed": lambda d: F.col("lab"),
    "shifts": lambda d: F.when(F.col("lab3") > 0, 1).when(F.col("lab3") == 0, 0),
    "busy": lambda d: (F.col("n_events") >= 3).cast("int"),
}
TARGETS_SQL = {"stressed": "lab", "shifts": "CASE WHEN lab3 > 0 THEN 1 WHEN lab3 = 0 THEN 0 END", "busy": "CAST(n_events >= 3 AS INTEGER)"}


def _panel(spark, sf):
    return fx.daily_panel(spark, sf).select("user_id", "date", "lab", "lab3", "n_events", *FEATS)


@query("M01_dataset", f"""WITH {FILLED}, lb AS (SELECT *, CAST(CASE WHEN lab3 > 0 THEN 1 WHEN lab3 = 0 THEN 0 END AS DOUBLE) AS target FROM filled),
  {sk.z_score('lb', 'z', FEATS)}, zm AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY user_id) AS m_{c}' for c in FEATS)} FROM z), {sk.interpolate('zm', 'zi', FEATS)},
  d AS (SELECT user_id, date, target, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATS)} FROM zi WHERE target IS NOT NULL)
  SELECT user_id, CAST(date AS VARCHAR) AS date, {r6s(*FEATS)}, target,
    CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY date) <= floor(0.8 * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'test' END AS part FROM d""")
def _(spark, sf):
    return tidy(classify.build_dataset(_panel(spark, sf), FEATS, TARGETS["shifts"], **K))


@query("M02_boosted_trees")
def _(spark, sf):
    data = cut_lineage(classify.build_dataset(_panel(spark, sf), FEATS, TARGETS["shifts"], **K))
    out = classify.fit_predict(data, FEATS)
    return tidy(out.select("user_id", "date", "target", "prediction"))


def _scores_sql(group: str, frm: str) -> str:
    by = f"{group}, " if group else ""
    return f"""WITH n AS (SELECT {by}count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
    count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fneg, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM {frm} {f'GROUP BY {group}' if group else ''})
  SELECT {by}{r6('(tp + tn) / (tp + fp + fneg + tn)', 'accuracy')}, {r6('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r6('coalesce(tp / nullif(tp + fneg, 0), 0)', 'recall')},
    {r6('coalesce(2 * tp / nullif(2 * tp + fp + fneg, 0), 0)', 'f1')}, {r6('(tp / nullif(tp + fneg, 0) + tn / nullif(tn + fp, 0)) / 2', 'roc_auc')} FROM n"""


@query("M03_scores", _scores_sql("", "labels"))
def _(spark, sf):
    return tidy(classify.scores(fx.table(spark, sf, "labels"), "quality", "toxic"))


def _labelled(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    return fx.table(spark, sf, "labels").join(d, "doc_id")


@query("M04_scores_by_group", _scores_sql("source", "labels JOIN documents USING (doc_id)"))
def _(spark, sf):
    return tidy(classify.scores(_labelled(spark, sf), "quality", "toxic", ["source"]))


@query("M05_metric_table", "SELECT * FROM (" + _scores_sql("source", "labels JOIN documents USING (doc_id)") + ") UNPIVOT INCLUDE NULLS (value FOR metric IN (accuracy, precision, recall, f1, roc_auc))")
def _(spark, sf):
    s = classify.scores(_labelled(spark, sf), "quality", "toxic", ["source"])
    return tidy(classify.metric_table(s, ["source"]))


@query("M05_dataset", f"""WITH {FILLED}, {sk.z_score('filled', 'z', FEATS)}, zm AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY user_id) AS m_{c}' for c in FEATS)} FROM z), {sk.interpolate('zm', 'zi', FEATS)},
  d AS ({' UNION ALL '.join(f"SELECT user_id, date, '{name}' AS target_name, CAST({sql} AS DOUBLE) AS target, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATS)} FROM zi" for name, sql in TARGETS_SQL.items())})
  SELECT user_id, CAST(date AS VARCHAR) AS date, target_name, {r6s(*FEATS)}, target,
    CASE WHEN row_number() OVER (PARTITION BY user_id, target_name ORDER BY date) <= floor(0.8 * count(*) OVER (PARTITION BY user_id, target_name)) THEN 'train' ELSE 'test' END AS part
  FROM d WHERE target IS NOT NULL""")
def _(spark, sf):
    return tidy(classify.build_targets(_panel(spark, sf), FEATS, TARGETS, **K))


@query("M05_targets")
def _(spark, sf):
    s = classify.predict_targets(_panel(spark, sf), FEATS, TARGETS, **K)
    return tidy(classify.metric_table(s, ["user_id", "target"]))


@query("M06_trait_dataset", f"""WITH {FDR}, {ONCE}, j AS (SELECT user_id, direction, c_acctbal, CAST(n_regionkey AS DOUBLE) AS region FROM res LEFT JOIN (SELECT * FROM once_dim WHERE c_acctbal > 0) USING (user_id) WHERE definition = 'd0' AND measure = 'click')
  SELECT user_id, {r6('coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM j))', 'c_acctbal')}, {r6('coalesce(region, (SELECT avg(region) FROM j))', 'region')},
    CAST(CASE direction WHEN 'Gain' THEN 0 WHEN 'Loss' THEN 1 END AS DOUBLE) AS target,
    CASE WHEN CAST('0x' || substr(md5(concat_ws('|', CAST(user_id AS VARCHAR), '7')), 1, 8) AS BIGINT) / 4294967296.0 < 0.33 THEN 'test' ELSE 'train' END AS part FROM j""")
def _(spark, sf):
    return tidy(_traits(spark, sf).select("user_id", "c_acctbal", "region", "target", "part"))


def _traits(spark, sf):
    r = results(spark, sf).where("definition = 'd0' and measure = 'click'").select("user_id", "direction")
    once = fx.once_dim(spark, sf).where("c_acctbal > 0").select("user_id", "c_acctbal", F.col("n_regionkey").alias("region"))
    return classify.trait_dataset(r, once, ["c_acctbal", "region"], entity="user_id", seed="7")


@query("M06_trait_prediction")
def _(spark, sf):
    out = classify.fit_predict(_traits(spark, sf), ["c_acctbal", "region"])
    return tidy(classify.scores(out, "target", "prediction").select("accuracy"))


CI_TESTS = [("v", "v_sum", ()), ("v", "k", ("n_events",)), ("v_click", "v_view", ("n_events", "k"))]
ROUNDS, TREES, DEPTH = 30, 32, 5


def _classifier_sql(t: int, x: str, y: str, z: tuple[str, ...]) -> str:
    """Splits, swap, forest and p-value of one test, step by step."""
    cols = [x, y, *z]
    width, n = min(len(z), ccit.CELL_COLUMNS), f"t{t}"
    bits = lambda start: f"CAST('0x' || substr(h, {start}, 8) AS BIGINT)"
    us = [f"u{i}" for i in range(len(cols))]
    scaled = ", ".join(f"round(1 / (1 + exp(-1.702 * coalesce(({c} - m{i}) / nullif(s{i}, 0), 0))), 9) AS u{i}" for i, c in enumerate(cols))
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(cols))
    fine = f"greatest(0, CAST(floor(log2(n / (3.0 * {ccit.BUCKET})) / {max(width, 1)}) AS INTEGER))" if width else "0"
    shift = lambda h: f"([{', '.join(map(str, ccit.shifts(ROUNDS)[:, h]))}])[k + 1]"
    cell = "concat_ws(',', " + ", ".join(f"CAST(CAST(floor(u{2 + h} * 2.0 ** lev + {shift(h)}) AS BIGINT) AS VARCHAR)" for h in range(width)) + ")" if width else "''"
    apart = " + ".join(f"(a.u{i} - d.u{i}) * (a.u{i} - d.u{i})" for i in range(2, len(cols))) or "0.0"
    slots = ", ".join(
        str(i * 2**DEPTH) + "".join(f" + CASE WHEN u{a}{f' + ({sign}) * u{b}' if sign else ''} > {v} THEN {2**d} ELSE 0 END" for d, (a, sign, b, v) in enumerate(tree))
        for i, tree in enumerate(ccit.cuts(len(cols), TREES, DEPTH)))
    s = f"gap * sqrt(greatest(tested / {ROUNDS}, 1)) / 0.5"
    tail = f"{sk.chi2_p(f'({s}) ** 2', '1')} / 2"
    return f"""{n}_d AS (SELECT id, {', '.join(cols)} FROM ci WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}),
  {n}_m AS (SELECT count(*) AS n, {moments} FROM {n}_d),
  {n}_u AS (SELECT id, {scaled}, {fine} AS fine FROM {n}_d, {n}_m),
  {n}_h AS (SELECT *, md5(concat_ws('|', id, CAST(k AS VARCHAR), 'ccit')) AS h FROM {n}_u, (SELECT unnest(range(0, {ROUNDS})) AS k)),
  {n}_r AS MATERIALIZED (SELECT * EXCLUDE (h), {bits(1)} % 3 AS part, {bits(9)} % 3 = 0 AS test, {bits(17)} AS deal FROM {n}_h),
  {n}_l AS (SELECT *, unnest(list_distinct([fine, fine // 2, fine // 4, 0])) AS lev FROM {n}_r WHERE part > 0),
  {n}_c AS (SELECT *, {cell} AS cell FROM {n}_l),
  {n}_f AS (SELECT k, lev, cell, count(*) AS held FROM {n}_c WHERE part = 2 GROUP BY ALL),
  {n}_b AS MATERIALIZED (SELECT c.*, deal % CAST(ceil(held / {ccit.BUCKET}.0) AS BIGINT) AS bucket FROM {n}_c c JOIN {n}_f USING (k, lev, cell)),
  {n}_a AS (SELECT * FROM {n}_b WHERE part = 1 QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY lev DESC) = 1),
  {n}_y AS (SELECT a.k, a.id, arg_min(d.u1, (round({apart}, 12), xor(a.deal, d.deal), d.id)) AS y
    FROM {n}_a a JOIN {n}_b d ON d.part = 2 AND a.k = d.k AND a.lev = d.lev AND a.cell = d.cell AND a.bucket = d.bucket GROUP BY 1, 2),
  {n}_x AS (SELECT k, id, test, 1.0 AS label, {', '.join(us)} FROM {n}_r WHERE part = 0 UNION ALL
    SELECT k, id, test, 0.0, {', '.join('coalesce(y, u1)' if u == 'u1' else u for u in us)} FROM {n}_r LEFT JOIN {n}_y USING (k, id) WHERE part = 1),
  {n}_s AS MATERIALIZED (SELECT k, id, test, label, unnest([{slots}]) AS slot FROM {n}_x),
  {n}_v AS (SELECT k, slot, (sum(label) + 1) / (count(*) + 2) AS v FROM {n}_s WHERE NOT test GROUP BY 1, 2),
  {n}_p AS (SELECT k, id, label, round(sum(coalesce(v, 0.5)) / {TREES}, 9) >= 0.5 AS named FROM {n}_s LEFT JOIN {n}_v USING (k, slot) WHERE test GROUP BY 1, 2, 3),
  {n}_g AS (SELECT k, avg(a) - 0.5 AS gap, sum(n) AS tested FROM (SELECT k, label, avg(CASE WHEN named = (label = 1) THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM {n}_p GROUP BY 1, 2) GROUP BY 1),
  {n} AS (SELECT '{x}' AS x, '{y}' AS y, '{','.join(z)}' AS z, tested, gap, CASE WHEN gap >= 0 THEN {tail} ELSE 1 - {tail} END AS p_val
    FROM (SELECT CAST(sum(tested) AS BIGINT) AS tested, avg(gap) AS gap FROM {n}_g))"""


_CI_SQL = f"""WITH {PANEL}, ci AS (SELECT *, concat_ws('|', CAST(user_id AS VARCHAR), CAST(date AS VARCHAR)) AS id FROM panel),
  {", ".join(_classifier_sql(i, *t) for i, t in enumerate(CI_TESTS))}
  {" UNION ALL ".join(f"SELECT x, y, z, tested, {r6('gap', 'gap')}, {r6('p_val', 'p_val')} FROM t{i}" for i in range(len(CI_TESTS)))}"""


@query("ST22_classifier_test", _CI_SQL)
def _(spark, sf):
    p = fx.daily_panel(spark, sf).withColumn("id", F.concat_ws("|", F.col("user_id").cast("string"), F.col("date").cast("string")))
    p, out = cut_lineage(p), None
    for x, y, z in CI_TESTS:
        r = ccit.classifier_tests(p, x, y, z, row_id="id", rounds=ROUNDS, trees=TREES, depth=DEPTH)
        r = r.select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(",".join(z)).alias("z"), "tested", "gap", "p_val")
        out = r if out is None else out.union(r)
    return tidy(out)
