"""Predicting labels from prepared panels with boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.functions import scalars as fn
from dayloom.operators import merge, panel, sampling
from dayloom.session import cut_lineage

#: Bins of a feature, and training rows up to which the trees find them themselves from all
#: rows (from a sample of as many beyond that).
BINS, PLAIN = 32, 10_000
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def build_targets(
    df: DataFrame, features: Sequence[str], targets: dict[str, Callable[[DataFrame], Column]], *,
    entity: str, date: str, train_share: float = 0.8,
) -> DataFrame:
    """One prepared panel for all targets, stacked by ``target_name``.

    Features are prepared once; targets are read from unscaled values, ride along as one
    array and are exploded last, so no target costs a scan or a shuffle of its own. Early
    days of an entity and target are for training.
    """
    out = panel.fill_days(df, entity=entity, date=date)
    named = [
        F.struct(F.lit(name).alias("target_name"), target(out).cast("double").alias("target"))
        for name, target in targets.items()
    ]
    out = out.withColumn("_targets", F.array(*named))
    out = panel.z_score(out, features, entity=entity)
    out = panel.entity_means(out, features, entity=entity)
    out = panel.interpolate(out, features, entity=entity, date=date)
    out = panel.fill_with_mean(out, features, entity=entity, means_attached=True)
    stacked = out.select(entity, date, *features, F.inline("_targets")).where("target is not null")
    return sampling.time_split(stacked, train_share, entity=entity, date=date, within=["target_name"])


def build_dataset(
    df: DataFrame, features: Sequence[str], target: Callable[[DataFrame], Column], **panel_options
) -> DataFrame:
    """Prepared features, target read from unscaled values, early days for training."""
    return build_targets(df, features, {"target": target}, **panel_options).drop("target_name")


def fit_predict(
    data: DataFrame, features: Sequence[str], *, target: str = "target", trees: int = 100,
    depth: int = 5, rate: float = 0.3, seed: int = 7,
) -> DataFrame:
    """Train on ``part = 'train'`` and return the test rows with ``prediction``.

    No row is left out: a missing feature is 0 with a flag of its own beside it. Trees see a
    feature only as one of ``BINS`` bins. With more than ``PLAIN`` training rows the bins are
    made first, and rows that are equal in them are one row with a weight, so that a tree's
    passes grow with the bins that occur, not with the table.
    """
    gap = lambda f: F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    known = {f"_known_{f}": F.when(gap(f), 0.0).otherwise(F.col(f).cast("double")) for f in features}
    gaps = {f"_gap_{f}": gap(f).cast("double") for f in features}
    columns = [*known, *gaps]
    rows = data.withColumns({**known, **gaps})
    train, test = (rows.where(F.col("part") == part) for part in ("train", "test"))
    weight = {}
    if train.count() > PLAIN:
        binned = _binned(train, list(known))
        train = binned(train).groupBy(*columns, target).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        train, test, weight = cut_lineage(train), binned(test), {"weightCol": "_n"}
    assembled = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="error").transform
    model = GBTClassifier(
        featuresCol="_x", labelCol=target, predictionCol="prediction", maxIter=trees, maxDepth=depth,
        stepSize=rate, seed=seed, maxBins=BINS, **weight,
    ).fit(assembled(train).select("_x", target, *weight.values()))
    return model.transform(assembled(test).drop(*columns)).drop("_x", "rawPrediction", "probability")


def _binned(train: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Replaces each column by the number of its bin among quantiles of the training rows."""
    shares = [i / BINS for i in range(1, BINS)]
    found = train.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()
    edges = {c: sorted(set(found[c])) for c in columns}

    def bins(rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            c: sum(((F.col(c) > e).cast("double") for e in edges[c]), F.lit(0.0)) for c in columns
        })

    return bins


def scores(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of hard predictions, overall or per group.

    Empty ratios count as 0; AUC is null when only one class occurs.
    """
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    n = df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fnn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    true_rate, false_rate = tp / F.nullif(tp + fnn, F.lit(0)), tn / F.nullif(tn + fp, F.lit(0))
    return n.select(
        *keys,
        ratio(tp + tn, tp + fp + fnn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fnn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fnn).alias("f1"),
        ((true_rate + false_rate) / 2).alias("roc_auc"),
    )


def metric_table(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per group and metric."""
    return scored.unpivot(list(keys), METRICS, "metric", "value")


def predict_targets(
    df: DataFrame, features: Sequence[str], targets: dict[str, Callable[[DataFrame], Column]], *,
    entity: str, date: str, **model,
) -> DataFrame:
    """One model per target, scored per entity; the stacked panel is built once for all.

    Boosting is a long row of short jobs, so the targets' models are fitted side by side.
    """
    data = cut_lineage(build_targets(df, features, targets, entity=entity, date=date))
    fit = inheritable_thread_target(df.sparkSession)(
        lambda name: fit_predict(data.where(F.col("target_name") == name), features, **model)
    )
    with ThreadPoolExecutor(len(targets)) as pool:
        tested = list(pool.map(fit, targets))
    scored = scores(reduce(DataFrame.unionByName, tested), "target", "prediction", [entity, "target_name"])
    return scored.withColumnRenamed("target_name", "target")


def trait_dataset(
    results: DataFrame, traits: DataFrame, features: Sequence[str], *, entity: str, seed: str
) -> DataFrame:
    """Gain or loss of each entity with its traits, gaps set to the overall mean, split by hash."""
    joined = results.join(traits, entity, "left")
    joined = joined.withColumns({f: F.col(f).cast("double") for f in features})
    filled = merge.fill_with_global_mean(joined, features)
    coded = filled.withColumn("target", fn.gain_loss_code("direction").cast("double"))
    return sampling.hash_split(coded, 0.33, keys=[entity], seed=seed)
