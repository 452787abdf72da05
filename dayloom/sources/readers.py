"""Scans: Parquet panels, gzip CSV surveys, and the study's derived loaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from dayloom import vocab
from dayloom.functions import scalars as fn


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet file or directory of parts; ``columns`` prunes the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_panel(
    spark: SparkSession, path: str, date_from: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet scan plus a ``date`` key taken from a timestamp, date or string."""
    df = spark.read.parquet(path)
    keep = [c for c in (columns or df.columns) if c != "date"]
    return df.select(*keep, fn.day(date_from).alias("date"))


def read_survey_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Header CSV, plain or gzip, with a declared schema (no inference pass).

    A gzip file cannot be split, so each file is one task; the rows are then
    spread into even partitions before anything heavier runs.
    """
    return spark.read.schema(schema).option("header", True).csv(path).hint("rebalance")


def schedule_column(columns: Sequence[str]) -> str:
    """First column that carries the schedule date; a look at names only."""
    return next(c for c in columns if "scheduledate" in c)


def with_schedule_day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", fn.day(schedule_column(df.columns)))


def daily_scores(df: DataFrame) -> DataFrame:
    """The three columns the daily loader derives."""
    return df.withColumns({
        "covid_shift_any": fn.first_truthy(*[f"daily_covid_shifts___{i}" for i in (1, 2, 3)]),
        "shift_stress": fn.mannequin_stress("sam7"),
        "control_cat": fn.control_bin("daily_control"),
    })


def item_scores(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    return df.withColumns({s: fn.item_sum(vocab.items(s)) for s in scores})


def load_daily(spark: SparkSession, path: str) -> DataFrame:
    return daily_scores(read_panel(spark, path, "date"))


def load_once(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def load_once_complete(spark: SparkSession, path: str) -> DataFrame:
    return item_scores(load_once(spark, path), vocab.ONCE_SCORES)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``: a struct minimum, combined map-side."""
    rest = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def clean_once(df: DataFrame) -> DataFrame:
    """Readable names and the two any-condition flags of the one-off survey."""
    out = df.withColumnsRenamed(vocab.coded_columns())
    hx = [f"hx_{h}" for h in vocab.HISTORY if h != "none"]
    mhx = [f"mhx_{m}" for m in vocab.MENTAL_HISTORY if m not in ("none", "undisclosed")]
    return out.withColumns({"hx_any": fn.first_truthy(*hx), "mhx_any": fn.first_truthy(*mhx)})
