"""Sinks: Parquet panels, the device feed ingest and the result store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayloom.sources.readers import read_panel


def write_panel(df: DataFrame, path: str, *, entity: str, date: str = "date") -> None:
    """Overwrite a Parquet panel, rows of an entity and day close together.

    Clustering on both keys keeps row-group statistics tight without sending a
    very long entity to one task.
    """
    df.repartition(F.col(entity), F.col(date)).sortWithinPartitions(entity, date).write.mode(
        "overwrite"
    ).parquet(path)


def ingest_feeds(
    spark: SparkSession, feeds: dict[str, tuple[str, str]], out_dir: str, *, period: str = "day"
) -> dict[str, str]:
    """Rewrite every device feed with a ``date`` column, as a table partitioned by ``period``.

    ``feeds`` maps a name to (input path, column the day is taken from). A run replaces
    the periods (``day``, ``month`` or ``year``) that it brings and leaves all others, so
    it may be repeated, and a feed may come in parts as long as a period is whole. Rows
    without a day keep a null date. The rebalance gives a period few files and still
    splits one that is too large for one task.
    """
    written = {}
    for name, (path, time_col) in feeds.items():
        written[name] = f"{out_dir}/{name}"
        (
            read_panel(spark, path, time_col)
            .withColumn(period, F.to_date(F.date_trunc(period, F.col("date"))))
            .hint("rebalance", period)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(period)
            .parquet(written[name])
        )
    return written


def write_results(df: DataFrame, path: str, params: dict[str, object], partition: Sequence[str] = ()) -> None:
    """Append a run's table to the result store; the run parameters are partitions.

    A rerun with the same parameters replaces its own partitions only.
    """
    named = df.withColumns({k: F.lit(v) for k, v in params.items()})
    (
        named.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*params, *partition)
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str, **params: object) -> DataFrame:
    """Result store scan; parameters prune partitions."""
    df = spark.read.parquet(path)
    for k, v in params.items():
        df = df.where(F.col(k) == F.lit(v))
    return df
