"""Tables in, tables between stages, and helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from dayloom.session import scratch_table, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back, so that
    lost executors never cost more than the stage after it."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs run inside send at most ``n`` rows at a time to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word; hashing again is cheaper than looking words up."""
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), np.uint64)


__all__ = ["batch_rows", "partitions", "saved", "scratch_table", "shared_folder", "table", "word_hashes"]
