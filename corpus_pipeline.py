"""Training corpus from raw documents: toxic ones go, near-duplicates go, secrets are
masked, and what is left is packed into sequences."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from dayloom.llm import jaccard_join, packing, secret_scan, toxicity
from dayloom.llm.common import saved, table
from dayloom.llm.queries import WORD_BPE


#: Texts that a Python worker gets at a time; the stages' workers live side by side.
BATCH = "1024"


def _small_batches(stage):
    """The stage, in a session that sends texts to Python in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@_small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


@_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return jaccard_join.representatives(docs, n=5, percent=80)


@_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with confirmed secrets masked, and their lengths counted again."""
    return secret_scan.redact(docs)


@_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, WORD_BPE, end_id=2, limit=4096)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: The trained stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
