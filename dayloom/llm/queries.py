"""Queries that apply the operators, with production parameters, to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dayloom.llm import (
    byte_pairs, divergence, html_main, impact_lists, jaccard_join, language_model, licence_scan, maxscore, packing,
    quantised, secret_scan, toxicity, vantage,
)
from dayloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary files; a parameter of every operator that reads one.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("op6_byte_pairs")
def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text."""
    return byte_pairs.digest_texts(table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2, limit=4096)


@query("op10_licence_digests", licence_scan.oracle())
def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every whole text and notices on its lines, by canonical digest."""
    return licence_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_maxscore")
def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products of every fiftieth vector among all."""
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0, k=5)


@query("op8_quantised_neighbours")
def op8_quantised_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all."""
    return quantised.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, k=10)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every key-like run of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("row")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 0.8 of their five-word shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=5, percent=80)[0].drop("_row")


@query("op5_attention_scores")
def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the attention model, beside the base counts."""
    docs = table(spark, sf_dir, "documents")
    scores = language_model.score(docs, ~language_model.held_out(), BYTE_BPE)
    return scores.select("doc_id", language_model.held_out().alias("held_out"), *scores.columns[1:])


@query("op11_vantage_points")
def op11_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and components of links of four bits or fewer."""
    return vantage.near_duplicates(table(spark, sf_dir, "documents"), n=4, seed=42, most=4)


@query("op12_impact_lists", impact_lists.oracle(10))
def op12_impact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item, among all."""
    return impact_lists.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op13_source_divergence", divergence.oracle(3, 200))
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from its language's other sources, and its terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, ranks=200)
