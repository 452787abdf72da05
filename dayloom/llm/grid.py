"""A grid of tiles: blocks of query vectors against shards of all vectors.

Both sides are dealt by a hash of their id into blocks of bounded size, so neither the
queries nor a crowd of equal vectors meets in one task. Every tile is one group of a
cogroup; a tile returns at most k rows for each of its queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.llm.common import saved

#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 8192, 1024


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """``(key, vector, dims)`` of the vectors that take part: no null vector, no null,
    NaN or infinite component, no empty vector, and zero vectors only if ``zero``."""
    v = F.col("_vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False))
    if not zero:
        sound = sound & F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
        .filter(F.col("_id").isNotNull() & sound)
        .withColumn("_dims", F.size("_vector"))
    )


def top_of_tiles(
    vectors: DataFrame,
    queries: Column,
    tile: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple],
    k: int,
    score: str,
    best_first: Column,
    shard_rows: int = SHARD,
    block_rows: int = BLOCK,
) -> DataFrame:
    """Runs ``tile(query ids, query matrix, ids, matrix, k)`` on every pair of a query
    block and a shard of the same dimension, and merges the tiles' best ``k`` per query.

    ``tile`` returns arrays (query position, position, score). Equal ids with several rows
    all take part as candidates; as queries they are asked once per distinct row.
    """
    vectors = saved(vectors, "vectors")
    asked = vectors.filter(queries)
    n, m = vectors.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    left = (
        asked.withColumn("_row", F.row_number().over(Window.partitionBy("_id", "_dims").orderBy("_vector")) - 1)
        .withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    right = vectors.withColumn(
        "_shard", F.pmod(F.xxhash64("_id", F.hash("_vector")), F.lit(shards)).cast("int")
    ).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "_row": [], "vec_id": [], score: []})
        v = v.sort_values("_id", kind="stable")
        qi, vi = q["_id"].to_numpy(), v["_id"].to_numpy()
        at, to, got = tile(qi, np.stack(q["_vector"].to_numpy()), vi, np.stack(v["_vector"].to_numpy()), k)
        return pd.DataFrame({"query_id": qi[at], "_row": q["_row"].to_numpy()[at], "vec_id": vi[to], score: got})

    keys = ["_dims", "_block", "_shard"]
    kind = "long" if score == "_whole" else "double"
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        solve, f"query_id long, _row int, vec_id long, {score} {kind}"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "_row").orderBy(best_first, "vec_id"))
    return (
        best.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col(score).alias("score"))
    )
