"""Exact top-k by inner product with MaxScore over signed postings.

A term is a dimension with a sign; its postings are a shard's vectors whose value has
that sign, with the values. Only postings of the query's own sign can add to a score, by
at most the term's bound. Terms are ordered by bound: those whose bounds together stay
below the k-th best score so far are not essential. The essential terms' postings are
traversed; their vectors are then probed in the other terms, largest bound first, as
long as the sum of bounds left keeps them competitive. Shards are merged by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm import grid

#: Vectors of a shard that are taken at a time, so that the k-th best score rises early.
STRIDE = 2048


class Postings:
    """Signed postings of a stretch of vectors: per dimension the values, and by sign
    the bound and the vectors that have it."""

    def __init__(self, values: np.ndarray):
        self.columns = np.ascontiguousarray(values.T)
        self.most = np.maximum(values.max(axis=0), 0)
        self.least = np.minimum(values.min(axis=0), 0)
        self.n = len(values)
        self.lists: dict[tuple[int, bool], np.ndarray] = {}

    def of(self, dim: int, positive: bool) -> np.ndarray:
        """Mask of the vectors in one posting list."""
        key = (dim, positive)
        if key not in self.lists:
            self.lists[key] = self.columns[dim] > 0 if positive else self.columns[dim] < 0
        return self.lists[key]

    def best(self, query: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all vectors that score ``floor`` or more."""
        bounds = np.where(query > 0, query * self.most, query * self.least)
        order = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[order]) < floor
        split = int(np.count_nonzero(below))  # bounds are not negative: the sums only grow
        essential = order[split:]
        if not len(essential):
            return np.empty(0, np.int64), np.empty(0)
        # a query with no positive bound left scores 0 or less with every vector
        if bounds[essential[-1]] <= 0 or floor == -np.inf:
            seen = np.arange(self.n)
        else:
            mask = np.zeros(self.n, bool)
            for d in essential[::-1]:
                if bounds[d] <= 0:
                    break
                mask |= self.of(d, query[d] > 0)
                if mask.all():
                    break
            if floor <= 0:
                mask[:] = True
            seen = np.flatnonzero(mask)
        score = query[essential] @ self.columns[essential]
        score = score[seen]
        left = bounds[order[:split]].sum()
        for at in range(split, 0, -8):
            alive = score + left >= floor
            if not alive.all():
                seen, score = seen[alive], score[alive]
                if not len(seen):
                    break
            probe = order[max(0, at - 8) : at]
            score = score + query[probe] @ self.columns[np.ix_(probe, seen)]
            left -= bounds[probe].sum()
        alive = score >= floor
        return seen[alive], score[alive]


def tile(qi: np.ndarray, queries: np.ndarray, vi: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
    """Best ``k`` per query of one shard; ``vi`` is sorted, so ties keep the smaller id."""
    # sums of products are whole numbers; doubles hold them exactly below 2 ** 53
    if len(queries[0]) * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) >= 2**53:
        queries, vectors = queries.astype(object), vectors.astype(object)
        return _plain(qi, queries, vi, vectors, k)
    n = len(qi)
    kept = [(np.empty(0, np.int64), np.empty(0))] * n
    floor = np.full(n, -np.inf)
    for start in range(0, len(vi), STRIDE):
        part = Postings(vectors[start : start + STRIDE])
        ids = vi[start : start + STRIDE]
        for i in range(n):
            at, score = part.best(queries[i], floor[i])
            other = ids[at] != qi[i]
            at, score = at[other], score[other]
            if not len(at):
                continue
            at, score = np.concatenate([kept[i][0], at + start]), np.concatenate([kept[i][1], score])
            if len(at) > k:
                first = np.lexsort((at, -score))[:k]
                at, score = at[first], score[first]
            kept[i] = (at, score)
            if len(at) == k:
                floor[i] = score.min()
    counts = [len(a) for a, _ in kept]
    return (
        np.repeat(np.arange(n), counts),
        np.concatenate([a for a, _ in kept]).astype(np.int64),
        np.concatenate([s for _, s in kept]).astype(np.int64),
    )


def _plain(qi, queries, vi, vectors, k):
    """The same with numbers of any size; scores wrap like a 64-bit integer."""
    out = []
    for i, q in enumerate(queries):
        score = [(-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in enumerate(vectors) if vi[j] != qi[i]]
        out += [(i, j, -s) for s, j in sorted(score)[:k]]
    at, to, got = zip(*out) if out else ((), (), ())
    wrapped = [(int(s) + 2**63) % 2**64 - 2**63 for s in got]
    return np.array(at, np.int64), np.array(to, np.int64), np.array(wrapped, np.int64)


def search(
    vectors: DataFrame, queries: Column, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest integer inner products.

    Components become ``floor(scale * x)``. ``queries`` is a condition on ``_id``. A row's
    own id is no candidate; ties go to the smaller id; vectors of another length than the
    query's are no candidates. Nulls and components that are not finite take no part; an
    empty table gives no rows; rows that repeat an id all are candidates.
    """
    whole = F.transform("_vector", lambda x: F.floor(x * scale).cast("double"))
    sound = grid.usable(vectors, key, vector, zero=True).withColumn("_vector", whole)
    return grid.top_of_tiles(sound, queries, tile, k, "_whole", F.col("_whole").desc())
