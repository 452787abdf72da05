"""Nearest neighbours by a block matrix join on int8 product tiles.

Every vector is a scale times int8 steps plus a remainder whose length is known. One
matrix product per tile gives the distances between the quantised vectors; the two
remainders bound how far the true distances lie from them. A candidate survives unless
its lower bound exceeds the k-th smallest upper bound; survivors' distances are computed
from the original vectors in double precision and merged by one heap per query. Nothing
within the bounds is lost, so the search is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm import grid

#: Vectors of a shard that meet all queries of a block in one product.
STRIDE = 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, scale and length of the remainder of every row."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    steps = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((x - steps * scale[:, None]) ** 2).sum(axis=1))
    return steps, scale, rest


def tile(qi: np.ndarray, queries: np.ndarray, vi: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
    """The ``k`` nearest of one shard for every query of a block."""
    qs, qscale, qrest = quantise(queries)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in qi]  # (-distance, -id, -position)
    floor = np.full(len(qi), np.inf)  # no farther vector is among the nearest
    qs32 = qs.astype(np.float32)  # products of int8 below 2 ** 24 are exact in float32
    exact = queries.shape[1] * 127 * 127 < 2**24
    qsquare = (qscale**2) * (qs.astype(np.int64) ** 2).sum(axis=1)
    for start in range(0, len(vi), STRIDE):
        x = vectors[start : start + STRIDE]
        vs, vscale, vrest = quantise(x)
        dots = (qs32 @ vs.astype(np.float32).T) if exact else qs.astype(np.float64) @ vs.astype(np.float64).T
        vsquare = (vscale**2) * (vs.astype(np.int64) ** 2).sum(axis=1)
        square = qsquare[:, None] + vsquare[None, :] - 2 * dots * qscale[:, None] * vscale[None, :]
        near = np.sqrt(np.maximum(square, 0))
        slack = (qrest[:, None] + vrest[None, :]) * (1 + 1e-9) + 1e-6 * (
            np.sqrt(qsquare)[:, None] + np.sqrt(vsquare)[None, :]
        )  # the last term covers rounding, also that of the root near zero
        own = qi[:, None] == vi[None, start : start + STRIDE]
        upper = near + slack
        upper[own] = np.inf
        if upper.shape[1] > k:
            floor = np.minimum(floor, np.partition(upper, k - 1, axis=1)[:, k - 1])
        at, to = np.nonzero((near - slack <= floor[:, None]) & ~own)
        true = np.sqrt(((queries[at] - x[to]) ** 2).sum(axis=1)) if len(at) <= 1 << 16 else np.concatenate(
            [np.sqrt(((queries[a] - x[t]) ** 2).sum(axis=1)) for a, t in zip(*(np.array_split(y, len(at) >> 16) for y in (at, to)))]
        )
        for i, j, d in zip(at.tolist(), to.tolist(), true.tolist()):
            heap, item = heaps[i], (-d, -int(vi[start + j]), -(start + j))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == k and -heap[0][0] < floor[i]:
                floor[i] = -heap[0][0]
    rows = [(i, -p, -d) for i, heap in enumerate(heaps) for d, _, p in heap]
    at, to, got = zip(*rows) if rows else ((), (), ())
    return np.array(at, np.int64), np.array(to, np.int64), np.array(got, float)


def nearest(
    vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest by Euclidean distance.

    ``queries`` is a condition on ``_id``. A row's own id is no candidate; ties go to the
    smaller id; vectors of another length than the query's are no candidates. Null, zero
    and not finite vectors take no part; an empty table gives no rows; rows that repeat
    an id all are candidates.
    """
    sound = grid.usable(vectors, key, vector, zero=False)
    return grid.top_of_tiles(sound, queries, tile, k, "_distance", F.col("_distance").asc())
