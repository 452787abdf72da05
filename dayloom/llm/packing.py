"""Shortest-pack-first packing over the length histogram.

Texts become pieces of at most ``limit`` ids. Only the histogram of piece lengths (at
most ``limit`` rows) reaches the driver. There lengths are placed longest first, each
into the pack with most room; packs that hold the same lengths are one pattern with a
count. Pieces find their place by their rank among the pieces of their length: ranks are
counted per hash bucket and summed up, so that no task sees all pieces of a length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import partitions, saved
from dayloom.llm.subwords import word_tokenizer

#: Pieces in a bucket, about.
BUCKET_ROWS = 1 << 16


def cut_texts(
    docs: DataFrame, path: str, end_id: int, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces ``(key, start, length, ids_crc32, doc_tokens)`` of every row.

    A row's ids are the tokenizer's and ``end_id``; pieces are cut every ``limit`` ids.
    A null text is empty (its piece is the end alone); repeated rows are cut each.
    """

    def pieces(batches):
        tokenizer = word_tokenizer(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for k, ids in zip(b[key], tokenizer.encode(b["_text"])):
                ids = memoryview(ids + end)
                total = len(ids) // 4
                for start in range(0, total, limit):
                    part = ids[4 * start : 4 * (start + limit)]
                    rows.append((k, start, len(part) // 4, zlib.crc32(part), total))
            yield pd.DataFrame(rows, columns=[key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(
        pieces, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def place(histogram: dict[int, int], limit: int) -> pd.DataFrame:
    """Slots ``(length, first, n, sequence, offset)``: pieces of that length with ranks
    from ``first`` on, ``n`` of them, lie at ``offset`` of sequences from ``sequence`` on.

    A pattern is a chain of nodes ``(node below, length, times)``, so that splitting the
    count of a pattern copies nothing. All counts are plain numbers: the work depends on
    the lengths that occur, not on how many pieces have them.
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [[node, count]]
    rooms: list[int] = []

    def put(room: int, node: tuple, count: int) -> None:
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append([node, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                fit = limit // length
                for times, count in ((fit, left // fit), (left % fit, 1)):
                    if times and count:
                        put(limit - times * length, (None, length, times), count)
                break
            room = -rooms[0]
            pattern = by_room[room][-1]
            if pattern[1] <= left:
                # every pack of the pattern takes as many as keep it the emptiest, one at least
                by_room[room].pop()
                put(room - length, (pattern[0], length, 1), pattern[1])
                left -= pattern[1]
            else:
                pattern[1] -= left
                put(room - length, (pattern[0], length, 1), left)
                left = 0
    slots, used, sequence = [], defaultdict(int), 0
    for room in sorted(by_room):
        for node, count in by_room[room]:
            chain = []
            while node:
                chain.append(node)
                node = node[0]
            offset = 0
            for _, length, times in reversed(chain):
                for _ in range(times):
                    slots.append((length, used[length], count, sequence, offset))
                    used[length] += count
                    offset += length
            sequence += count
    return pd.DataFrame(slots, columns=["length", "first", "n", "sequence", "offset"], dtype="int64")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    limit: int = 4096,
    key: str = "doc_id",
    text: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every piece of every row with its ``sequence_id`` and ``offset``.

    Pieces of equal length are interchangeable, so ties are settled by key, start and
    checksum; fully equal pieces may swap places. An empty table gives no rows; null keys
    are kept as nulls. The histogram has at most ``limit`` rows and the slots are
    bounded by the patterns of those lengths, not by the rows.
    """
    spark = docs.sparkSession
    pieces = saved(cut_texts(docs, path, end_id, limit, key, text), "pieces")
    buckets = max(partitions(spark), -(-pieces.count() // bucket_rows))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)))
    counts = saved(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    slots = place(histogram, limit)
    codes = slots["length"].to_numpy() << 44 | slots["first"].to_numpy()
    order = np.argsort(codes)
    codes, first, sequence, offset = codes[order], *(slots[c].to_numpy()[order] for c in ("first", "sequence", "offset"))

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = (
        pieces.withColumn("_within", F.row_number().over(within) - 1)
        .join(before, ["length", "_bucket"])
        .select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_within")).alias("_rank"))
    )

    def seated(batches):
        for b in batches:
            rank = b.pop("_rank").to_numpy()
            at = np.searchsorted(codes, b["length"].to_numpy() << 44 | rank, side="right") - 1
            yield b.assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    return ranked.mapInPandas(
        seated,
        f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
