"""Ranked lexical search by NRA over impact-sorted lists.

A list holds a term's documents by falling impact. Lists are read from the top, a stretch
at a time; a document's score lies between the sum of what was read of it and that sum
plus, for every list it was not met in, the impact that list has come down to. Reading
goes on until no document outside can reach the k-th lower bound and every document that
still can has one value for both bounds: membership, ties and scores are then final.

Documents are scanned once. Each task packs the postings of the asked terms of its
documents into chunks; chunks make shards, in which lists are sorted and read. Statistics
of the whole table come between the two passes. No posting is shuffled; a task returns at
most ``k`` rows for each item, and the best so far bound its later shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dayloom.llm.common import batch_rows, saved

#: Bytes of terms, with A-Z in lower case; all others are spaces.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Postings in a chunk and in a shard, about.
CHUNK, SHARD = 1 << 16, 1 << 20
#: Items that are asked in one scan, told to all tasks.
ITEMS = 4096
#: Postings that a list is read by at first.
STRETCH = 64
#: Texts that a Python worker gets at a time; chunks at a time.
BATCH, CHUNKS = 1024, 16

_CHUNK = "docs long, terms long, id binary, unnamed binary, n binary, pdoc binary, pterm binary, ptf binary"


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


def postings(batches: Iterator[pd.DataFrame], code: dict[bytes, int]) -> Iterator[pd.DataFrame]:
    """Chunks of the documents' postings of the terms in ``code``, with the documents' ids
    and lengths, and the counts of documents and terms of all that were read for them."""
    get, fresh = code.get, lambda: ([], [], [], [])
    (ids, unnamed, lengths, tally), docs, total, n = fresh(), 0, 0, 0

    def chunk():
        sizes = np.fromiter(map(len, tally), np.int64, len(tally))
        flat = [x for t in tally for x in t]
        return pd.DataFrame({
            "docs": [docs], "terms": [total], "id": [np.array(ids, "<i8").tobytes()], "unnamed": [bytes(unnamed)],
            "n": [np.array(lengths, "<i8").tobytes()], "pdoc": [np.repeat(np.arange(len(sizes), dtype="<i4"), sizes).tobytes()],
            "pterm": [np.array(flat, "<i4").tobytes()], "ptf": [np.array([c for t in tally for c in t.values()], "<i4").tobytes()],
        })

    for b in batches:
        for key, null, text in zip(b["_key"].tolist(), b["_null"].tolist(), b["_text"]):
            words = terms(text)
            if not words:
                continue
            docs, total = docs + 1, total + len(words)
            found = Counter(map(get, words))
            found.pop(None, None)
            if found:
                ids.append(key)
                unnamed.append(null)
                lengths.append(len(words))
                tally.append(found)
                n += len(found)
            if n >= CHUNK:
                yield chunk()
                (ids, unnamed, lengths, tally), docs, total, n = fresh(), 0, 0, 0
    if docs:
        yield chunk()


def read_lists(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of all documents that are among the best ``k`` of ``n`` and
    reach ``floor`` (ties with the last one included), and the postings read for them.

    A list is (scores falling, positions), each document once.
    """
    lists = [x for x in lists if len(x[0])]
    lower = np.zeros(n, np.int64)
    met = np.zeros((n, len(lists)), bool)
    at = np.zeros(len(lists), np.int64)
    high = np.array([s[0] for s, _ in lists], np.int64)
    stretch, wanted, closed, read = STRETCH, range(len(lists)), False, 0
    candidates = np.empty(0, np.int64)
    while len(lists):
        for t in wanted:
            score, doc = lists[t]
            stop = min(int(at[t]) + stretch, len(score))
            here = doc[at[t] : stop]
            lower[here] += score[at[t] : stop]
            met[here, t] = True
            read += len(here)
            at[t] = stop
            high[t] = score[stop] if stop < len(score) else 0
        stretch *= 2
        last = int(np.partition(lower, n - k)[n - k]) if n > k else 0
        bar = max(floor, last, 1)
        if not closed:
            if high.sum() >= bar:
                wanted = np.flatnonzero(high)
                continue
            closed = True  # documents not met so far stay out
            candidates = np.flatnonzero(lower)
        open_ = ~met[candidates]
        upper = lower[candidates] + open_ @ high
        alive = upper >= bar
        candidates, open_, upper = candidates[alive], open_[alive], upper[alive]
        loose = upper > lower[candidates]
        if not loose.any():
            break
        wanted = np.flatnonzero(open_[loose].any(axis=0) & (high > 0))
    candidates = candidates[lower[candidates] >= max(floor, 1)] if len(candidates) else candidates
    return candidates, lower[candidates], read


class Shard:
    """Postings of a stretch of documents, by term and falling impact."""

    def __init__(self, chunks: pd.DataFrame, total_docs: int, total_terms: int):
        whole = lambda c, kind: [np.frombuffer(x, kind) for x in chunks[c]]
        ids = whole("id", "<i8")
        self.id, self.unnamed = np.concatenate(ids), np.concatenate(whole("unnamed", bool))
        first = np.cumsum([0, *map(len, ids)])
        doc = np.concatenate([d.astype(np.int64) + f for d, f in zip(whole("pdoc", "<i4"), first)])
        term, tf = np.concatenate(whole("pterm", "<i4")), np.concatenate(whole("ptf", "<i4")).astype(np.int64)
        m = 10 + (90 * np.concatenate(whole("n", "<i8")) * total_docs) // total_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        names, starts = np.unique(term[order], return_index=True)
        self.where = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))

    def lists(self, codes: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        spans = [(weight[c], *self.where[c]) for c in codes.tolist() if c in self.where and weight[c] > 0]
        return [(w * self.impact[a:b], self.doc[a:b]) for w, a, b in spans]


def _best(batches, items: list[np.ndarray], weight: np.ndarray, total_docs: int, total_terms: int, k: int):
    """The best ``k`` of every item over all chunks, as rows."""
    empty = np.empty(0, np.int64)
    kept = [(empty, empty, np.empty(0, bool))] * len(items)

    def take(chunks: pd.DataFrame) -> None:
        shard = Shard(chunks, total_docs, total_terms)
        for i, codes in enumerate(items):
            score, ids, unnamed = kept[i]
            floor = int(score[-1]) if len(score) == k else 1
            at, got, _ = read_lists(shard.lists(codes, weight), len(shard.id), k, floor)
            if len(at):
                score, ids = np.concatenate([score, got]), np.concatenate([ids, shard.id[at]])
                unnamed = np.concatenate([unnamed, shard.unnamed[at]])
                first = np.lexsort((unnamed, ids, -score))[:k]
                kept[i] = score[first], ids[first], unnamed[first]

    waiting, size = [], 0
    for b in batches:
        for i in range(len(b)):
            row = b.iloc[i : i + 1]
            waiting.append(row)
            size += len(row["pdoc"].iloc[0]) // 4
            if size >= SHARD:
                take(pd.concat(waiting))
                waiting, size = [], 0
    if size:
        take(pd.concat(waiting))
    counts = [len(s) for s, _, _ in kept]
    ids = np.concatenate([empty, *(i for _, i, _ in kept)])
    gone = np.concatenate([np.empty(0, bool), *(u for _, _, u in kept)])
    yield pd.DataFrame({
        "_item": np.repeat(np.arange(len(items)), counts), "score": np.concatenate([empty, *(s for s, _, _ in kept)]),
        "doc_id": pd.Series(ids, dtype="Int64").mask(gone),
    })


def _weight(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def _asked(docs: DataFrame, items: pd.DataFrame, k: int) -> DataFrame:
    """Best rows ``(item_id, item_row, rank, doc_id, score)`` of a bounded block of items."""
    spark: SparkSession = docs.sparkSession
    codes: dict[bytes, int] = {}
    asked = [np.array(sorted({codes.setdefault(t, len(codes)) for t in terms(x)}), np.int64) for x in items["_text"]]
    with batch_rows(spark, BATCH):
        chunks = saved(docs.mapInPandas(lambda b: postings(b, codes), _CHUNK), "postings")
    total = chunks.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n, all_terms = total["docs"] or 0, total["terms"] or 0

    def counted(batches):
        for b in batches:
            found = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in b["pterm"]]), return_counts=True)
            yield pd.DataFrame({"term": found[0].astype(np.int64), "df": found[1]})

    with batch_rows(spark, CHUNKS):
        df = chunks.select("pterm").mapInPandas(counted, "term long, df long").groupBy("term").agg(F.sum("df")).toPandas()
        weight = np.zeros(max(1, len(codes)), np.int64)
        for t, x in df.itertuples(index=False):
            weight[t] = _weight(n, int(x))
        best = chunks.mapInPandas(
            lambda b: _best(b, asked, weight, n, all_terms, k), "_item long, score long, doc_id long"
        )
        first = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = saved(best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "best")
    names = [(None if pd.isna(a) else int(a), int(b), i) for i, (a, b) in enumerate(zip(items["item_id"], items["item_row"]))]
    named = spark.createDataFrame(names, "item_id long, item_row int, _item long")
    return named.join(best, "_item").select("item_id", "item_row", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block: int = ITEMS,
) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: ``(item_id, rank, doc_id,
    score, item_row)``; equal scores by rising key.

    Null and empty texts have no terms: as documents they are not counted, as items they
    find nothing. Repeated documents are ranked each, those with a null key after equal
    scores. Items that repeat an id and a text are one; those with another text are asked
    apart and told by ``item_row`` (from 1, by text). Empty tables give no rows. Other
    columns of either table are not read. Items are asked in blocks, one scan each.
    """
    spark = docs.sparkSession
    number = F.col(key).cast("long")
    docs = docs.select(
        F.coalesce(number, F.lit(2**63 - 1)).alias("_key"), number.isNull().alias("_null"), F.col(text).alias("_text")
    )
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("_text")).distinct()
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("_text")).cast("int")
    items = saved(items.withColumn("item_row", rank), "items")
    blocks = max(1, -(-items.count() // block))
    part = F.pmod(F.xxhash64("item_id", "item_row"), F.lit(blocks))
    found = None
    for i in range(blocks):
        here = items.filter(part == i).orderBy("item_id", "item_row").toPandas()
        here = _asked(docs, here, k)
        found = here if found is None else found.union(here)
    return found.select("item_id", "rank", "doc_id", "score", "item_row")


def oracle(k: int = 10) -> str:
    """The same in SQL, document by document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: (
        f"unnest(regexp_extract_all(translate({t}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, {words("text")} AS term FROM docs),
sizes AS (SELECT r, count(*) AS n FROM words GROUP BY 1),
whole AS (SELECT count(*) AS all_docs, sum(n) AS all_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, item_row, {words("text")} AS term FROM
    (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY text) AS item_row
     FROM (SELECT DISTINCT item_id, text FROM benchmark))),
posts AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM posts GROUP BY 1), whole),
impacts AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))) AS s
    FROM posts JOIN weights USING (term) JOIN sizes USING (r), whole),
scores AS (SELECT item_id, item_row, r, sum(s)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, item_row, doc_id, score,
    row_number() OVER (PARTITION BY item_id, item_row ORDER BY score DESC, doc_id) AS rank FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score, item_row::INTEGER AS item_row FROM ranked WHERE rank <= {k}
"""
