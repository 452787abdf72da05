"""Source divergence audit by Gustavson's row accumulation.

A group (lang, source) is a sparse row of term counts, the index holds the same counts by
term. A group's divergence from all peers is one pass over its terms: each term's index
row is scattered into a dense accumulator with a slot per peer, and only the accumulator
leaves the task. Terms that both lack, or that one lacks, never meet in the index; their
share is the baseline. With f(p, q) = (p - q)^2 div q and p0 for a count of zero,

    sum f(p, q) = V f(p0, q0) + sum over the group's terms of f(p, q0) - f(p0, q0)
                + sum over the peer's terms of f(p0, q) - f(p0, q0)
                + sum over shared terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first three parts need only how often each p occurs in a group; the last is what the
accumulators gather, block of terms by block of terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import batch_rows, saved
from dayloom.operators.lookup import looked_up

#: Bytes of terms, with A-Z in lower case; all others are spaces.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Counts that a task holds before it hands them on; rows in an Arrow batch.
HELD, ROWS = 700_000, 1 << 16
#: Index rows in a block of terms, at least and at most; as many as a language has pairs
#: between, so that accumulators are never more than the index.
BLOCK = (1 << 16, 1 << 21)
#: Groups that one task accumulates; terms scattered at a time.
STRIPE, SCATTER = 256, 1 << 20
#: Groups up to which they are told to all tasks.
TOLD = 1 << 16
#: Texts that a Python worker gets at a time.
BATCH = 1024
#: Scale of the shares.
SCALE = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


def _counted(batches):
    """Occurrences and documents of every term by group, handed on when too many are held."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (tf, df) in groups.items():
            words = list(tf)
            for at in range(0, len(words), ROWS):
                part = words[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([tf[w] for w in part], pa.int64()), pa.array([df[w] for w in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "tf", "df"],
                )

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "_text"))):
            words = terms(text)
            if not words:
                continue
            tf, df = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(tf)
            tf.update(words)
            df.update(set(words))
            held += len(tf)
            if held >= HELD:
                yield from out()
                groups.clear()
                held = 0
    yield from out()


def chi(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(p - q)^2 div q; shares are at most 10^9 + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


def scatter(g: pd.DataFrame, stripe: int, peers: int) -> pd.DataFrame:
    """Shared part of every (group of the stripe, peer) over a block of terms.

    ``g`` is the block's index: rows ``term, code, p, p0``, ``code`` numbering the groups.
    """
    term, _ = pd.factorize(g["term"])
    order = np.argsort(term, kind="stable")
    term = term[order]
    code, p, p0 = (g[c].to_numpy(np.int64)[order] for c in ("code", "p", "p0"))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    first = np.repeat(starts, np.diff(np.r_[starts, len(term)]))  # of each row's term
    size = np.repeat(np.diff(np.r_[starts, len(term)]), np.diff(np.r_[starts, len(term)]))
    rows = np.argsort(code, kind="stable")
    rows = rows[code[rows] // STRIPE == stripe]
    out = []
    for own in np.split(rows, np.flatnonzero(np.diff(code[rows])) + 1) if len(rows) else []:
        acc, met = np.zeros(peers, np.int64), np.zeros(peers, bool)
        begin = 0
        upto = np.cumsum(size[own])
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SCATTER, side="right")))
            mine = own[begin:end]
            n = size[mine]
            at = np.repeat(first[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pg, pg0, ph, ph0 = np.repeat(p[mine], n), p0[own[0]], p[at], p0[at]
            np.add.at(acc, code[at], chi(pg, ph) - chi(pg, ph0) - chi(pg0, ph) + chi(pg0, ph0))
            met[code[at]] = True
            begin = end
        met[code[own[0]]] = False
        peer = np.flatnonzero(met)
        out.append(pd.DataFrame({"code": code[own[0]], "peer": peer, "value": acc[peer]}))
    return pd.concat(out) if out else pd.DataFrame({"code": [], "peer": [], "value": []}, dtype=np.int64)


def baseline(hist: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """The parts of a group's divergence, and of its peers' from it, that need only how
    often each share occurs in the group. The group's own V f(p0, q0) is among them."""
    out = []
    p, n = (hist[c].to_numpy(np.int64) for c in ("p", "n"))
    for code, peer, p0, q0, v in peers[["code", "peer", "p0", "q0", "v"]].itertuples(index=False):
        none, back = int(chi(np.int64(p0), np.int64(q0))), int(chi(np.int64(q0), np.int64(p0)))
        out.append((code, peer, v * none + sum((n * (chi(p, np.int64(q0)) - none)).tolist())))
        out.append((peer, code, sum((n * (chi(np.int64(q0), p) - back)).tolist())))
    return pd.DataFrame(out, columns=["code", "peer", "value"], dtype="int64")


def _share(count: str, total: str, v: str = "v"):
    """1 + 10^9 (count + 1) div (total + v), in decimals; 1 where there is no term."""
    return F.expr(f"CASE WHEN {v} = 0 THEN 1L ELSE 1 + (CAST({SCALE} AS DECIMAL(12,0)) * ({count} + 1)) div ({total} + {v}) END")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, ranks: int = 200
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for every source of a language its
    divergence from every other one (``pair``), and the kept terms that it uses more than
    the language does (``term``, the highest ``ranks``).

    Null languages, sources and texts are empty strings; a group without terms still has
    its pairs, a language without kept terms has pairs of value 0 and no terms. Repeated
    rows count each. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("_text"))
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, tf long, df long")
    # one exchange by term serves both aggregations: they read the same columns
    counted = counted.repartition("lang", "term")
    kept = counted.groupBy("lang", "term").agg(
        F.sum("df").alias("_df"), F.sum("tf").alias("whole"), F.min("source").alias("_least")
    )
    kept = kept.filter(F.col("_df") >= least).hint("shuffle_hash")
    counts = (
        counted.join(kept, ["lang", "term"])
        .groupBy("lang", "term", "source", "whole", (F.col("source") == F.col("_least")).alias("first"))
        .agg(F.sum("tf").alias("count"), F.sum("df").alias("docs"))
        .filter("docs > 0")
    )
    with batch_rows(spark, BATCH):
        counts = saved(counts, "term-counts")

    langs = counts.filter("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = (
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", zero("n"), zero("v"), zero("lang_n"), zero("rows"))
        .withColumn("code", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("peers", F.count("*").over(Window.partitionBy("lang")))
        .withColumn("rows", F.sum("rows").over(Window.partitionBy("lang")))
        .withColumn("p0", _share("0", "n"))
    )
    groups = saved(groups, "groups")
    size = F.least(F.greatest(F.col("peers") * F.col("peers"), F.lit(BLOCK[0])), F.lit(BLOCK[1]))
    told = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("int"))
    told = told.select(F.struct("lang", "source").alias("_group"), "n", "v", "lang_n", "code", "peers", "blocks", "p0")
    rows = counts.withColumn("_group", F.struct("lang", "source"))
    few = groups.count() <= TOLD
    rows = rows.join(F.broadcast(told), "_group") if few else looked_up(rows, "_group", told, "term")
    rows = rows.select(
        "lang", "source", "term", "code", "peers", "blocks", "p0",
        _share("count", "n").alias("p"), _share("whole", "lang_n").alias("q"),
    )
    rows = saved(rows, "index")

    stripes = F.sequence(F.lit(0), F.ceil(F.col("peers") / STRIPE).cast("int") - 1)
    index = rows.select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.explode(stripes).alias("stripe"),
        "term", "code", "peers", "p0", "p",
    )

    def shared(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return scatter(g, key[2], int(g["peers"].iloc[0])).assign(lang=key[0])[["lang", "code", "peer", "value"]]

    pair = "lang string, code long, peer long, value long"
    shared = index.groupBy("lang", "block", "stripe").applyInPandas(shared, pair)
    hist = rows.groupBy("lang", "code", "p").agg(F.count("*").alias("n"))
    one = groups.select("lang", F.col("code").cast("long").alias("code"), "p0", "v")
    other = one.select("lang", F.col("code").alias("peer"), F.col("p0").alias("q0"))
    peers = one.join(other, "lang").filter("code != peer")  # as many rows as the result has

    def based(key: tuple, h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        return baseline(h, o).assign(lang=key[0])[["lang", "code", "peer", "value"]]

    base = hist.groupBy("lang", "code").cogroup(peers.groupBy("lang", "code")).applyInPandas(based, pair)
    sums = shared.union(base).groupBy("lang", "code", "peer").agg(F.sum("value").alias("value"))
    name = lambda c, s: groups.select("lang", F.col("code").cast("long").alias(c), F.col("source").alias(s))
    pairs = sums.join(name("code", "source"), ["lang", "code"]).join(name("peer", "item"), ["lang", "peer"])
    above = rows.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    above = ranked(named(above.withColumnRenamed("term", "item"), "term")).filter(F.col("rank") <= ranks)
    return ranked(named(pairs, "pair")).union(above)


def oracle(least: int = 3, ranks: int = 200) -> str:
    """The same in SQL, pair by pair over all kept terms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least}),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
vs AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY 1, 2),
wholes AS (SELECT lang, sum(c)::HUGEINT AS n FROM counts GROUP BY 1),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(t.n, 0) + vs.v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN totals t USING (lang, source)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lang_counts AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY 1, 2),
lang_shares AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (c + 1)) // (n + v) AS q
    FROM lang_counts JOIN wholes USING (lang) JOIN vs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
all_terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
    FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM all_terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {ranks}
"""
