"""SimHash near-duplicates by vantage-point trees over Hamming distances.

A node of a tree has a vantage fingerprint and a radius: fingerprints within the radius
go inside, the others outside. By the triangle inequality a link of ``most`` bits crosses
the border only from a band: fingerprints outside by ``most`` bits or less are sent inside
too, as guests that ask there but have their home outside. Guests go on to every branch
that the bounds leave open. The upper levels of the tree deal fingerprints into shards;
each shard grows its own tree below, down to leaves that are compared in full.

Distances of all 64 bits crowd around 32, so that bands hold most of the fingerprints. A
tree therefore measures one quarter of the bits: a link of ``most`` bits leaves a quarter
with ``most // 4`` differing bits or fewer, and is found by that quarter's tree. There are
four trees; ``PARTS`` of 1 is one tree over all bits, with the same result.

Fingerprints within ``most`` bits of a vantage point are linked to it at once, and pairs
that are known to be connected are not compared any more, so a dense group costs little.
A shard returns one link per fingerprint at most; components join the shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.common import batch_rows, saved
from dayloom.llm.components import components
from dayloom.operators.lookup import looked_up

#: Stretches of bits that have trees of their own.
PARTS = 4
#: Fingerprints at home in a shard, about.
SHARD = 1 << 16
#: Fingerprints in the sample that the upper levels are grown from, on average.
SAMPLE = 1 << 15
#: Home fingerprints in a leaf; distances held at a time.
LEAF, HELD = 192, 1 << 21
#: A split must leave less than this share of a node's comparisons.
WORTH = 0.95
#: Rows that a Python worker gets at a time, and hashes whose bits are counted at a time.
BATCH, BITS = 1024, 1 << 15


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, the highest bit first. A bit is set if over half the XXH64 values of
    the ``n``-word shingles, repeats included, have it set. Fewer words are one shingle;
    without words all bits are zero. Words are runs without ASCII white space, A-Z lowered."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= n:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist())])
    octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for at in range(0, len(octets), BITS):
        count += np.unpackbits(octets[at : at + BITS], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(octets)).tobytes()


ALL = np.uint64(2**64 - 1)


def masks(parts: int) -> list[np.uint64]:
    """Bits of each of ``parts`` stretches."""
    at = [64 * i // parts for i in range(parts + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(at, at[1:])]


def distances(values: np.ndarray, vantage: np.uint64, mask: np.uint64 = ALL) -> np.ndarray:
    return np.bitwise_count((values ^ vantage) & mask).astype(np.int64)


def radius(home: np.ndarray, guests: np.ndarray, most: int) -> tuple[int, float]:
    """The radius that leaves the fewest comparisons, given the distances of a node's
    fingerprints to its vantage point, and the share of comparisons left."""
    h = np.cumsum(np.bincount(home, minlength=65))
    g = np.cumsum(np.bincount(guests, minlength=65)) if len(guests) else np.zeros(65, np.int64)
    upto = lambda c, d: c[np.clip(d, 0, 64)] * (d >= 0)
    r = np.arange(65)
    inside, outside = h, h[-1] - h
    left = inside * (upto(h, r + most) + upto(g, r + most)) + outside * (outside + g[-1] - upto(g, r - most))
    at = int(np.argmin(left))
    return at, float(left[at] / max(1, h[-1] * (h[-1] + g[-1])))


def vantage_point(values: np.ndarray, home: np.ndarray, bound: int, mask: np.uint64, tries: int = 4) -> np.uint64:
    """The home fingerprint that parts a stretch of its node best, of a few."""
    stretch = values[home[:: max(1, len(home) // 512)]]
    found = home[np.linspace(0, len(home) - 1, tries).astype(np.int64)]
    none = np.empty(0, np.int64)
    return min((values[v] for v in found), key=lambda v: (radius(distances(stretch, v, mask), none, bound)[1], int(v)))


class Forest:
    """Positions joined so far; every position leads to the least of its component."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                break
            r = s
        self.up[at] = r
        return r

    def link(self, at: np.ndarray) -> None:
        r = np.unique(self.roots(at))
        self.up[r] = r[0]


def compare(values: np.ndarray, home: np.ndarray, others: np.ndarray, forest: Forest, most: int) -> None:
    """Links every home fingerprint to the home ones and others within ``most`` bits."""
    known = forest.roots(np.concatenate([home, others]))
    names, count = np.unique(known, return_counts=True)
    main = names[np.argmax(count)]
    if count.max() * 2 > len(known) and len(home) > 1:
        # pairs within the main component are settled
        in_main, other_main = known[: len(home)] == main, known[len(home) :] == main
        rest = others[~other_main]
        _compared(values, home[~in_main], np.concatenate([home[in_main], others]), forest, most)
        _compared(values, rest, home[in_main], forest, most, among=False)
    else:
        _compared(values, home, others, forest, most)


def _compared(values, home, others, forest, most, among=True):
    if not len(home) or not len(home) + len(others) - 1:
        return
    every = np.concatenate([home, others]) if among else others
    if not len(every):
        return
    seen, step = values[every], max(1, HELD // len(every))
    for at in range(0, len(home), step):
        rows = home[at : at + step]
        first = at if among else 0
        cols = every[first:]
        near = np.bitwise_count(values[rows][:, None] ^ seen[first:][None, :]) <= most
        near &= forest.roots(rows)[:, None] != forest.roots(cols)[None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            forest.link(np.r_[rows[i], cols[near[i]]])


def search(
    values: np.ndarray, home: np.ndarray, guests: np.ndarray, most: int, bound: int | None = None, mask: np.uint64 = ALL
) -> Forest:
    """Components of distinct ``values`` by links within ``most`` bits that have an end in
    ``home``; of links with more than ``bound`` differing bits under ``mask`` some may be
    left to another tree. Home and guests are positions; links between two guests are
    found at their homes."""
    bound = most if bound is None else bound
    forest = Forest(len(values))
    nodes = [(home, guests)]
    while nodes:
        home, guests = nodes.pop()
        every = np.concatenate([home, guests])
        if not len(home) or len(every) < 2:
            continue
        known = forest.roots(every)
        if (known == known[0]).all():
            continue
        if len(home) <= LEAF:
            compare(values, home, guests, forest, most)
            continue
        v = vantage_point(values, home, bound, mask)
        linked = every[distances(values[every], v) <= most]
        if len(linked) > 1:
            forest.link(linked)
        d, dg = distances(values[home], v, mask), distances(values[guests], v, mask)
        r, left = radius(d, dg, bound)
        if left > WORTH:
            for p in home[np.linspace(0, len(home) - 1, 32).astype(np.int64)]:  # a dense group: link it first
                near = every[distances(values[every], values[p]) <= most]
                if len(near) > 1:
                    forest.link(near)
            compare(values, home, guests, forest, most)
            continue
        band = home[(d > r) & (d <= r + bound)]
        nodes.append((home[d <= r], np.concatenate([guests[dg <= r + bound], band])))
        nodes.append((home[d > r], guests[dg > r - bound]))
    return forest


def grow(sample: np.ndarray, weight: float, size: int, bound: int, mask: np.uint64 = ALL) -> list[tuple]:
    """Upper levels of a tree: nodes ``(vantage, radius, inside, outside)`` and shards
    ``(first cell, parts)``, the root first. A sampled fingerprint stands for ``weight``;
    a shard that cannot be parted is dealt into as many parts as keep them below ``size``."""
    tree: list[tuple] = [()]
    todo, cells = [(0, np.arange(len(sample)))], 0
    none = np.empty(0, np.int64)
    while todo:
        at, here = todo.pop()
        if len(here) * weight > size and len(here) > 1:
            v = vantage_point(sample, here, bound, mask, tries=8)
            d = distances(sample[here], v, mask)
            r, left = radius(d, none, bound)
            if left <= WORTH:
                tree[at] = (v, r, len(tree), len(tree) + 1)
                tree += [(), ()]
                todo += [(tree[at][2], here[d <= r]), (tree[at][3], here[d > r])]
                continue
        parts = max(1, round(len(here) * weight / size))
        tree[at] = (cells, parts)
        cells += parts * (parts + 1) // 2
    return tree


def route(tree: list[tuple], values: np.ndarray, bound: int, mask: np.uint64 = ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cell, position, at home)`` of fingerprints in all cells where they are at home or
    guests. A shard of several parts has a cell for each part with itself, where guests
    come too, and one for each two parts, where the later part is the guest."""
    out = []
    todo = [(0, np.arange(len(values)), np.empty(0, np.int64))]
    while todo:
        at, home, guests = todo.pop()
        if not len(home) + len(guests):
            continue
        if len(tree[at]) == 4:
            v, r, inside, outside = tree[at]
            d, dg = distances(values[home], v, mask), distances(values[guests], v, mask)
            band = home[(d > r) & (d <= r + bound)]
            todo.append((inside, home[d <= r], np.concatenate([guests[dg <= r + bound], band])))
            todo.append((outside, home[d > r], guests[dg > r - bound]))
            continue
        cell, parts = tree[at]
        dealt = (values[home] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
        for i in range(parts):
            for j in range(i, parts):
                for rows, own in ((home[dealt == i], True), (home[dealt == j] if j > i else guests, False)):
                    out.append((np.full(len(rows), cell), rows, np.full(len(rows), own)))
                cell += 1
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, bool)))


def links(prints: DataFrame, most: int) -> DataFrame:
    """Links ``(a, b)`` that join all components of the distinct fingerprints ``fp``."""
    n = prints.count()
    share = min(1.0, SAMPLE / max(1, n))
    draw = F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = np.sort(prints.filter(draw).select("fp").toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    bound, bits = most // PARTS, masks(PARTS)
    trees = [grow(sample, 1 / share, SHARD, bound, m) for m in bits]

    def dealt(batches):
        for b in batches:
            values = b["fp"].to_numpy(np.int64)
            for part, (tree, mask) in enumerate(zip(trees, bits)):
                cell, at, own = route(tree, values.view(np.uint64), bound, mask)
                yield pd.DataFrame({"part": part, "cell": cell, "fp": values[at], "own": own})

    def joined(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("fp")
        values, own = g["fp"].to_numpy(np.int64), g["own"].to_numpy(bool)
        up = search(values.view(np.uint64), np.flatnonzero(own), np.flatnonzero(~own), most, bound, bits[key[0]])
        root = up.roots(np.arange(len(values)))
        more = root != np.arange(len(values))
        return pd.DataFrame({"a": values[more], "b": values[root[more]]})

    return (
        prints.select("fp").mapInPandas(dealt, "part int, cell long, fp long, own boolean")
        .groupBy("part", "cell").applyInPandas(joined, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, seed: int = 42, most: int = 4
) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row: 16 hexadecimal digits and the
    smallest key reachable by links of ``most`` differing bits or fewer.

    Null, empty and blank texts have the fingerprint zero and are linked like any other.
    Repeated rows are returned each; rows with a null key get a fingerprint, a null
    component and lend no link. An empty table gives no rows. The result has columns of
    its own, so other columns of ``docs`` may have any name; keys are whole numbers.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def rows(batches):
        for b in batches:
            made = b"".join([fingerprint(t, n, seed) for t in b.column("_text").to_pylist()])
            made = pa.array(np.frombuffer(made, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("_key"), made], ["_key", "fp"])

    with batch_rows(spark, BATCH):
        base = saved(docs.mapInArrow(rows, "_key long, fp long"), "fingerprints")
    prints = saved(base.filter("_key is not null").groupBy("fp").agg(F.min("_key").alias("rep")), "prints")
    labels = components(saved(links(prints, most), "links"))
    linked = prints.join(labels.select(F.col("cid").alias("fp"), "label"), "fp")
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = looked_up(linked, "label", least, "fp").select("fp", "component_id")
    named = prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    rows = looked_up(base, "fp", saved(named, "components"), "_key", "left")
    return rows.select(
        F.col("_key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_key").isNotNull(), F.col("component_id")).alias("component_id"),
    )
