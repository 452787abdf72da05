"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

Two sets with Jaccard similarity s share one of their first ``n - ceil(s n) + 1`` elements
in any common order. The order used is by hash, with shared passages (the most frequent
elements, a bounded list) last. All sets with the same early element form a tile; inside
a tile only sets of compatible size are paired. A pair's signatures hold one parity bit
per hash slot: each differing element flips one bit, so the count of unequal bits bounds
the symmetric difference from below and the overlap from above. Pairs that pass are
decided by intersecting the sorted arrays of hashes.

Rows with equal sets are one class from the start. A tile of many sets is not paired in
full: its sets meet pivots, links make components, and only pairs between different
components of a tile are compared afterwards. No link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dayloom.llm.common import batch_rows, partitions, saved, word_hashes
from dayloom.operators.lookup import looked_up

#: Elements in more sets than this count as shared; so many of them are told to all tasks.
SHARED, MOST_SHARED = 64, 1 << 20
#: Tiles up to this size are paired in full.
SMALL = 64
#: Members of a tile that one task takes; larger tiles are dealt out.
CHUNK = 1 << 16
#: Early elements that one group of tiles holds, about; rows compared at a time.
GROUP_KEYS, STRETCH = 400_000, 2048
#: Rows that a Python worker gets at a time: texts or sets, a few KB each.
BATCH = 1024

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64
)




def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles; the whole sequence if it is
    shorter; empty without words. Words are runs without ASCII white space, A-Z lowered."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < n:
        return mixed((mixed(h + np.uint64(len(h))) * np.arange(1, 2 * len(h), 2, dtype=np.uint64)).sum(keepdims=True))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        place = _PLACES[i % len(_PLACES)] + np.uint64(2 * (i // len(_PLACES)))
        total += h[i : len(h) - n + 1 + i] * place
    total = mixed(total)
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def class_id(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Parity of the elements in each slot; as many slots as the power of two from twice
    the elements on."""
    bits = max(64, 1 << int(2 * max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    """A signature of fewer slots from one of more: slots that fall together add up."""
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def most_overlap(na: int, a: bytes, nb: int, b: bytes) -> int:
    """Upper bound of the intersection of two sets of these sizes and signatures."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return (na + nb - int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())) // 2


def linked(inter: int, na: int, nb: int, percent: int) -> bool:
    return 100 * inter >= percent * (na + nb - inter)


def early(s: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of which a linked set holds at least one."""
    n = len(s)
    count = n - (percent * n + 99) // 100 + 1
    if len(shared):
        at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
        is_shared = shared[at] == s
        if is_shared[:count].any():
            s = np.concatenate([s[~is_shared], s[is_shared]])
    return s[:count]


def _base(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row its class, size and signature, and its early elements by hash alone."""
    none = np.empty(0, np.uint64)

    def rows(batches):
        for b in batches:
            out = []
            for t in b["_text"]:
                s = shingles(t, n)
                out.append((len(s), class_id(s), signature(s), early(s, none, percent).tobytes() if len(s) else b""))
            out = pd.DataFrame(out, columns=["n", "cid", "sig", "low"])
            yield out.assign(_key=b["_key"].to_numpy(), _row=b["_row"].to_numpy())

    docs = docs.withColumn("_row", F.xxhash64("_text"))
    return docs.mapInPandas(rows, "_key long, _row long, n long, cid long, sig binary, low binary")


def _frequent(base: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent early elements and their counts, at most ``MOST_SHARED``."""

    def dealt(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b["low"]), np.uint64)
            yield _blobs(keys % np.uint64(groups), {"keys": keys})

    def counted(g: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.frombuffer(b"".join(g["keys"]), np.uint64), return_counts=True)
        often = n > SHARED
        return pd.DataFrame({"key": keys[often].astype(np.int64), "n": n[often]})

    found = (
        base.select("low").mapInPandas(dealt, "part long, keys binary")
        .groupBy("part").applyInPandas(counted, "key long, n long")
        .orderBy(F.col("n").desc(), "key").limit(MOST_SHARED).toPandas()
    )
    keys = found["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order]


def _blobs(part: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per part with the part's values of every column as binary."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(part)].astype(np.int64) if len(part) else starts
    out = {"part": part[starts].astype(np.int64)}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(starts, ends)]
    return pd.DataFrame(out)


def _tiles(docs: DataFrame, n: int, percent: int, groups: int, shared: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Candidate pairs ``(a, b)`` of small tiles, with tile 0; of large ones the pairs with
    pivots, and their members ``(a, a, tile, pivot)``."""
    chunks = -(-counts // CHUNK)

    def dealt(batches):
        for b in batches:
            for start in range(0, len(b), 1024):
                yield keyed(b["_text"].iloc[start : start + 1024])

    def keyed(texts) -> pd.DataFrame:
        keys, cids, sizes, seen = [], [], [], set()
        for t in texts:
            s = shingles(t, n)
            if not len(s) or (c := class_id(s)) in seen:
                continue
            seen.add(c)
            e = early(s, shared, percent)
            keys.append(e)
            cids.append(np.full(len(e), c, np.int64))
            sizes.append(np.full(len(e), len(s), np.uint32))
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        cid = np.concatenate(cids) if cids else np.empty(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.empty(0, np.uint32)
        part = (key % np.uint64(groups)).astype(np.int64)
        if len(shared) and chunks.max() > 1:
            at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            many = np.where(shared[at] == key, chunks[at], 1)
            salt = mixed(cid.astype(np.uint64)) % many.astype(np.uint64)
            # tiles that are dealt out have groups of their own, below zero
            part = np.where(many > 1, -1 - (mixed(key + salt) % np.uint64(groups)).astype(np.int64), part)
        return _blobs(part, {"keys": key, "cids": cid, "sizes": size})

    def paired(g: pd.DataFrame) -> pd.DataFrame:
        dealt_out = bool(g["part"].iloc[0] < 0)
        key = np.frombuffer(b"".join(g["keys"]), np.uint64)
        cid = np.frombuffer(b"".join(g["cids"]), np.int64)
        size = np.frombuffer(b"".join(g["sizes"]), np.uint32).astype(np.int64)
        order = np.lexsort((cid, size, key))
        key, cid, size = key[order], cid[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (cid[1:] != cid[:-1]) | (size[1:] != size[:-1])]
        key, cid, size = key[new], cid[new], size[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        several = ends - starts > (0 if dealt_out else 1)
        pairs, members = [], []
        for a, b in zip(starts[several], ends[several]):
            s, c = size[a:b], cid[a:b]
            upto = np.searchsorted(s, 100 * s // percent, side="right")
            if b - a <= SMALL and not dealt_out:
                left, right = np.triu_indices(b - a, 1)
                near = right < upto[left]
                pairs.append(np.stack([c[left[near]], c[right[near]]], 1))
                continue
            pivots, i = [], 0
            while i < b - a:  # a pivot for every tenth more in size
                j = int(np.searchsorted(s, 11 * s[i] // 10, side="right"))
                pivots.append(i)
                pairs.append(np.stack([np.full(j - i - 1, c[i]), c[i + 1 : j]], 1))
                if j < b - a:
                    pairs.append(np.array([[c[i], c[j]]]))
                i = j
            rows = np.zeros((b - a, 4), np.int64)
            rows[:, 0] = rows[:, 1] = c
            rows[:, 2] = key[a].astype(np.int64)
            rows[pivots, 3] = 1
            members.append(rows)
        p = np.sort(np.concatenate([*pairs, np.empty((0, 2), np.int64)]), axis=1)
        p = p[p[:, 0] != p[:, 1]]
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        p = p[np.r_[True, (p[1:] != p[:-1]).any(axis=1)]] if len(p) else p
        rows = np.concatenate([np.pad(p, ((0, 0), (0, 2))), *members])
        return pd.DataFrame(rows, columns=["a", "b", "tile", "pivot"])

    return (
        docs.mapInPandas(dealt, "part long, keys binary, cids binary, sizes binary")
        .groupBy("part").applyInPandas(paired, "a long, b long, tile long, pivot long")
    )


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and signatures allow a link."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def bound(batches):
        for p in batches:
            keep = [
                linked(min(most_overlap(na, x, nb, y), na, nb), na, nb, percent)
                for na, x, nb, y in zip(p["na"], p["siga"], p["nb"], p["sigb"])
            ]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(bound, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``(cid, set)`` of the classes in ``ids``, made again from their rows only."""
    asked = saved(ids.distinct().join(classes, "cid").select("cid", F.col("rep").alias("_key")), "asked")

    def sets(batches):
        for b in batches:
            made = [shingles(t, n) for t in b["_text"]]
            yield pd.DataFrame({"cid": [class_id(s) for s in made], "set": [s.tobytes() for s in made]})

    wanted = docs.join(asked.select("_key").distinct(), "_key").mapInPandas(sets, "cid long, set binary")
    # repeated keys may bring other rows: only the asked sets stay, once each
    return saved(wanted.join(asked.select("cid"), "cid").dropDuplicates(["cid"]), "sets")


def overlap(a: bytes, b: bytes) -> int:
    """Size of the exact intersection of two sorted arrays."""
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs that are linked, by exact intersection."""
    wanted = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), docs, classes, n)
    side = lambda x: wanted.select(F.col("cid").alias(x), F.col("set").alias(f"set{x}"))

    def exact(batches):
        for p in batches:
            keep = [linked(overlap(x, y), len(x) // 8, len(y) // 8, percent) for x, y in zip(p["seta"], p["setb"])]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(exact, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(cid, label)``: smallest id reachable, for every id that has a link.

    Labels take the least among neighbours, then the label of their label, until none
    changes; every round is a written table, and nothing but a count meets the driver.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("cid")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["cid"]).groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cid").select("cid", F.least("label", "near").alias("now"), "label")
        hop = step.select(F.col("cid").alias("now"), F.col("now").alias("far"))
        new = saved(
            step.join(hop, "now").select("cid", F.least("now", "far").alias("label"), F.col("label").alias("old")), "labels"
        )
        labels = new.select("cid", "label")
        if new.filter("label < old").isEmpty():
            return labels


def _between(
    members: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int
) -> DataFrame:
    """Links between different components of a large tile, as many as join them.

    Tiles with the same largest component are laid together, so that a pair which shares
    many early elements is compared once. The sets outside that component meet all sets
    of the tiles, in stretches, within the band of sizes that allows a link.
    """
    known = (
        members.join(labels, members["a"] == labels["cid"], "left")
        .select("tile", "a", F.coalesce("label", "a").alias("label")).distinct()
    )
    sizes = known.groupBy("tile", "label").agg(F.count("*").alias("_n"))
    mixed_tiles = sizes.groupBy("tile").agg(F.max(F.struct("_n", "label")).alias("_top"), F.count("*").alias("_labels"))
    mixed_tiles = mixed_tiles.filter("_labels > 1").select("tile", F.col("_top.label").alias("_main"))
    laid = saved(known.join(mixed_tiles, "tile").select("_main", "a", "label").distinct(), "mixed-tiles")
    totals = laid.groupBy("_main").agg(
        F.count("*").alias("_all"), F.count(F.when(F.col("label") != F.col("_main"), 1)).alias("_rest")
    )
    sets = _sets(laid.select(F.col("a").alias("cid")), docs, classes, n).withColumnRenamed("cid", "a")
    # one component may hold most sets: its members are told the totals apart
    rows = looked_up(laid, "_main", totals, "a").join(classes.select(F.col("cid").alias("a"), "n", "sig"), "a").join(sets, "a")
    stretch = lambda total: F.ceil(F.col(total) / STRETCH).cast("int")
    deal = lambda total, seed: F.pmod(F.xxhash64("a", F.lit(seed)), stretch(total)).cast("int")
    every = lambda total: F.explode(F.sequence(F.lit(0), stretch(total) - 1))
    left = rows.filter("label != _main").withColumn("_l", deal("_rest", 1)).withColumn("_r", every("_all"))
    right = rows.withColumn("_r", deal("_all", 2)).withColumn("_l", every("_rest"))
    wide = ["_main", "a", "label", "n", "sig", "set", "_l", "_r"]
    left, right = left.select(*wide), right.select(*[F.col(c).alias(c) for c in wide])  # names of their own
    keys = ["_main", "_l", "_r"]
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInPandas(lambda l, r: _compared(l, r, percent), "a long, b long")
    )


def _compared(l: pd.DataFrame, r: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components across two stretches of sets.

    Sorted by size, sets with signatures of one length lie together, so that a set meets
    whole runs of signatures. Pairs that may be linked are decided by exact intersection,
    unless links found before have joined their components.
    """
    r = r.sort_values(["n", "a"], kind="stable")
    size, label, ids, sets = (r[c].to_numpy() for c in ("n", "label", "a", "set"))
    names, label = np.unique(np.concatenate([label, l["label"].to_numpy()]), return_inverse=True)
    label, own = label[: len(r)], label[len(r) :]
    now = np.arange(len(names))  # component that a label belongs to by now
    lengths = r["sig"].str.len().to_numpy() // 8
    runs = []
    for length in np.unique(lengths):
        lo, hi = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right")
        runs.append((lo, hi, {int(length): np.frombuffer(b"".join(r["sig"].iloc[lo:hi]), np.uint64).reshape(-1, length)}))
    out = []
    for a, lab, na, sig, set_ in zip(l["a"], own, l["n"], l["sig"], l["set"]):
        x = np.frombuffer(sig, np.uint64)
        least, most = np.searchsorted(size, -(-percent * na // 100)), np.searchsorted(size, 100 * na // percent, side="right")
        for lo, hi, folded in runs:
            i, j = max(lo, least), min(hi, most)
            if i >= j:
                continue
            width = min(len(x), max(folded))
            if width not in folded:
                y = folded[max(folded)]
                while y.shape[1] > width:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                folded[width] = y
            unequal = np.bitwise_count(folded[width][i - lo : j - lo] ^ _folded(x, width)).sum(axis=1, dtype=np.int64)
            nb = size[i:j]
            most_shared = np.minimum(np.minimum(na, nb), (na + nb - unequal) // 2)
            near = (100 * most_shared >= percent * (na + nb - most_shared)) & (now[label[i:j]] != now[lab])
            for at in np.flatnonzero(near) + i:
                if now[label[at]] != now[lab] and linked(overlap(set_, sets[at]), na, int(size[at]), percent):
                    now[now == now[label[at]]] = now[lab]
                    out.append((min(a, ids[at]), max(a, ids[at])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``. Rows: ``(key, n_shingles, component_id, _row)`` for every row,
    where the component is the smallest key reachable by links and ``_row`` a hash of the
    text. Links: pairs ``(a, b)`` of class
    ids that are linked and span the components.

    Rows with empty sets (null, empty or blank texts) are alone in their component, by
    key. Repeated rows and copies share a component; rows with a null key are alone with
    a null component and lend no link. An empty table gives no rows. Keys are whole
    numbers; other columns are not read.
    """
    with batch_rows(docs.sparkSession, BATCH):
        return _joined(docs, key, text, n, percent)


def _joined(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    usable = docs.filter(F.col("_key").isNotNull())
    base = saved(_base(docs, n, percent), "sets")
    keyed = base.filter(F.col("_key").isNotNull() & (F.col("n") > 0))
    total = keyed.agg(F.sum(F.length("low") / 8)).first()[0] or 0
    groups = max(partitions(spark), int(total // GROUP_KEYS) + 1)
    reps = keyed.groupBy("cid").agg(F.min("_key").alias("rep"))
    classes = saved(
        keyed.join(reps.withColumn("_key", F.col("rep")), ["cid", "_key"]).dropDuplicates(["cid"]).select("cid", "rep", "n", "sig"),
        "classes",
    )
    shared, counts = _frequent(keyed, groups)
    found = saved(_tiles(usable, n, percent, groups, shared, counts), "tiles")
    members = found.filter("a = b").select("tile", "a", "pivot")
    pivots = members.filter("pivot = 1")
    first = pivots.groupBy("tile").agg(F.min("a").alias("b"))
    among = pivots.join(first, "tile").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = found.filter("a != b").select("a", "b").union(among).distinct()
    possible = saved(_possible(pairs, classes, percent), "pairs")
    links = saved(_links(possible, usable, classes, n, percent), "links")
    labels = components(links)
    rest = saved(_between(members, labels, usable, classes, n, percent), "links")
    if not rest.isEmpty():
        links = links.union(rest)
        labels = components(links)
    named = labels.join(classes, "cid").groupBy("label").agg(F.min("rep").alias("component_id"))
    named = saved(labels.join(named, "label").select("cid", "component_id"), "components")
    rows = (
        base.select("_key", "_row", "n", "cid")
        .join(classes.select("cid", "rep"), "cid", "left").join(named, "cid", "left")
        .select(
            F.col("_key").alias(key), F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("_key")).when(F.col("_key").isNotNull(), F.coalesce("component_id", "rep")).alias("component_id"),
            "_row",
        )
    )
    return rows, links


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest key; same columns.

    Of rows that repeat a key and a text one stays; rows with a null key all stay, for
    nothing links them. Extra columns follow their row.
    """
    rows, _ = join(docs, key, text, n, percent)
    stay = rows.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("_key"), "_row").distinct()
    # the table's columns travel in a struct, so that none can clash with a helper
    packed = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_row")
    )
    order = [F.col("_doc").getField(c) for c in docs.columns if c != text]
    once = F.row_number().over(Window.partitionBy("_key", "_row").orderBy(*order))
    one = packed.join(stay, ["_key", "_row"], "left_semi").withColumn("_once", once).filter("_once = 1")
    unkeyed = packed.filter(F.col("_key").isNull())
    return one.select("_doc").union(unkeyed.select("_doc")).select("_doc.*")
