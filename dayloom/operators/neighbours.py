"""The rounds of one classifier test over a whole table, in arrays.

``ccit`` states the test; this is its work for a table that is one test. A turn's rounds
take three passes. The first counts donors by cell; the second deals rows to buckets and
finds, in each bucket, the donor of every row that asks, and the leaves of real and swapped
rows; the third scores the rows held out. Between the passes go one number for each cell
(a cell has about ``3 * BUCKET`` rows) and the counts by leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dayloom.functions.digests import Prefixes

#: Rows of a task of the second pass, about, rows of it that meet together, and pairs that are compared together.
TASK_ROWS, MET_ROWS, PAIRS = 1 << 18, 1 << 14, 1 << 16


class Cells:
    """Places of the cells of some rounds, every level of a round after the other."""

    def __init__(self, some: range, levels: list[int], offset: np.ndarray):
        self.some, self.levels, self.offset, self.width = some, levels, offset, offset.shape[1]
        self.sides = [2**v + 2 if self.width else 1 for v in levels]
        self.starts = np.cumsum([0, *[s**self.width for s in self.sides]])
        self.size = int(self.starts[-1])

    def of(self, z: list[np.ndarray], k: int, i: int) -> np.ndarray:
        """Cell of every row in a round and level; an unknown number is in the first."""
        out = np.zeros(len(z[0]) if z else 1, np.int64)
        for h in range(self.width):
            place = np.floor(z[h] * 2.0 ** self.levels[i] + self.offset[k, h])
            out = out * self.sides[i] + np.where(np.isnan(place), 0, place).astype(np.int64)
        return out + ((k - self.some.start) * self.size + self.starts[i])

    def reached(self, full: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Cells whose donors may be asked: all of the finest level, and those of the others
        that share points with a cell of the finest that asks and has no donor."""
        out = np.zeros(len(full), bool)
        by_round = out.reshape(len(self.some), self.size)
        by_round[:, : self.starts[1]] = True
        bare = (asked > 0) & (full == 0)
        rounds, cells = np.nonzero(bare.reshape(len(self.some), self.size)[:, : self.starts[1]])
        at = []
        for _ in range(self.width):
            at.insert(0, cells % self.sides[0])
            cells = cells // self.sides[0]
        for i in range(1, len(self.levels)):
            ends = []
            for h in range(self.width):
                shift = self.offset[rounds + self.some.start, h]
                scale = 2.0 ** (self.levels[i] - self.levels[0])
                low, high = ((at[h] + e - shift) * scale + shift for e in (-1e-6, 1 + 1e-6))
                ends.append([np.clip(np.floor(x).astype(np.int64), 0, self.sides[i] - 1) for x in (low, high)])
            for corner in product(*ends):
                place = np.zeros(len(rounds), np.int64)
                for x in corner:
                    place = place * self.sides[i] + x
                by_round[rounds, place + self.starts[i]] = True
        return out


def _drawn(batch: pa.RecordBatch, some: range, seed: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per round its number and the part, the fold and the deal of every row."""
    keys = Prefixes(batch.column("_id"), len(seed.encode()) + 12)
    for k in some:
        w = keys.words(f"|{k}|{seed}".encode())
        yield k, w[0] % 3, w[1] % 3 == 0, w[2].astype(np.int64)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(float, copy=False) for n in names]


def _donors(data: DataFrame, us: list[str], cells: Cells, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Donors of every cell, and rows that ask in every cell of the finest level."""

    def count(batches):
        full, asked = (np.zeros(cells.size * len(cells.some), np.int64) for _ in range(2))
        for batch in batches:
            z = _numbers(batch, us[2 : 2 + cells.width])
            for k, part, _, _ in _drawn(batch, cells.some, seed):
                for into, who, levels in ((full, part == 2, len(cells.levels)), (asked, part == 1, 1)):
                    who = np.flatnonzero(who)
                    for i in range(levels):
                        at = cells.of([x[who] for x in z], k, i)
                        if not cells.width:
                            into[at] += len(who)
                        else:
                            lowest = at.min(initial=len(into))
                            n = np.bincount(at - lowest) if len(at) else at
                            into[lowest : lowest + len(n)] += n
        at = np.flatnonzero(full + asked)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, full[at], asked[at])], names=["_cell", "_full", "_asked"])

    sums = data.mapInArrow(count, "_cell long, _full long, _asked long").groupBy("_cell")
    found = sums.agg(F.sum("_full").alias("_full"), F.sum("_asked").alias("_asked")).toPandas()
    out = np.zeros((2, cells.size * len(cells.some)), np.int64)
    out[:, found["_cell"].to_numpy(np.int64)] = found[["_full", "_asked"]].to_numpy(np.int64).T
    return out[0], out[1]


#: In the order of a bucket's rows; those that stay as they are need no bucket.
GIVES, ASKS, REAL = range(3)


def _schema(us: list[str]) -> pa.Schema:
    """Dealt rows: ``_at`` is four times the bucket's number (negative: in none), and the role."""
    kinds = {"_at": pa.int64(), "_k": pa.int32(), "_test": pa.bool_(), "_deal": pa.int64(), "_id": pa.string()}
    return pa.schema([*kinds.items(), *[(u, pa.float64()) for u in us]])


def _placed(
    data: DataFrame, us: list[str], cells: Cells, full: np.ndarray, reached: np.ndarray, bucket: int, seed: str, tasks: int
) -> DataFrame:
    """``(_task, _rows)``: rows of all rounds by the task of their bucket: those that stay as they are,
    those that ask, in the finest cell that holds a donor, and donors in every cell that may be asked.
    Many rows travel as one, so that a shuffle of them neither reads nor sorts single rows."""
    schema, deepest = _schema(us), int(-(-full.max(initial=0) // bucket)) + 1

    def place(batches):
        held: list[pa.RecordBatch] = []

        def dealt():
            table = pa.Table.from_batches(held, schema=schema)
            at = table["_at"].to_numpy() >> 2
            # a multiplicative hash: neighbouring buckets go to different tasks
            task = ((at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(tasks)
            task = task.astype(np.uint16 if tasks <= 1 << 16 else np.int64)
            order = np.argsort(task, kind="stable")
            rows = table.take(pa.array(order)).combine_chunks().to_batches()[0]
            found, starts = np.unique(task[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            blobs = [rows.slice(x, y - x).serialize() for x, y in zip(starts.tolist(), ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array([b.to_pybytes() for b in blobs], pa.binary())], names=["_task", "_rows"]
            )

        for batch in batches:
            u, ids = _numbers(batch, us), batch.column("_id")
            z = u[2 : 2 + cells.width]

            def rows(role, k, who, cell, test, deal):
                """A row without a cell, or in one without donors, goes anywhere."""
                there = np.zeros(len(who), np.int64) if cell is None else full[cell]
                at = np.where(there > 0, (0 if cell is None else cell) * deepest + deal[who] % np.maximum(-(-there // bucket), 1), -1 - deal[who])
                first = [at * 4 + role, np.full(len(who), k, np.int32), test[who], deal[who]]
                arrays = [*map(pa.array, first), ids.take(pa.array(who)), *[pa.array(x[who]) for x in u]]
                held.append(pa.RecordBatch.from_arrays(arrays, schema=schema))

            for k, part, test, deal in _drawn(batch, cells.some, seed):
                rows(REAL, k, np.flatnonzero(part == 0), None, test, deal)
                who = np.flatnonzero(part == 1)
                found, left = np.zeros(len(who), np.int64), np.arange(len(who))
                for i in range(len(cells.levels)):
                    found[left] = cells.of([x[who[left]] for x in z], k, i)
                    left = left[full[found[left]] == 0]
                    if not len(left):
                        break
                rows(ASKS, k, who, found, test, deal)
                who = np.flatnonzero(part == 2)
                for i in range(len(cells.levels)):
                    cell = np.broadcast_to(cells.of([x[who] for x in z], k, i), who.shape)
                    use = reached[cell]
                    if use.any():
                        rows(GIVES, k, who[use], cell[use], test, deal)
                if sum(map(len, held)) >= TASK_ROWS:
                    yield dealt()
                    held = []
        if sum(map(len, held)):
            yield dealt()

    return data.mapInArrow(place, "_task int, _rows binary")


def _taken(b: dict[str, np.ndarray], ids: Callable[[int], bytes], us: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sorted batch that ask, each once, and the place of the donor each one takes
    (-1: its bucket has none). Donors come before the rows that ask in each bucket."""
    bucket, role = b["_at"] >> 2, b["_at"] & 3
    new = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    group = np.repeat(np.arange(len(new)), np.diff(new, append=len(bucket)))
    donors = np.bincount(group[role == GIVES], minlength=len(new))
    asks = np.flatnonzero(role == ASKS)
    order = np.lexsort((b["_deal"][asks], group[asks]))
    one, two = asks[order[:-1]], asks[order[1:]]
    same = (group[one] == group[two]) & (b["_deal"][one] == b["_deal"][two])
    if same.any():  # a row that comes twice asks once
        seen, twice = set(), set()
        for i in np.union1d(one[same], two[same]).tolist():
            row = (group[i], ids(i), *[b[u][i].tobytes() for u in us])
            (twice if row in seen else seen).add(i if row in seen else row)
        asks = asks[~np.isin(asks, [*twice])]
    out = np.full(len(asks), -1)
    many = donors[group[asks]]
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, PAIRS), "right")
    for low, high in zip(cuts, [*cuts[1:], len(asks)]):
        some = np.arange(low, high)[many[low:high] > 0]
        if not len(some):
            continue
        size = many[some]
        starts = np.cumsum(size) - size
        mine = np.repeat(asks[some], size)
        theirs = np.arange(int(size.sum())) + np.repeat(new[group[asks[some]]] - starts, size)
        apart = np.zeros(len(mine))
        for u in us[2:]:
            gap = b[u][mine] - b[u][theirs]
            gap *= gap
            apart += gap
        # to 12 digits; an unknown distance is the largest. Rows at equal distance come in another order for every row that asks
        apart = np.floor(apart * 1e12 + 0.5)
        apart[np.isnan(apart)] = np.inf
        turn = b["_deal"][mine] ^ b["_deal"][theirs]
        turn[apart != np.repeat(np.minimum.reduceat(apart, starts), size)] = 1 << 62
        best = np.flatnonzero(turn == np.repeat(np.minimum.reduceat(turn, starts), size))
        who = np.searchsorted(starts, best, "right") - 1
        for at in np.flatnonzero(who[1:] == who[:-1]).tolist():  # one deal twice: by id
            if ids(int(theirs[best[at]])) < ids(int(theirs[best[at + 1]])):
                best[at + 1] = best[at]
        out[some[who]] = theirs[best]  # of several the last
    return asks, out


def leaves(u: list[np.ndarray], forest: list[list[tuple[int, int, int, float]]]) -> np.ndarray:
    """A row's leaf in every tree; an unknown number is above every value."""
    made: dict[tuple[int, int, int], np.ndarray] = {}
    out = np.empty((len(u[0]), len(forest)), np.uint16)
    for t, tree in enumerate(forest):
        leaf = np.full(len(u[0]), 2 ** len(tree) - 1, np.uint16)
        for d, (a, sign, b, v) in enumerate(tree):
            cut = (a, sign, b if sign else -1)
            if cut not in made:
                made[cut] = u[a] + sign * u[b] if sign else u[a]
            leaf -= (made[cut] <= v).astype(np.uint16) << d
        out[:, t] = leaf
    return out


MET = "_k int, _label int, _slot int, _n long, _leaves binary"


def _met(placed: DataFrame, us: list[str], some: range, forest: list) -> DataFrame:
    """Of real and swapped rows the leaves, for rows held out, and the counts by leaf of all others."""
    trees, size, kinds = len(forest), 2 ** len(forest[0]), _schema(us)
    schema = pa.schema([("_k", pa.int32()), ("_label", pa.int32()), ("_slot", pa.int32()), ("_n", pa.int64()), ("_leaves", pa.binary())])

    def meet(batches):
        counts = np.zeros((2, trees, len(some) * size), np.int64)

        def told(b: dict[str, np.ndarray], ids: Callable[[int], bytes]) -> pa.RecordBatch:
            asks, donor = _taken(b, ids, us)
            real = np.flatnonzero(b["_at"] & 3 == REAL)
            rows = np.concatenate([real, asks])
            label = np.repeat([1, 0], [len(real), len(asks)])
            u = [b[x][rows] for x in us]
            swap = np.flatnonzero(donor >= 0)
            u[1][len(real) + swap] = b[us[1]][donor[swap]]
            leaf, k, test = leaves(u, forest), b["_k"][rows].astype(np.int64) - some.start, b["_test"][rows]
            for side in (0, 1):
                at = np.flatnonzero(~test & (label == side))
                first = k[at] * size
                for t in range(trees):
                    counts[side, t] += np.bincount(first + leaf[at, t], minlength=counts.shape[2])
            at = np.flatnonzero(test)
            held = np.ascontiguousarray(leaf[at], "<u2")
            ends = np.arange(0, held.nbytes + 1, held.shape[1] * 2, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(held)])
            none = lambda kind: pa.nulls(len(at), kind)
            columns = [pa.array((k[at] + some.start).astype(np.int32)), pa.array(label[at].astype(np.int32)), none(pa.int32()), none(pa.int64()), packed]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        dealt = [pa.ipc.read_record_batch(x.as_buffer(), kinds) for batch in batches for x in batch.column("_rows")]
        if dealt:
            table = pa.Table.from_batches(dealt)
            dealt.clear()
            names = table["_id"]
            columns = {n: table[n].to_numpy() for n in table.column_names if n != "_id"}
            order = np.argsort(columns["_at"])
            bucket = columns["_at"][order] >> 2
            starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
            cuts = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, len(order), MET_ROWS), "right") - 1], len(order)))
            for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
                at = order[low:high]
                yield told({n: x[at] for n, x in columns.items()}, lambda i: names[int(at[i])].as_py().encode())  # noqa: B023
        side, tree, at = np.nonzero(counts)
        columns = [at // size + some.start, side, tree * size + at % size]
        columns = [pa.array(x.astype(np.int32)) for x in columns] + [pa.array(counts[side, tree, at]), pa.nulls(len(at), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return placed.mapInArrow(meet, MET)


def met(data: DataFrame, us: list[str], cells: Cells, forest: list, *, held: int, bucket: int, seed: str) -> DataFrame:
    """Leaves of the rows held out in some rounds, and counts by leaf of all others."""
    width = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(width, -(-held * len(cells.some) // TASK_ROWS))
    if len(cells.some) > 1:  # a row is worth as many as there are rounds
        data = data.repartition(tasks, "_id")
    full, asked = _donors(data, us, cells, seed)
    placed = _placed(data, us, cells, full, cells.reached(full, asked), bucket, seed, tasks)
    placed = placed.repartitionById(tasks, "_task")
    return _met(placed, us, cells.some, forest)


def told(rows: DataFrame, some: range, trees: int, size: int) -> DataFrame:
    """Per round and label the share of rows held out whose part the forest names, and their number."""
    sums = rows.where("_slot is not null").groupBy("_k", "_label", "_slot").agg(F.sum("_n").alias("_n")).toPandas()
    n = np.zeros((2, len(some), trees * size))
    n[sums["_label"], sums["_k"] - some.start, sums["_slot"]] = sums["_n"]
    known = (n[1] + 1) / (n.sum(axis=0) + 2)  # a leaf without rows says nothing

    def score(batches):
        out = np.zeros((2, 2, len(some)), np.int64)
        for batch in batches:
            k, label = (batch.column(x).to_numpy().astype(np.int64) for x in ("_k", "_label"))
            leaf = np.frombuffer(b"".join(batch.column("_leaves").to_pylist()), "<u2").reshape(len(k), trees)
            k -= some.start
            sums = np.zeros(len(k))
            for t in range(trees):
                sums += known[k, leaf[:, t] + np.int64(t * size)]
            hit = (sums / trees >= 0.4999999995) == (label == 1)  # half or more, to nine digits
            for i, who in enumerate((hit, slice(None))):
                out[i] += np.bincount(label[who] * len(some) + k[who], minlength=2 * len(some)).reshape(2, -1)
        label, k = np.nonzero(out[1])
        columns = [k.astype(np.int32) + some.start, label.astype(float), out[0][label, k], out[1][label, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_k", "_label", "_hits", "_n"])

    asked = rows.where("_leaves is not null").select("_k", "_label", "_leaves")
    sides = asked.mapInArrow(score, "_k int, _label double, _hits long, _n long").groupBy("_k", "_label")
    return sides.agg((F.sum("_hits") / F.sum("_n")).alias("_a"), F.sum("_n").alias("_n"))
