"""Running totals along an order inside groups of any size.

A plain window keeps a whole group in one task. Here a large group is cut into
blocks of its order, totals run inside the blocks, and the blocks' own totals
(one row per block) carry the offsets. The cut points are rows picked by a hash
of their value, so a recomputed task finds the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.session import cut_lineage

BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 1_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group: one map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """Add ``_block``: 0 for small groups, else the number of cut points below the row.

    ``df`` holds one row per key and order value and is cheap to read again.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rate = F.greatest(F.lit(block_rows), F.ceil(F.col("_n") / MAX_BLOCKS)).cast("long")
    cuts = (
        df.select(*keys, order)
        .join(sizes.where(F.col("_n") > block_rows), list(keys))
        .where(F.pmod(F.xxhash64(*keys, order), rate) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(order)).alias("_cuts"))
    )
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    block = F.when(F.col("_cuts").isNull(), 0).otherwise(below)
    return df.join(cuts, list(keys), "left").withColumn("_block", block).drop("_cuts")


class Ordered:
    """Rows of a table in the order of one column inside each group.

    ``df`` holds one row per group and order value, so there are no ties.
    ``largest`` bounds the group sizes: up to ``block_rows`` a plain window
    serves, beyond it the table is cut into blocks once and written to the
    checkpoint folder, because the steps below read it more than once.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: str, *, largest: int, block_rows: int = BLOCK_ROWS
    ):
        self.keys, self.order = list(keys), order
        self.blocked = largest > block_rows
        self.rows = df
        if self.blocked:
            self.rows = cut_lineage(with_blocks(cut_lineage(df), keys, order, block_rows))

    def _add(self, name: str, value: Column, agg, merge, descending: bool) -> Ordered:
        turn = F.desc if descending else F.asc
        groups = [*self.keys, "_block"] if self.blocked else self.keys
        upto = Window.partitionBy(*groups).orderBy(turn(self.order)).rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            self.rows = self.rows.withColumn(name, agg(value).over(upto))
            return self
        valued = self.rows.withColumn("_v", value)
        totals = valued.groupBy(*groups).agg(agg(F.col("_v")).alias("_t"))
        earlier = Window.partitionBy(*self.keys).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*groups, agg(F.col("_t")).over(earlier).alias("_o"))
        local = valued.withColumn(name, agg(F.col("_v")).over(upto)).join(offsets, groups)
        self.rows = local.withColumn(name, merge(F.col(name), F.col("_o"))).drop("_v", "_o")
        return self

    def running_sum(self, name: str, value: Column) -> Ordered:
        """Sum of ``value`` from the group's start up to the row."""
        return self._add(name, value, F.sum, lambda x, o: x + F.coalesce(o, F.lit(0)), False)

    def reverse_min(self, name: str, value: Column) -> Ordered:
        """Minimum of ``value`` from the row to the group's end."""
        return self._add(name, value, F.min, F.least, True)

    def result(self) -> DataFrame:
        return self.rows.drop("_block")


def dense_codes(df: DataFrame, key: str, out: str) -> DataFrame:
    """Integer code 0..n-1 for every distinct key, null key -1.

    Codes follow the order of the keys' md5, which spreads the keys evenly over
    4096 buckets: each bucket is numbered by itself, and only the 4096 bucket
    sizes meet in one place.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3), 16, 10).cast("int")
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_bucket", bucket)
    sizes = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_bucket").orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    codes = (
        keys.withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")  # at most 4096 rows
        .select(key, (F.col("_from") + F.col("_at")).cast("long").alias(out))
    )
    return df.join(codes, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("long")))


def next_in_order(
    df: DataFrame, *, entity: str, block: Column, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Attach the following row's ``values`` (as ``next_*``) inside each entity.

    The order is cut into time blocks; the last row of a block takes the first
    row of the entity's next block, so an entity with very many rows spreads
    over as many tasks as it has blocks.
    """
    rows = df.withColumn("_block", block)
    key = F.struct(*order)
    heads = rows.groupBy(entity, "_block").agg(F.min_by(F.struct(*values), key).alias("_head"))
    jump = heads.select(
        entity, "_block",
        F.lead("_head").over(Window.partitionBy(entity).orderBy("_block")).alias("_head"),
    )
    inside = Window.partitionBy(entity, "_block").orderBy(*order)
    stepped = rows.withColumn("_next", F.lead(F.struct(*values)).over(inside))
    joined = stepped.join(jump, [entity, "_block"])
    nxt = F.coalesce(F.col("_next"), F.col("_head"))
    return joined.select(*df.columns, *[nxt[v].alias(f"next_{v}") for v in values])
