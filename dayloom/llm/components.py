"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dayloom.llm.common import saved
from dayloom.operators.lookup import looked_up

def components(links: DataFrame) -> DataFrame:
    """``(cid, label)``: smallest id reachable, for every id that has a link ``(a, b)``.

    Labels take the least among neighbours, then the label of their label, until none
    changes; every round is a written table, and nothing but a count meets the driver.
    An empty table gives no rows; repeated links and links of an id to itself add nothing.
    """
    links = links.filter("a != b")
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("cid")).alias("label")), "labels")
    while True:
        near = looked_up(both, "b", labels.select(F.col("cid").alias("b"), "label"), "a")
        near = near.groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cid").select("cid", F.least("label", "near").alias("now"), "label")
        step = saved(step, "steps")
        hop = step.select(F.col("cid").alias("now"), F.col("now").alias("far"))
        labels = looked_up(step, "now", hop, "cid").select(
            "cid", F.least("now", "far").alias("label"), F.col("label").alias("old")
        )
        labels = saved(labels, "labels")
        if labels.filter("label < old").isEmpty():
            return labels.select("cid", "label")
        labels = labels.select("cid", "label")
