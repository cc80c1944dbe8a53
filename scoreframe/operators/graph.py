"""Connected components over stored stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.sources.stages import drop_stage, stage


def connected(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(node, component): the smallest node that links reach. Every node takes the smallest label of itself and its
    neighbours and then that label's own label, so labels travel twice as far with every round; a round is a stage that
    replaces the last one."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
    while True:
        around = both.join(label.select(F.col("a").alias("b"), F.col("low").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        closer = label.join(around, "a").select("a", F.col("low").alias("was"), F.least("low", "near").alias("low"))
        jumped = closer.join(label.select(F.col("a").alias("low"), F.col("low").alias("far")), "low", "left")
        new = stage(jumped.select("a", "was", F.least("low", F.coalesce("far", "low")).alias("low")))
        drop_stage(label)
        label = new
        if new.filter("was <> low").isEmpty():
            break
    drop_stage(both)
    return nodes.select(node).join(label.select(F.col("a").alias(node), "low"), node, "left").select(node, F.coalesce("low", node).alias("component"))
