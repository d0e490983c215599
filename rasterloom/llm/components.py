"""Distributed connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its least node.

    Each round takes the least label among a node's neighbours and then follows the label's own
    label, so a path of length n settles in about log2(n) rounds. Both joins are plain equi-joins
    of written tables, which adaptive execution can split where a hub holds many edges; labels and
    edges never leave the executors. Loops and repeated edges are harmless, null ends are ignored.
    """
    scratch = Scratch(spark, "components")
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = scratch.save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = (
            pairs.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("seen"))
        )
        hooked = scratch.save(
            labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("to"))
        )
        parent = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = scratch.save(
            hooked.join(parent, "to").select("node", F.least("to", "next").alias("component"), (F.least("to", "next") != F.col("was")).alias("changed"))
        )
        scratch.drop(labels)
        scratch.drop(hooked)
        labels = moved
        if labels.where("changed").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", "component")
