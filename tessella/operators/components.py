"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then follows the label's own label,
    so long chains shrink by powers of two. Rounds go on until no label changes. Labels and edges are cut after each
    round and every join reads cut tables on both sides, so that adaptive execution may split a hub's rows.

    Edges with a null end are ignored; self-loops give a component of one node; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = cut(
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        stepped = cut(
            labels.join(near, labels["node"] == near["a"])
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        target = stepped.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = cut(
            stepped.join(target, stepped["label"] == target["t_node"])
            .select("node", F.least("label", "t_label").alias("label"), "old")
        )
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
