"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_materialized, materialize


def _settled(labels: DataFrame, rounds: int) -> DataFrame:
    """labels (node, root) with every root followed to its own root: jumps double what they cover."""
    for _ in range(rounds):
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = materialize(labels.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "labels")
        moved = not jumped.where("moved").isEmpty()
        drop_materialized(labels)
        labels = jumped.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node that it reaches.

    Each round points every node to the smallest among itself and its neighbours and follows these pointers to
    their ends; what remains are edges between ends, each once, and a new round on them. At least every second
    node goes in a round, and in a dense group nearly all do, so edges are joined but once or twice. Every
    step is written to the shared folder, which cuts the lineage, and deleted when the next one stands. Only
    one row of it at most comes to the driver, to tell that it is not empty: without a shuffle."""
    edges, found = materialize(edges.select("a", "b").where("a <> b"), "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        labels = _settled(materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels"), rounds)
        if found is None:
            found = labels
        else:
            later = labels.select(F.col("node").alias("root"), F.col("root").alias("later"))
            longer = materialize(found.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "found")
            drop_materialized(found)
            found = longer
        ends = [labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        left = edges.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b")
        left = materialize(left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        drop_materialized(edges)
        edges = left
        if edges.isEmpty():
            drop_materialized(edges)
            return found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
