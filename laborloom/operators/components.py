"""Classes of linked items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def classes(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node in `edges` (a, b): the least node of its connected component.

    Every round takes each node's least neighbour's root and then the root's root, so that a chain of n links takes
    about log n rounds. Each round is written to the shared folder, so that a lost executor costs one round.
    """
    both = edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = new.join(up, "root", "left").select("node", "old", F.least(F.col("root"), F.coalesce("up", "root")).alias("root"))
        new = materialize(new, "labels")
        labels = new.select("node", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most} rounds")
