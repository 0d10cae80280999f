"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) to (node, root): root is the smallest node of the component; a != b is not needed.

    Each round hands the smallest label of a node and its neighbours on, and follows labels of labels,
    so long chains shorten by half a round. Labels of a node are reduced by partial aggregation, so a
    node with very many edges is no hot spot. Rounds are written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a is not null and b is not null").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most):
        near = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "root")
        lowest = near.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(lowest.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").filter(F.col("root") != F.col("old"))
        if changed.isEmpty():
            return new
        labels = new
    raise RuntimeError(f"components did not settle in {most} rounds")
