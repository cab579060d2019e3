"""Connected components of a graph of any size, by hooking and pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.plans.limits import pin


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every end of an edge; ``component`` is the smallest node that can be reached.

    Every node hooks to its smallest neighbour, chains are halved until all are stars, the stars become the nodes
    of the next round. Each round at least halves the nodes of every component that is not done, so rounds and
    jumps are logarithmic. Self-loops and repeated edges are allowed, ends must not be null.
    """
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = pin(ends.where("a <= b").distinct())
    mapping = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = pin(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parent = pin(parent.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        stars = parent.select(F.col("node").alias("component"), F.col("parent").alias("top"))
        if mapping is None:
            mapping = parent.select("node", F.col("parent").alias("component"))
        else:
            mapping = pin(
                mapping.join(stars, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            )
        for end in ("a", "b"):
            edges = edges.withColumnRenamed(end, "component").join(stars, "component").drop("component").withColumnRenamed("top", end)
        edges = pin(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        if edges.isEmpty():
            return mapping
