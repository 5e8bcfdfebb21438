"""Connected components by alternating stars, every step a join of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b); the component is its smallest node.

    Each round links the larger neighbours of a node to its smallest one (large star),
    then the smaller ones (small star), until every node hangs on a root. Nodes without
    edges do not appear.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = stored(edges.where("a <> b").select(high, low).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        lower = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(lower.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        roots = links.select("v").distinct().withColumnRenamed("v", "u")
        parents = links.groupBy("u").count()
        if not parents.where("count > 1").take(1) and not roots.join(parents, "u", "left_semi").take(1):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
