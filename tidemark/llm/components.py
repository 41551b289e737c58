"""Connected components of an edge table, by alternating star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round points every node at the smallest node of its neighbourhood, first among larger and then among smaller
    neighbours, so the depth of the forest shrinks by a constant factor a round. Only two sums reach the driver.
    """
    current = stored(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), f"{name}-edges")
    seen = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = current.unionAll(current.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = current.selectExpr("b AS a", "a AS far").join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = stored(small.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct(), f"{name}-edges")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
