"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (one of its nodes) for every node of the `a`, `b` edges (long).

    Each round every node joins its neighbour of least hash, and the edges are
    rewritten between the nodes joined. As the order is random, a round leaves a
    fixed share of the nodes on average, also on long chains, and a star is gone
    after two. Rounds are written to the shared folder. The least neighbour is
    found by an aggregation that combines before its shuffle; the joins leave a
    node with very many edges to adaptive execution. No edges give no rows.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    result = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("least"))
        step = stored(
            least.select(F.col("a").alias("node"), F.least("least", order("a"))["id"].alias("leader")), "leaders"
        )
        if result is None:
            result = step.select("node", F.col("leader").alias("component"))
        else:
            onward = step.select(F.col("node").alias("component"), "leader")
            result = result.join(onward, "component", "left").select(
                "node", F.coalesce("leader", "component").alias("component")
            )
        result = stored(result, "labels")
        left = step.select(F.col("node").alias("a"), F.col("leader").alias("c"))
        right = step.select(F.col("node").alias("b"), F.col("leader").alias("d"))
        moved = edges.join(left, "a").join(right, "b").filter("c <> d")
        edges = stored(moved.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result
