"""Connected components by alternating large and small stars (Kiveris and others, 2014), as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges(a, b); component is the smallest node that can be reached.

    Nodes are of any ordered type. A node with very many neighbours is never gathered: its smallest neighbour is a
    minimum with partial aggregation, and the join back is one that Spark can split. Edges with a null end and loops
    are left out; no edges give no rows.
    """
    e = cut(_edges(edges.select("a", "b")))
    seen = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _edges(e: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return e.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the node's smallest neighbour."""
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    return _edges(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("low"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _edges(moved.union(low))
