"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.llm.store import saved


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def with_least(edges: DataFrame) -> DataFrame:
    """``low``: the least of a node and its neighbours.

    Minima are aggregated before they are shuffled, and a node with many edges is a skewed key of a
    join with one row for each node, which Spark splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("low"))


def downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from larger nodes to smaller ones."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node of its component.

    A large-star step ties each node's larger neighbours to its smallest one, a small-star step
    its smaller neighbours and itself. They end when every edge leads to its component's smallest
    node, which leaves the edges as they were.
    """
    edges, before = saved(downward(edges)), None
    while (now := mark(edges)) != before and now[0]:
        before = now
        large = with_least(both_ways(edges)).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = with_least(large)
        ties = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v"))))
        edges = saved(downward(small.select(ties.alias("e")).select("e.u", "e.v")))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
