"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpointed


def _directed(edges: DataFrame) -> DataFrame:
    return checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    return checkpointed(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())


def contracted(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges (a, b) with the components of `edges` (a, b) after a few rounds, by which most are stars: a node's smallest
    neighbour is a name that only nodes of its component can have."""
    edges = _directed(edges)
    for _ in range(rounds):
        edges = _round(edges)
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); component is the smallest node reachable.

    Every round points neighbours at the smallest one they know of, first those above a node, then those below, until
    each component is a star around its smallest node. A round is two aggregations (pre-aggregated before their
    shuffles) and two joins on the node, which adaptive execution splits where a node has very many edges; only the
    fixpoint's digest reaches the driver. Self-loops and repeated edges do no harm; an empty table has no components.
    """
    edges = _directed(edges)
    digest = None
    for _ in range(most_rounds):
        now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
        edges = _round(edges)
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v")))
