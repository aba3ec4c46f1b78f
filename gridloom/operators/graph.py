"""Connected components by alternating large-star and small-star, all edges in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("_node"), F.least("a", "_least").alias("_least"))
    larger = both.where("b > a").join(least.hint("merge"), F.col("a") == F.col("_node"))
    return larger.select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_least"))
    joined = down.join(least.withColumnRenamed("a", "_node").hint("merge"), F.col("a") == F.col("_node"))
    return joined.select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b").union(least.select("a", F.col("_least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): component is the least node that is reachable.

    Edges with a null end or two equal ends link nothing. No group of neighbours is ever gathered: each step is a
    grouped minimum and a join, whose hot keys Spark may split. The hints keep Spark from broadcasting tables that are
    only small as packed files.
    """
    mark_of = lambda df: df.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark_of(edges)
    while True:
        after = materialize(_small_star(_large_star(edges)))
        mark = mark_of(after)
        release(edges)
        edges = after
        if mark == seen or not mark[0]:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
