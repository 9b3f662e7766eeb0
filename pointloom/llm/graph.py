"""Connected components of edge lists, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or the other neighbours of every node to the least of its neighbourhood.

    edges: (a, b) with a > b. Minima are aggregated before the shuffle, and the join meets
    one row for each node, so a node with very many neighbours can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    edges has two columns of node ids in any order. Loops, repeated edges and nulls are
    ignored. Each turn runs a large and a small star and writes the edges; it ends when a
    turn changes nothing, after about log2 of the longest path turns.
    """
    a, b = edges.columns[:2]
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now = stored(now, "edges")
    sums = None
    while True:
        now = stored(_star(_star(now, True), False), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == tuple(found):
            break
        sums = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
