"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import free, mark, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): component is the smallest id that can be reached.

    Loops and repeated edges don't matter; nodes without an edge don't appear. Edges stay distributed; each
    step is written to the shared folder, and the one before it goes. Rounds go on until nothing changes, which
    the square of the logarithm of the number of nodes bounds.
    """
    begin = mark()
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = written(edges, "large-star")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        down = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _signature(edges)
        free(edges.sparkSession, begin, edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
