"""Reproducible randomness: orders and draws that come from md5 of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("draw"))


def _nodes(labels: DataFrame, node: str, *further: str) -> DataFrame:
    """One row: ``nodes``, the structs of a small dimension in the order of the node names."""
    return labels.agg(F.array_sort(F.collect_list(F.struct(F.col(node).alias("node"), *further))).alias("nodes"))


def places(labels: DataFrame, node: str = "country") -> DataFrame:
    """(node, place): places from 0 in the order of the names, of a small dimension."""
    return _nodes(labels, node).select(F.posexplode("nodes").alias("place", "x")).select("x.node", "place")


def relabelled(spark: SparkSession, labels: DataFrame, n: int, seed: str, node: str = "country", label: str = "label") -> DataFrame:
    """(draw, labels): n relabellings that keep the labels' sizes, each an array by the nodes' places.

    A draw puts the labels in the order of md5 of seed, draw and the name they come from; it needs no shuffle.
    labels is a small dimension.
    """
    nodes = F.broadcast(_nodes(labels, node, F.col(label).alias("label")))
    keyed = F.transform("nodes", lambda x: F.struct(key(seed, F.col("draw"), x["node"]).alias("k"), x["label"].alias("label")))
    return draws(spark, n).crossJoin(nodes).select("draw", F.transform(F.array_sort(keyed), lambda x: x["label"]).alias("labels"))


def resampled(spark: SparkSession, labels: DataFrame, n: int, seed: str, node: str = "country") -> DataFrame:
    """(draw, times): n samples of as many nodes with replacement, each an array of how often by the nodes' places."""
    nodes = F.broadcast(_nodes(labels, node))
    size = F.size("nodes")
    pick = lambda k: F.conv(F.substring(key(seed, F.col("draw"), k), 1, 8), 16, 10).cast("long") % size
    every = F.sequence(F.lit(0), size - 1)
    drawn = draws(spark, n).crossJoin(nodes).select("draw", every.alias("every"), F.transform(every, pick).alias("picks"))
    return drawn.select("draw", F.transform("every", lambda k: F.size(F.filter("picks", lambda p: p == k)).cast("long")).alias("times"))


def placed_ends(pairs: DataFrame, labels: DataFrame, a: str = "voter", b: str = "recipient", node: str = "country") -> DataFrame:
    """pairs with the places pa and pb of both ends."""
    own = places(labels, node)
    for side, name in ((a, "pa"), (b, "pb")):
        pairs = pairs.join(F.broadcast(own.select(F.col("node").alias(side), F.col("place").alias(name))), side)
    return pairs
