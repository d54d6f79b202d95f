"""Hierarchical clustering by a grouped-map kernel, and scores of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linkage(dist: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Agglomerative merges (left, right, height, size) of a square distance matrix; a new cluster has the
    next number. Of equally close pairs the one of the smallest numbers merges first."""
    n = len(dist)
    d = np.full((2 * n - 1, 2 * n - 1), np.inf)
    d[:n, :n] = dist
    np.fill_diagonal(d, np.inf)
    size, live, out = {k: 1 for k in range(n)}, list(range(n)), []
    for new in range(n, 2 * n - 1):
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(sub)), len(live))
        a, b = sorted((live[i], live[j]))
        rest = [k for k in live if k not in (a, b)]
        if method == "average":
            d[new, rest] = (size[a] * d[a, rest] + size[b] * d[b, rest]) / (size[a] + size[b])
        elif method == "complete":
            d[new, rest] = np.maximum(d[a, rest], d[b, rest])
        else:
            raise ValueError(method)
        d[rest, new] = d[new, rest]
        size[new] = size[a] + size[b]
        out.append((a, b, float(min(d[a, b], d[b, a])), size[new]))
        live = [*rest, new]
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right, the smaller number to the left."""
    stack, out = [2 * n - 2] if n > 1 else [0], []
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            a, b = merges[k - n][:2]
            stack += [b, a]
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """At most k clusters: all merges up to a height at which that many are left; labels by first leaf."""
    parent = list(range(2 * n - 1))
    heights = sorted(m[2] for m in merges)
    limit = -np.inf if k >= n else heights[n - k - 1]

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for step, (a, b, h, _) in enumerate(merges):
        if h <= limit:
            parent[root(a)] = parent[root(b)] = n + step
    first: dict[int, int] = {}
    for leaf in leaf_order(merges, n):
        first.setdefault(root(leaf), len(first))
    return np.array([first[root(x)] for x in range(n)])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; 0 for a singleton."""
    names = np.unique(labels)
    member = (labels[:, None] == names[None, :]).astype(float)
    sums, counts = dist @ member, member.sum(axis=0)
    own = np.searchsorted(names, labels)
    rows = np.arange(len(labels))
    n_own = counts[own]
    a = sums[rows, own] / np.maximum(n_own - 1, 1)
    other = sums / counts
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(n_own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: k for k, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    d[pdf["a"].map(at), pdf["b"].map(at)] = pdf["dist"]
    return names, d


def cluster(dist: DataFrame, keys: list[str], ks: range = range(2, 13), method_col: str | None = None, fixed_k: int | None = None) -> DataFrame:
    """(keys..., country, cluster_id, k, silhouette) of each group of distances (a, b, dist).

    k is the first of the best silhouettes over ks, or fixed_k. A group is one run's matrix over countries
    (at most a few hundred nodes); runs are independent tasks.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        merges = linkage(d, pdf[method_col].iloc[0] if method_col else "average")
        best = None
        for k in ks if fixed_k is None else [fixed_k]:
            labels = cut(merges, len(names), k)
            if len(set(labels)) < 2:
                continue
            s = silhouette(d, labels)
            if best is None or s > best[1] + 1e-15:
                best = k, s, labels
        if best is None:
            best = 1, 0.0, np.zeros(len(names), int)
        out = pd.DataFrame({"country": names, "cluster_id": best[2], "k": best[0], "silhouette": best[1]})
        for c in keys:
            out.insert(0, c, pdf[c].iloc[0])
        return out[[*keys, "country", "cluster_id", "k", "silhouette"]]

    kinds = dict(dist.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", country string, cluster_id int, k int, silhouette double"
    return dist.groupBy(*keys).applyInPandas(one, schema)


def silhouette_curve(dist: DataFrame, keys: list[str], ks: range = range(2, 13), method_col: str | None = None) -> DataFrame:
    """(keys..., k, n_clusters, silhouette, largest_cluster, singletons) by number of clusters."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        merges = linkage(d, pdf[method_col].iloc[0] if method_col else "average")
        rows = []
        for k in ks:
            labels = cut(merges, len(names), k)
            sizes = np.bincount(labels)
            if len(sizes) > 1:
                rows.append((*(pdf[c].iloc[0] for c in keys), k, len(sizes), silhouette(d, labels), int(sizes.max()), int((sizes == 1).sum())))
        return pd.DataFrame(rows, columns=[*keys, "k", "n_clusters", "silhouette", "largest_cluster", "singletons"])

    kinds = dict(dist.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", k int, n_clusters int, silhouette double, largest_cluster int, singletons int"
    return dist.groupBy(*keys).applyInPandas(one, schema)


def silhouette_of(dist: DataFrame, labels: DataFrame) -> DataFrame:
    """(country, label, a, b, s) of each node for given labels, in DataFrame operations."""
    other = F.broadcast(labels.select(F.col("country").alias("b"), F.col("label").alias("lb")))
    own = F.broadcast(labels.select(F.col("country").alias("a"), F.col("label").alias("la")))
    means = dist.join(own, "a").join(other, "b").groupBy("a", "la", "lb").agg(F.avg("dist").alias("m"))
    best = means.groupBy("a", "la").agg(
        F.max(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("inner"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("outer")
    )
    s = F.when(F.col("inner").isNull(), 0.0).otherwise((F.col("outer") - F.col("inner")) / F.greatest("inner", "outer"))
    return best.select(F.col("a").alias("country"), F.col("la").alias("label"), F.col("inner").alias("a"), F.col("outer").alias("b"), s.alias("s"))


def cohesion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, inside, outside, cohesion): mean similarity within a label less that to outsiders."""
    both = pairs.select("a", "b", "sim").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    la = F.broadcast(labels.select(F.col("country").alias("a"), F.col("label").alias("la")))
    lb = F.broadcast(labels.select(F.col("country").alias("b"), F.col("label").alias("lb")))
    same = F.col("la") == F.col("lb")
    own = both.join(la, "a").join(lb, "b").groupBy(F.col("la").alias("label")).agg(
        F.count_distinct("a").alias("n"), F.coalesce(F.avg(F.when(same, F.col("sim"))), F.lit(0.0)).alias("inside"), F.coalesce(F.avg(F.when(~same, F.col("sim"))), F.lit(0.0)).alias("outside")
    )
    return own.withColumn("cohesion", F.col("inside") - F.col("outside"))


def bloc_overlap(labels: DataFrame, blocs: DataFrame) -> DataFrame:
    """(label, bloc, n, bloc_size, share) of labels (country, label) with named blocs (bloc, country)."""
    sizes = blocs.groupBy("bloc").agg(F.count(F.lit(1)).alias("bloc_size"))
    met = labels.join(F.broadcast(blocs), "country").groupBy("label", "bloc").agg(F.count(F.lit(1)).alias("n"))
    return met.join(F.broadcast(sizes), "bloc").select("label", "bloc", "n", "bloc_size", (F.col("n") / F.col("bloc_size")).alias("share"))


def families(labels: DataFrame, *keys: str) -> DataFrame:
    """(keys..., label, family): the coarse family of each cluster, which as published is one for all."""
    return labels.select(*keys, "label").distinct().withColumn("family", F.lit(1))


def first_best(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The first k with the best silhouette by group."""
    w = Window.partitionBy(*keys).orderBy(F.desc("silhouette"), "k")
    return curve.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
