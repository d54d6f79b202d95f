"""Weighted graphs: edges, modularity, communities, alignment and geography."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia.functions.hashing import placed_ends, relabelled
from affinia.functions.numeric import haversine_km


def digraph(votes: DataFrame) -> DataFrame:
    """(src, dst, w, n_years, mean_w): total points, years with a row of the pair, points by such year."""
    out = votes.filter("points > 0").groupBy(F.col("voter").alias("src"), F.col("recipient").alias("dst"))
    out = out.agg(F.sum("points").alias("w"), F.count_distinct("year").alias("n_years"))
    return out.withColumn("mean_w", F.col("w") / F.col("n_years"))


def symmetrised(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys..., a, b, w) with a < b and the weights of both directions."""
    return edges.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def graph_stats(edges: DataFrame, *keys: str) -> DataFrame:
    """Nodes, edges and density of the undirected graph, and directed edges."""
    nodes = edges.select(*keys, F.col("src").alias("n")).union(edges.select(*keys, "dst")).groupBy(*keys).agg(F.count_distinct("n").alias("nodes"))
    directed = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("directed_edges"))
    own = symmetrised(edges, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))
    out = nodes.join(directed, list(keys)).join(own, list(keys))
    return out.withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2))


def modularity(edges: DataFrame, labels: DataFrame, *keys: str, directed: bool = False) -> DataFrame:
    """(keys..., q) of edges (src, dst, w) under labels (country, label). Undirected weights are summed."""
    src = F.broadcast(labels.select(F.col("country").alias("src"), F.col("label").alias("ls")))
    dst = F.broadcast(labels.select(F.col("country").alias("dst"), F.col("label").alias("ld")))
    own = edges.join(src, "src").join(dst, "dst")
    total = own.groupBy(*keys).agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inside"))
    out = own.groupBy(*keys, F.col("ls").alias("label")).agg(F.sum("w").alias("w_out"))
    into = own.groupBy(*keys, F.col("ld").alias("label")).agg(F.sum("w").alias("w_in"))
    both = out.join(into, [*keys, "label"], "full").na.fill(0.0)
    product = F.col("w_out") * F.col("w_in") if directed else F.pow((F.col("w_out") + F.col("w_in")) / 2, 2)
    expected = both.groupBy(*keys).agg(F.sum(product).alias("e"))
    joined = total.join(expected, list(keys)) if keys else total.crossJoin(F.broadcast(expected))
    return joined.select(*keys, (F.col("inside") / F.col("m") - F.col("e") / (F.col("m") * F.col("m"))).alias("q"))


def _adjacency(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: k for k, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    w[i, j] += pdf["w"].to_numpy()
    w[j, i] += pdf["w"].to_numpy()
    return names, w


def quality(w: np.ndarray, labels: np.ndarray) -> float:
    two_m = w.sum()
    member = (labels[:, None] == np.unique(labels)[None, :]).astype(float)
    return float(np.trace(member.T @ w @ member) / two_m - ((w.sum(axis=1) @ member) ** 2).sum() / two_m**2)


def louvain(w: np.ndarray, seed: int) -> np.ndarray:
    """Labels by local moves of the best modularity gain and aggregation, in a seeded order of nodes."""
    rng = random.Random(seed)
    labels = np.arange(len(w))
    level = w.copy()
    while True:
        n, two_m = len(level), level.sum()
        degree, own = level.sum(axis=1), np.arange(n)
        inside = degree.copy()  # degree of each community
        moved_any = moved = True
        moved_any = False
        while moved:
            moved = False
            order = list(range(n))
            rng.shuffle(order)
            for x in order:
                inside[own[x]] -= degree[x]
                link = np.bincount(own, weights=np.where(np.arange(n) == x, 0.0, level[x]), minlength=n)
                gain = link - inside * degree[x] / two_m
                best = int(np.argmax(np.where(link > 0, gain, -np.inf))) if (link > 0).any() else own[x]
                if gain[best] <= gain[own[x]] + 1e-12:
                    best = own[x]
                if best != own[x]:
                    own[x], moved, moved_any = best, True, True
                inside[own[x]] += degree[x]
        if not moved_any:
            return np.unique(labels, return_inverse=True)[1]
        _, own = np.unique(own, return_inverse=True)
        labels = own[labels]
        member = (own[:, None] == np.arange(own.max() + 1)[None, :]).astype(float)
        level = member.T @ level @ member


def ordered(names: list[str], labels: np.ndarray) -> np.ndarray:
    """Labels renumbered by (size descending, first member)."""
    groups: dict[int, list[str]] = {}
    for name, x in zip(names, labels, strict=True):
        groups.setdefault(int(x), []).append(name)
    rank = {x: k for k, x in enumerate(sorted(groups, key=lambda x: (-len(groups[x]), min(groups[x]))))}
    return np.array([rank[int(x)] for x in labels])


def louvain_best(spark: SparkSession, edges: DataFrame, key: str, seeds: int = 30) -> DataFrame:
    """(key, country, community_id, q, min_q): the best of many seeded runs, each its own task, which holds the
    matrix of a graph of nations (some hundred nodes, however many votes there are)."""
    runs = edges.crossJoin(F.broadcast(spark.range(7, 7 + seeds).select(F.col("id").cast("int").alias("seed"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = _adjacency(pdf)
        labels = louvain(w, int(pdf["seed"].iloc[0]))
        return pd.DataFrame({key: pdf[key].iloc[0], "seed": int(pdf["seed"].iloc[0]), "q": quality(w, labels), "country": names, "community_id": ordered(names, labels)})

    kind = dict(edges.dtypes)[key]
    found = runs.groupBy(key, "seed").applyInPandas(one, f"{key} {kind}, seed int, q double, country string, community_id int")
    w = Window.partitionBy(key, "country").orderBy(F.desc("q"), "seed")
    low = F.min("q").over(Window.partitionBy(key, "country"))
    return found.withColumns({"rn": F.row_number().over(w), "min_q": low}).filter("rn = 1").select(key, "country", "community_id", "q", "min_q")


def _betweenness(length: np.ndarray) -> np.ndarray:
    """Edge betweenness of an undirected graph with edge lengths (inf: no edge)."""
    n = len(length)
    near = [np.flatnonzero(np.isfinite(length[x])) for x in range(n)]
    total = np.zeros((n, n))
    for s in range(n):
        dist, paths, before, done = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
        dist[s], paths[s] = 0.0, 1.0
        queue, seen = [(0.0, s)], np.zeros(n, bool)
        while queue:
            d, x = heapq.heappop(queue)
            if seen[x]:
                continue
            seen[x] = True
            done.append(x)
            for y in near[x]:
                new = d + length[x, y]
                if new < dist[y] - 1e-15:
                    dist[y], paths[y], before[y] = new, paths[x], [x]
                    heapq.heappush(queue, (new, int(y)))
                elif abs(new - dist[y]) <= 1e-15 and not seen[y]:
                    paths[y] += paths[x]
                    before[y].append(x)
        share = np.zeros(n)
        for y in reversed(done):
            for x in before[y]:
                part = paths[x] / paths[y] * (1 + share[y])
                total[x, y] += part
                total[y, x] += part
                share[x] += part
    return total / 2


def _parts(length: np.ndarray) -> np.ndarray:
    labels, k = np.full(len(length), -1), 0
    for s in range(len(length)):
        if labels[s] < 0:
            stack = [s]
            labels[s] = k
            while stack:
                for y in np.flatnonzero(np.isfinite(length[stack.pop()])):
                    if labels[y] < 0:
                        labels[y] = k
                        stack.append(int(y))
            k += 1
    return labels


def girvan_newman(w: np.ndarray, levels: int = 12) -> tuple[np.ndarray, float]:
    """The best of the trivial partition and the first levels of edge removal; ties of edges by number."""
    length = np.where(w > 0, 1.0 / np.where(w > 0, w, 1.0), np.inf)
    best, score, parts = np.zeros(len(w), int), quality(w, np.zeros(len(w), int)), _parts(length)
    for _ in range(levels):
        k = parts.max()
        while parts.max() == k and np.isfinite(length).any():
            i, j = divmod(int(np.argmax(np.round(_betweenness(length), 9))), len(w))
            length[i, j] = length[j, i] = np.inf
            parts = _parts(length)
        if parts.max() == k:
            break
        if (q := quality(w, parts)) > score:
            best, score = parts, q
    return best, score


def girvan_newman_best(edges: DataFrame, key: str, levels: int = 12) -> DataFrame:
    """(key, country, community_id, q): the best of the first levels, a task for each graph of nations."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = _adjacency(pdf)
        labels, q = girvan_newman(w, levels)
        return pd.DataFrame({key: pdf[key].iloc[0], "country": names, "community_id": ordered(names, labels), "q": q})

    return edges.groupBy(key).applyInPandas(one, f"{key} {dict(edges.dtypes)[key]}, country string, community_id int, q double")


def jaccard_overlaps(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """(label, ref, overlap) of all communities of two labellings (country, label) that meet."""
    a = labels.groupBy("label").agg(F.count(F.lit(1)).alias("na"))
    b = reference.groupBy(F.col("label").alias("ref")).agg(F.count(F.lit(1)).alias("nb"))
    both = labels.join(reference.select("country", F.col("label").alias("ref")), "country").groupBy("label", "ref").agg(F.count(F.lit(1)).alias("n"))
    return both.join(F.broadcast(a), "label").join(F.broadcast(b), "ref").select("label", "ref", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("overlap"))


def greedy_alignment(scored: list[tuple[float, int, int]], own: list[int], refs: list[int]) -> dict[int, int]:
    """Best-first matching of communities to reference ids; the rest take the smallest unused ids."""
    mapping: dict[int, int] = {}
    for overlap, label, ref in sorted(scored, reverse=True):
        if overlap > 0 and label not in mapping and ref not in mapping.values():
            mapping[label] = ref
    spare = iter(k for k in range(len(own) + len(refs)) if k not in set(mapping.values()))
    for label in sorted(own):
        if label not in mapping:
            mapping[label] = next(spare)
    return mapping


def align_labels(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """(country, label, aligned): labels renumbered to those of the reference they overlap most.

    The matching is one sequential pass over the pairs of communities, in one small group.
    """
    scored = jaccard_overlaps(labels, reference)
    rows = scored.select(F.lit("pair").alias("kind"), "label", "ref", "overlap")
    rows = rows.union(labels.select("label").distinct().select(F.lit("own"), "label", F.lit(None).cast("int"), F.lit(0.0)))
    rows = rows.union(reference.select("label").distinct().select(F.lit("ref"), "label", F.lit(None).cast("int"), F.lit(0.0)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf[pdf["kind"] == "pair"]
        scores = [(float(o), int(x), int(r)) for x, r, o in zip(pairs["label"], pairs["ref"], pairs["overlap"], strict=True)]
        found = greedy_alignment(scores, [int(x) for x in pdf.loc[pdf["kind"] == "own", "label"]], [int(x) for x in pdf.loc[pdf["kind"] == "ref", "label"]])
        return pd.DataFrame({"label": list(found), "aligned": list(found.values())})

    mapped = rows.groupBy(F.lit(1).alias("g")).applyInPandas(lambda pdf: one(pdf), "label int, aligned int")
    return labels.join(F.broadcast(mapped), "label").select("country", "label", "aligned")


def pair_distances(coords: DataFrame) -> DataFrame:
    """(a, b, km) for a < b of a small dimension (country, lon, lat)."""
    a, b = (coords.select(F.col("country").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}")) for s in "ab")
    km = haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return a.crossJoin(F.broadcast(b)).filter("a < b").select("a", "b", km.alias("km"))


def within_distance(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (km): mean distance of the pairs with one label."""
    la = labels.select(F.col("country").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("country").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a").join(lb, "b").filter("la = lb").agg(F.avg("km").alias("km"))


def compactness(spark: SparkSession, coords: DataFrame, labels: DataFrame, draws: int, seed: str) -> DataFrame:
    """(observed_km, expected_km, ratio, p_value): are communities closer together than relabelled ones?"""
    pairs = pair_distances(coords)
    known = labels.join(F.broadcast(coords.select("country")), "country", "left_semi")
    seen = within_distance(pairs, known).select(F.col("km").alias("observed_km"))
    drawn = relabelled(spark, known, draws, seed).crossJoin(F.broadcast(placed_ends(pairs, known, "a", "b")))
    null = drawn.filter(F.get("labels", F.col("pa")) == F.get("labels", F.col("pb"))).groupBy("draw").agg(F.avg("km").alias("km")).crossJoin(F.broadcast(seen))
    stats = null.agg(F.max("observed_km").alias("observed_km"), F.avg("km").alias("expected_km"), F.avg((F.col("km") <= F.col("observed_km")).cast("double")).alias("p_value"))
    return stats.withColumn("ratio", F.col("observed_km") / F.col("expected_km"))


def distance_to_own(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(country, km): mean distance to the peers of a node; without peers no row."""
    both = pairs.select("a", "b", "km").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "km"))
    la = F.broadcast(labels.select(F.col("country").alias("a"), F.col("label").alias("la")))
    lb = F.broadcast(labels.select(F.col("country").alias("b"), F.col("label").alias("lb")))
    return both.join(la, "a").join(lb, "b").filter("la = lb").groupBy(F.col("a").alias("country")).agg(F.avg("km").alias("km"))
