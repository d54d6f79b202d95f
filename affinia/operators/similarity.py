"""Profiles, similarities and distances, all as long frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions.text import word_tokens
from affinia.operators.grids import eligible, rates


def profiles(votes: DataFrame, least: int = 4) -> DataFrame:
    """(voter, recipient, rate, centred): rates of eligible voters, less the recipient's mean over them."""
    own = rates(votes).join(F.broadcast(eligible(votes, least)), "voter", "left_semi")
    return own.select("voter", "recipient", "rate", (F.col("rate") - F.avg("rate").over(Window.partitionBy("recipient"))).alias("centred"))


def cosine_pairs(rows: DataFrame, node: str, dim: str, value: str) -> DataFrame:
    """(a, b, sim) for all pairs a < b of nodes; 0 for a zero row.

    Products come from an equi-join on the shared dimension; pairs without one are completed to 0.
    """
    own = rows.select(F.col(node).alias("node"), F.col(dim).alias("dim"), F.col(value).alias("x"))
    norms = own.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    left = own.withColumnsRenamed({"node": "a", "x": "xa"})
    right = own.withColumnsRenamed({"node": "b", "x": "xb"})
    dots = left.join(right, "dim").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    na, nb = norms.withColumnsRenamed({"node": "a", "norm": "na"}), norms.withColumnsRenamed({"node": "b", "norm": "nb"})
    pairs = na.crossJoin(F.broadcast(nb)).filter("a < b")
    sim = F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", sim.alias("sim"))


def jaccard_pairs(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(a, b, sim): Jaccard of the recipients a voter's rate reaches the threshold for; 0 for an empty union."""
    nodes = rows.select("voter").distinct()
    marked = rows.filter(F.col("rate") >= threshold).select("voter", "recipient")
    sizes = nodes.join(marked.groupBy("voter").agg(F.count(F.lit(1)).alias("n")), "voter", "left").na.fill(0, ["n"])
    a, b = sizes.withColumnsRenamed({"voter": "a", "n": "n_a"}), sizes.withColumnsRenamed({"voter": "b", "n": "n_b"})
    both = marked.withColumnRenamed("voter", "a").join(marked.withColumnRenamed("voter", "b"), "recipient").filter("a < b")
    both = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    sim = F.coalesce(F.try_divide(n.cast("double"), F.col("n_a") + F.col("n_b") - n), F.lit(0.0))
    return a.crossJoin(F.broadcast(b)).filter("a < b").join(both, ["a", "b"], "left").select("a", "b", sim.alias("sim"))


def distances(pairs: DataFrame) -> DataFrame:
    """(a, b, dist) in both directions: 1 - sim, not below 0."""
    dist = F.greatest(F.lit(0.0), 1 - F.col("sim")).alias("dist")
    rest = [c for c in pairs.columns if c not in ("a", "b", "sim")]
    one = pairs.select(*rest, "a", "b", dist)
    return one.union(one.select(*rest, F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


def _by_year(rows: DataFrame, kernel: Callable[[pa.Table], tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(year, a, b, sim) for all pairs a < b of a year's countries, from a matrix product for each year.

    kernel: a year's rows to (countries, rows of each, dot products, norms). Rows are shuffled once, neither their
    elements nor pairs are, and a task holds one year's entries at a time. A pair of countries comes as often as
    their rows meet.
    """
    year = rows.schema["year"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        with np.errstate(invalid="ignore"):
            countries, counts, dots, norms = kernel(table)
            i, j = (x.ravel() for x in np.meshgrid(*2 * [np.arange(len(countries))], indexing="ij"))
            known = np.array([c is not None for c in countries], bool)
            keep = (i < j) & known[i] & known[j]
            i, j = (np.repeat(x[keep], (counts[i] * counts[j])[keep]) for x in (i, j))
            size = norms[i] * norms[j]
            sim = np.divide(dots[i, j], size, out=np.zeros(len(i)), where=size != 0)
        names = pa.array(countries, pa.string())
        return pa.table({"year": table["year"].take(pa.array(np.zeros(len(i), int))), "a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "sim": sim})

    return rows.filter("year IS NOT NULL").groupBy("year").applyInArrow(one, f"year {year}, a string, b string, sim double")


def _nodes(countries: pa.ChunkedArray) -> tuple[list[str | None], np.ndarray]:
    """Distinct countries in order, a null last, and the place of each row's."""
    own = countries.to_pylist()
    names = sorted(set(own), key=lambda c: (c is None, c))
    places = {c: k for k, c in enumerate(names)}
    return names, np.array([places[c] for c in own], int)


def _cells(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place in the list and value of all elements of a column of lists."""
    lists = lists.combine_chunks()
    row = pc.list_parent_indices(lists).to_numpy().astype(int)
    sizes = np.bincount(row, minlength=len(lists))
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), pc.list_flatten(lists)


def _theme_kernel(table: pa.Table) -> tuple:
    row, dim, values = _cells(table["themes"])
    there, row = np.unique(row, return_inverse=True)  # entries without themes have no pairs
    names, node = _nodes(table["country"].take(pa.array(there)))
    x = np.zeros((len(there), int(dim.max(initial=-1)) + 1))
    has = np.zeros(x.shape, bool)
    x[row, dim], has[row, dim] = values.to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
    n = np.maximum(has.sum(axis=0), 1)
    x = np.where(has, x - x[has.argmax(axis=0), np.arange(x.shape[1])], 0.0) if len(x) else x  # equal values have no spread
    x = np.where(has, x - x.sum(axis=0) / n, 0.0)
    spread = np.sqrt((x * x).sum(axis=0) / n)
    x = x / np.where(spread <= 0, 1.0, spread)
    z, m = np.zeros((len(names), x.shape[1])), np.zeros((len(names), x.shape[1]))
    np.add.at(z, node, x)
    np.add.at(m, node, has)
    z = z / np.maximum(m, 1)
    return names, np.ones(len(names), int), z @ z.T, np.sqrt((z * z).sum(axis=1))


def theme_similarity(entries: DataFrame) -> DataFrame:
    """(year, a, b, sim): cosine of theme vectors after each theme is standardised within its year; a country's
    vectors are averaged."""
    return _by_year(entries.select("year", "country", "themes"), _theme_kernel)


def tfidf_similarity(entries: DataFrame, least_df: int = 2) -> DataFrame:
    """(year, a, b, sim): cosine of TF-IDF vectors, fitted by year: (1 + ln tf) * (ln((1 + n)/(1 + df)) + 1)."""

    def kernel(table: pa.Table) -> tuple:
        names, node = _nodes(table["country"])
        row, _, words = _cells(pc.split_pattern(table["words"], " "))
        coded = words.dictionary_encode()
        cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + node[row], return_counts=True)
        term, at = cells // len(names), cells % len(names)  # terms in order
        df = np.bincount(term, minlength=len(coded.dictionary))
        keep = (df >= least_df) & (pc.utf8_length(coded.dictionary).to_numpy() > 0)  # a text without words is one empty word
        df, term, at, tf = df[keep], (np.cumsum(keep) - 1)[term[keep[term]]], at[keep[term]], tf[keep[term]]
        w = (1 + np.log(tf)) * (np.log((1 + len(table)) / (1 + df[term])) + 1)
        dots = np.zeros((len(names), len(names)))
        for first in range(0, len(df), 4096):
            low, high = np.searchsorted(term, (first, first + 4096))
            x = np.zeros((len(names), min(4096, len(df) - first)))
            x[at[low:high], term[low:high] - first] = w[low:high]
            dots += x @ x.T
        return names, np.bincount(node, minlength=len(names)), dots, np.sqrt(np.diag(dots))

    words = F.array_join(word_tokens(F.col("lyrics")), " ").alias("words")  # tokens hold no space
    return _by_year(entries.select("year", "country", words), kernel)


def language_flags(entries: DataFrame) -> DataFrame:
    """(year, a, b, shared_language, shared_non_english) as 0.0 or 1.0."""
    from affinia.functions.text import parse_languages

    own = entries.select("year", "country", parse_languages(F.col("language")).alias("langs"))
    a, b = own.withColumnsRenamed({"country": "a", "langs": "la"}), own.withColumnsRenamed({"country": "b", "langs": "lb"})
    common = F.array_intersect("la", "lb")
    return a.join(b, "year").filter("a < b").select(
        "year", "a", "b", (F.size(common) > 0).cast("double").alias("shared_language"),
        (F.size(F.array_except(common, F.array(F.lit("english")))) > 0).cast("double").alias("shared_non_english"),
    )


def vector_duplication(rows: DataFrame, by: str, vector: str, places: int = 6) -> DataFrame:
    """By group: entries, distinct vectors (rounded), share in a duplicate group, largest such group."""
    key = F.transform(vector, lambda x: F.round(x, places) + 0.0)
    sizes = rows.groupBy(by, key.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(by).agg(
        F.sum("n").alias("n_entries"),
        F.count(F.lit(1)).alias("n_unique_vectors"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_in_duplicate_group"),
        F.max("n").alias("largest_duplicate_group"),
    )
