"""Theme labels, winner flags and their distributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyword_scores(text: pd.Series, keywords: dict[str, list[str]]) -> pd.DataFrame:
    """A deterministic stand-in for a zero-shot model: how often a theme's keywords occur, by word."""
    low = text.fillna("").str.lower()
    words = low.str.split().str.len().clip(lower=1)
    return pd.DataFrame({t: sum(low.str.count(rf"\b{k}\b") for k in ks) / words for t, ks in keywords.items()})


def classify(rows: DataFrame, text: str, themes: list[str], scorer: Callable[[pd.Series], pd.DataFrame], cut: int = 2500) -> DataFrame:
    """rows with ``scores`` (map of theme to score) by a pluggable scorer of text series, in Arrow batches."""

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            table = scorer(s.fillna("").str.slice(0, cut))
            yield pd.Series([dict(zip(themes, map(float, r), strict=True)) for r in table[themes].to_numpy()])

    return rows.withColumn("scores", score(F.col(text)))


def dominant(scores: Column, themes: list[str]) -> Column:
    """The theme with the highest score; the first listed on a tie. scores: array in the themes' order."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*map(F.lit, themes)), best)


def twelve_flags(songs: DataFrame, votes: DataFrame) -> DataFrame:
    """songs (year, country) with jury12 and public12: did it get a twelve from a jury or the public?"""
    twelves = votes.filter("points = 12").select("year", F.col("recipient").alias("country"), "points_type").distinct()
    flags = twelves.groupBy("year", "country").agg(
        F.max((F.col("points_type") == "jury").cast("int")).alias("jury12"), F.max((F.col("points_type") == "televote").cast("int")).alias("public12")
    )
    return songs.join(flags, ["year", "country"], "left").na.fill(0, ["jury12", "public12"])


def distribution(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """(grp, theme, n, pct) for all rows, winners and losers over a complete domain, zero slices dropped.

    rows: theme, is_winner; themes: theme.
    """
    groups = F.explode(F.array(F.lit("all"), F.when(F.col("is_winner"), "winners").otherwise("losers"))).alias("grp")
    counts = rows.select("theme", groups).groupBy("grp", "theme").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(themes.select("theme")))
    full = grid.join(counts, ["grp", "theme"], "left").na.fill(0, ["n"])
    return full.filter("n > 0").select("grp", "theme", "n", (100 * F.col("n") / F.col("total")).alias("pct"))
