"""Cleaning of votes and normalisation of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.functions.text import lookup, squeezed, title_case
from affinia.sources.tables import VALID_POINTS

# Spellings and what they stand for.
SPELLINGS = {
    "aerbaijan": "Azerbaijan",
    "azerbaijan": "Azerbaijan",
    "united kingdom": "United Kingdom",
    "sweeden": "Sweden",
    "sweden": "Sweden",
    "bosnia": "Bosnia and Herzegovina",
    "bosnia and herzegovina": "Bosnia and Herzegovina",
}
ONE_SPELLING = {
    "Czech-Republic": "Czech Republic",
    "San-Marino": "San Marino",
    "The-Netherlands": "Netherlands",
    "The Netherlands": "Netherlands",
    "United-Kingdom": "United Kingdom",
    "Bosnia & Herzegovina": "Bosnia and Herzegovina",
    "Serbia & Montenegro": "Serbia and Montenegro",
}
#: As ONE_SPELLING, but for graph nodes, which keep the article.
NODE_SPELLING = {k: ("The Netherlands" if v == "Netherlands" else v) for k, v in ONE_SPELLING.items() if k != "The Netherlands"}
KINDS = ["combined", "jury", "televote"]
KEY = ["edition", "year", "points_type", "voter", "recipient", "points"]


def country_name(x: Column) -> Column:
    """White space squeezed, known spellings mapped, else title case; null is empty."""
    own = squeezed(x)
    return lookup(SPELLINGS, own, title_case(own))


def harmonised(x: Column) -> Column:
    return lookup(ONE_SPELLING, x, x)


def node_name(x: Column) -> Column:
    return lookup(NODE_SPELLING, x, x)


def unhyphenated(x: Column) -> Column:
    return F.replace(x, F.lit("-"), F.lit(" "))


def points_group(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.contains("jury"), "Jury").when(low.contains("televote"), "Public").otherwise("Other")


def clean_votes(raw: DataFrame, names: bool = True, kinds: list[str] = KINDS) -> DataFrame:
    """The vote fact of raw votes (edition, year, points_type, voter, recipient, points; any types).

    In this order: year and points that are no numbers drop the row; names are normalised (with ``names``);
    blank names and votes for oneself go; points and kinds outside their sets go; equal rows count once.
    The same key with different points stays, and is summed later on.
    """
    name = country_name if names else (lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rows = raw.select(
        F.col("edition").cast("string").alias("edition"),
        F.expr("try_cast(try_cast(year AS double) AS int)").alias("year"),
        F.trim(F.col("points_type").cast("string")).alias("points_type"),
        name(F.col("voter")).alias("voter"),
        name(F.col("recipient")).alias("recipient"),
        F.expr("try_cast(points AS double)").alias("points"),
    )
    rows = rows.na.drop(subset=["year", "points"]).filter((F.col("voter") != "") & (F.col("recipient") != ""))
    rows = rows.filter(F.col("voter") != F.col("recipient")).filter(F.col("points").isin(VALID_POINTS))
    return rows.filter(F.col("points_type").isin(kinds)).dropDuplicates(KEY)


def in_window(votes: DataFrame, first: int, last: int, kinds: list[str] | None = None) -> DataFrame:
    """Votes of the years from first to last, of some kinds."""
    rows = votes.filter(F.col("year").between(first, last))
    return rows.filter(F.col("points_type").isin(kinds)) if kinds else rows


def ordered_unique(raw: DataFrame, value: str, place: str) -> DataFrame:
    """Normalised names of a list in the order of their first mention, blanks left out."""
    named = raw.select(country_name(F.col(value)).alias("name"), F.col(place).alias("place")).filter("name <> ''")
    return named.groupBy("name").agg(F.min("place").alias("place"))
