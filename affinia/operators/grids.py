"""Completed grids: what is absent inside a grid is a true zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def countries(votes: DataFrame) -> DataFrame:
    """All voters and recipients."""
    return votes.select(F.col("voter").alias("country")).union(votes.select(F.col("recipient"))).distinct()


def voting_editions(votes: DataFrame) -> DataFrame:
    """(voter, editions): distinct years in which a voter voted."""
    return votes.groupBy("voter").agg(F.count_distinct("year").alias("editions"))


def eligible(votes: DataFrame, least: int = 4) -> DataFrame:
    return voting_editions(votes).filter(F.col("editions") >= least).select("voter")


def totals(votes: DataFrame, *extra: str) -> DataFrame:
    return votes.groupBy(*extra, "voter", "recipient").agg(F.sum("points").alias("points"))


def square(dim: DataFrame, *names: str) -> DataFrame:
    """Ordered pairs of a small dimension (country), itself included."""
    a, b = names or ("voter", "recipient")
    return dim.select(F.col("country").alias(a)).crossJoin(F.broadcast(dim.select(F.col("country").alias(b))))


def points_matrix(votes: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(voter, recipient, points) over all pairs of countries."""
    dim = countries(votes) if dim is None else dim
    return square(dim).join(totals(votes), ["voter", "recipient"], "left").na.fill(0.0, ["points"])


def opportunity(votes: DataFrame) -> DataFrame:
    """(voter, recipient, n): editions in which one voted and the other stood to receive."""
    cast = votes.select("year", "voter").distinct()
    stood = votes.select("year", "recipient").distinct()
    return cast.join(stood, "year").filter("voter <> recipient").groupBy("voter", "recipient").agg(F.count(F.lit(1)).alias("n"))


def rates(votes: DataFrame) -> DataFrame:
    """(voter, recipient, n, rate): points by shared edition."""
    own = opportunity(votes).join(totals(votes), ["voter", "recipient"], "left")
    return own.select("voter", "recipient", "n", (F.coalesce("points", F.lit(0.0)) / F.col("n")).alias("rate"))


def group_grid(votes: DataFrame, *keys: str) -> DataFrame:
    """Voters x recipients of each group, less the diagonal: an equi-join on the group."""
    keys = keys or ("year",)
    cast = votes.select(*keys, "voter").distinct()
    stood = votes.select(*keys, "recipient").distinct()
    return cast.join(stood, list(keys)).filter("voter <> recipient")


def kind_sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("points_type") == kind, F.col("points"))), F.lit(0.0))


def gap_panel(votes: DataFrame, labels: DataFrame, top: float = 10.0) -> DataFrame:
    """Dyad panel of the split ballots: jury, tele, gap, top_gap, labels of both ends, same.

    Dyads of an unlabelled country are dropped.
    """
    per_kind = votes.groupBy("year", "voter", "recipient").agg(kind_sum("jury").alias("jury"), kind_sum("televote").alias("tele"))
    panel = group_grid(votes).join(per_kind, ["year", "voter", "recipient"], "left").na.fill(0.0, ["jury", "tele"])
    for side, name in (("voter", "from_label"), ("recipient", "to_label")):
        panel = panel.join(F.broadcast(labels.select(F.col("country").alias(side), F.col("label").alias(name))), side)
    top_gap = (F.col("jury") >= top).cast("double") - (F.col("tele") >= top).cast("double")
    return panel.select(
        "year", "voter", "recipient", "jury", "tele", (F.col("jury") - F.col("tele")).alias("gap"), top_gap.alias("top_gap"),
        "from_label", "to_label", (F.col("from_label") == F.col("to_label")).alias("same"),
    )


def interactions(votes: DataFrame) -> DataFrame:
    """Cells of every ballot: grid by (year, points_type), zeros filled, with the keys of entry, ballot and
    voter-year."""
    grid = group_grid(votes, "year", "points_type")
    cells = grid.join(totals(votes, "year", "points_type"), ["year", "points_type", "voter", "recipient"], "left").na.fill(0.0, ["points"])
    year = F.col("year").cast("string")
    return cells.select(
        "year", "points_type", "voter", "recipient", "points", F.concat_ws(" ", year, "recipient").alias("entry"),
        F.concat_ws(" ", year, "points_type", "voter").alias("ballot"), F.concat_ws(" ", year, "voter").alias("voter_year"),
    )


def net_relations(votes: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(voter, recipient, net): points given less points got back."""
    m = points_matrix(votes, dim)
    back = m.select(F.col("recipient").alias("voter"), F.col("voter").alias("recipient"), F.col("points").alias("back"))
    return m.join(back, ["voter", "recipient"]).select("voter", "recipient", (F.col("points") - F.col("back")).alias("net"))


def kind_difference(votes: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(country, jury, televote, diff) of what each country received."""
    dim = countries(votes) if dim is None else dim
    got = votes.groupBy(F.col("recipient").alias("country")).agg(kind_sum("jury").alias("jury"), kind_sum("televote").alias("televote"))
    return dim.join(got, "country", "left").na.fill(0.0).withColumn("diff", F.col("jury") - F.col("televote"))


def split_years(votes: DataFrame) -> DataFrame:
    """Years with jury and televote ballots."""
    found = votes.groupBy("year").agg(*(F.max((F.col("points_type") == k).cast("int")).alias(k) for k in ("jury", "televote")))
    return found.filter("jury = 1 AND televote = 1").select("year")
