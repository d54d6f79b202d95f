"""Resampling inference over dyad panels.

Statistics are linear in sums and counts by (voter, recipient), so panels are collapsed to these before
they meet the draws, and don't grow with the number of years. A draw is one row with an array by node, which
meets the broadcast dyads (nodes squared at most) and is summed up where it is: nothing but sums is shuffled.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia.functions.hashing import draws, key, placed_ends, relabelled, resampled


def collapsed(panel: DataFrame, *values: str) -> DataFrame:
    return panel.groupBy("voter", "recipient").agg(*(F.sum(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def difference(value: str, same: Column, weight: str | Column = "n") -> Column:
    """Weighted mean of a value sum within less that between; null if a side is empty."""
    w = F.col(weight) if isinstance(weight, str) else weight
    mean = lambda cond: F.try_divide(F.sum(F.when(cond, F.col(value))), F.sum(F.when(cond, w)))
    return mean(same) - mean(~same)


def observed(panel: DataFrame, *values: str) -> DataFrame:
    """One row (value, observed) for each value column."""
    own = panel.groupBy("same").agg(*(F.sum(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
    wide = own.agg(*(difference(v, F.col("same")).alias(v) for v in values))
    return wide.unpivot([], list(values), "value", "observed")


def _drawn(drawn: DataFrame, dyads: DataFrame, labels: DataFrame) -> DataFrame:
    return drawn.crossJoin(F.broadcast(placed_ends(dyads, labels)))


def _same() -> Column:
    return F.get("labels", F.col("pa")) == F.get("labels", F.col("pb"))


def label_null(spark: SparkSession, panel: DataFrame, labels: DataFrame, n: int, seed: str, *values: str) -> DataFrame:
    """(draw, values...): the statistic under relabelled countries."""
    own = _drawn(relabelled(spark, labels, n, seed), collapsed(panel, *values), labels)
    own = own.select("draw", *values, "n", _same().alias("same"))
    return own.groupBy("draw").agg(*(difference(v, F.col("same")).alias(v) for v in values))


def _dispersion(rows: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """(keys..., sd): count-weighted SD of the labels' own means; null with under two labels."""
    means = rows.groupBy(*keys, "label").agg(F.sum(value).alias("s"), F.sum("n").alias("n")).filter(F.col("n") >= least)
    means = means.withColumn("m", F.col("s") / F.col("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    centred = means.withColumn("g", F.sum("s").over(w) / F.sum("n").over(w))
    sd = F.sqrt(F.sum(F.pow(F.col("m") - F.col("g"), 2) * F.col("n")) / F.sum("n"))
    return centred.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, sd).alias("sd"))


def dispersion(panel: DataFrame, value: str = "gap", least: int = 1) -> DataFrame:
    own = panel.filter("same").groupBy(F.col("from_label").alias("label")).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    return _dispersion(own, [], value, least)


def dispersion_null(spark: SparkSession, panel: DataFrame, labels: DataFrame, n: int, seed: str, value: str = "gap", least: int = 1) -> DataFrame:
    own = _drawn(relabelled(spark, labels, n, seed), collapsed(panel, value), labels).filter(_same())
    own = own.select("draw", F.get("labels", F.col("pa")).alias("label"), value, "n")
    return _dispersion(own, ["draw"], value, least).filter("sd IS NOT NULL")


def dispersion_test(spark: SparkSession, panel: DataFrame, labels: DataFrame, n: int, seed: str, value: str = "gap", least: int = 1) -> DataFrame:
    """(observed, null_mean, p_value, n_draws) of the dispersion against relabelled countries."""
    seen = F.broadcast(dispersion(panel, value, least).select(F.col("sd").alias("o")))
    null = dispersion_null(spark, panel, labels, n, seed, value, least).crossJoin(seen)
    p = upper_p(F.round("sd", 9), F.round("o", 9))
    return null.agg(F.max("o").alias("observed"), F.avg("sd").alias("null_mean"), p.alias("p_value"), F.count("sd").alias("n_draws"))


def quantities(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """(quantity, value) of one row: what each quantity is called, and its column."""
    pairs = F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(c).cast("double").alias("value")) for q, c in names.items()))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def naive_null(spark: SparkSession, panel: DataFrame, n: int, seed: str, value: str = "gap") -> DataFrame:
    """(draw, stat): rows are shuffled, which ignores how dyads depend on each other."""
    rows = panel.select(F.concat_ws("|", F.col("year").cast("string"), "voter", "recipient").alias("row"), value, "same")
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("row")))
    drawn = draws(spark, n).crossJoin(F.broadcast(rows.select("row", "same")))
    order = Window.partitionBy("draw").orderBy(key(seed, F.col("draw"), F.col("row")))
    drawn = drawn.select("draw", F.col("same").alias("s"), F.row_number().over(order).alias("place"))
    own = drawn.join(F.broadcast(rows.select("place", value)), "place")
    return own.groupBy("draw").agg((F.avg(F.when(F.col("s"), F.col(value))) - F.avg(F.when(~F.col("s"), F.col(value)))).alias("stat"))


def node_bootstrap(spark: SparkSession, panel: DataFrame, labels: DataFrame, n: int, seed: str, value: str = "gap") -> DataFrame:
    """(draw, stat): countries are drawn with replacement, a dyad counts as often as both ends."""
    own_labels = F.broadcast(labels.select("country", "label"))
    dyads = collapsed(panel, value)
    for side, name in (("voter", "la"), ("recipient", "lb")):
        dyads = dyads.join(own_labels.select(F.col("country").alias(side), F.col("label").alias(name)), side)
    own = _drawn(resampled(spark, labels, n, seed), dyads, labels)
    times = F.get("times", F.col("pa")) * F.get("times", F.col("pb"))
    own = own.select("draw", (F.col("la") == F.col("lb")).alias("same"), (F.col(value) * times).alias("x"), (F.col("n") * times).alias("w"))
    return own.groupBy("draw").agg(difference("x", F.col("same"), "w").alias("stat")).filter("stat IS NOT NULL")


def interval(stats: DataFrame, column: str = "stat", low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = lambda p: F.percentile(F.col(column), p)
    return stats.agg(q(low).alias("ci_low"), q(high).alias("ci_high"), F.count(F.lit(1)).alias("n_draws"))


def two_sided_p(stat: Column, seen: Column) -> Column:
    return (F.count_if(F.abs(stat) >= F.abs(seen)) + 1) / (F.count(stat) + 1)


def upper_p(stat: Column, seen: Column) -> Column:
    return (F.count_if(stat >= seen) + 1) / (F.count(stat) + 1)


def permutation_test(null: DataFrame, seen: DataFrame, value: str, power: float = 2.8) -> DataFrame:
    """(observed, null_sd, z, p_value, mde) of a null column and a frame with the observed value."""
    rows = null.select(F.round(value, 9).alias("x")).crossJoin(F.broadcast(seen.select(F.round("observed", 9).alias("seen"))))
    out = rows.agg(F.max("seen").alias("observed"), F.stddev_samp("x").alias("null_sd"), two_sided_p(F.col("x"), F.col("seen")).alias("p_value"))
    return out.withColumns({"z": F.try_divide("observed", "null_sd"), "mde": power * F.col("null_sd")})


def cliffs_delta(panel: DataFrame, value: str = "gap") -> DataFrame:
    """P(within > between) - P(within < between), from cumulative counts of the distinct values."""
    counts = panel.groupBy(value).agg(F.count_if("same").alias("n1"), F.count_if(~F.col("same")).alias("n2"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("n2").over(w), F.lit(0)))
    return below.agg(
        F.sum("n1").alias("n_within"), F.sum("n2").alias("n_between"),
        (2 * F.sum(F.col("n1") * (F.col("below") + F.col("n2") / 2)) / (F.sum("n1") * F.sum("n2")).cast("double") - 1).alias("delta"),
    )


def group_summary(panel: DataFrame, top: float = 10.0) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return panel.groupBy(F.when(F.col("same"), "within_bloc").otherwise("between_bloc").alias("group")).agg(
        F.count(F.lit(1)).alias("n_pair_years"), F.avg("jury").alias("mean_jury"), F.avg("tele").alias("mean_televote"), F.avg("gap").alias("mean_gap"),
        F.median("gap").alias("median_gap"), F.stddev_samp("gap").alias("sd_gap"), share(F.col("gap") != 0).alias("share_nonzero"),
        share(F.col("jury") >= top).alias("share_jury_top"), share(F.col("tele") >= top).alias("share_televote_top"),
    )


def bloc_breakdown(panel: DataFrame, labels: DataFrame) -> DataFrame:
    members = labels.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("country")), ", ").alias("members"))
    own = panel.filter("same").groupBy(F.col("from_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n_dyad_years"), F.avg("jury").alias("mean_jury"), F.avg("tele").alias("mean_televote"), F.avg("gap").alias("mean_gap")
    )
    return own.join(F.broadcast(members), "label")


def yearly_breakdown(panel: DataFrame) -> DataFrame:
    same = F.col("same")
    out = panel.groupBy("year").agg(
        F.count_if(same).alias("n_within"), F.count_if(~same).alias("n_between"),
        F.avg(F.when(same, F.col("gap"))).alias("mean_gap_within"), F.avg(F.when(~same, F.col("gap"))).alias("mean_gap_between"),
    )
    return out.withColumn("t", F.col("mean_gap_within") - F.col("mean_gap_between"))


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def with_student_p(rows: DataFrame, t: str = "t", n: str = "n") -> DataFrame:
    """rows with ``p_value`` of a paired test; the distinct (t, n) are few, one for each test."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else student_t_two_sided(x, k - 1) for x, k in zip(t, n, strict=True)], dtype="float64")

    return rows.withColumn("p_value", p(t, n))
