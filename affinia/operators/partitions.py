"""Agreement of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def agreement(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, ari, nmi) of contingency counts (a, b, n).

    Two equal trivial partitions have ARI 1 and NMI 1; one trivial partition has both 0.
    """
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    total = cells.withColumn("total", F.sum("n").over(over))

    def side(x: str) -> DataFrame:
        own = total.groupBy(*keys, x).agg(F.sum("n").alias("m"), F.max("total").alias("total"))
        p = F.col("m") / F.col("total")
        return own.groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias(f"pairs_{x}"), F.sum(-p * F.log(p)).alias(f"h_{x}"), F.count(F.lit(1)).alias(f"k_{x}"))

    na = cells.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    nb = cells.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    p = F.col("n") / F.col("total")
    mi = total.join(na, [*keys, "a"]).join(nb, [*keys, "b"]).groupBy(*keys).agg(
        F.max("total").alias("n"), F.sum(_pairs(F.col("n"))).alias("pairs"), F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi")
    )
    both = mi
    for x in ("a", "b"):
        both = both.join(side(x), list(keys)) if keys else both.crossJoin(F.broadcast(side(x)))
    expected = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), _pairs(F.col("n")))
    top, low = F.col("pairs") - expected, (F.col("pairs_a") + F.col("pairs_b")) / 2 - expected
    trivial = (F.col("k_a") == 1) & (F.col("k_b") == 1) | (F.col("k_a") == F.col("n")) & (F.col("k_b") == F.col("n"))
    ari = F.when(trivial, 1.0).otherwise(F.coalesce(F.try_divide(top, low), F.lit(0.0)))
    nmi = F.when((F.col("k_a") == 1) & (F.col("k_b") == 1), 1.0).otherwise(F.coalesce(F.try_divide("mi", (F.col("h_a") + F.col("h_b")) / 2), F.lit(0.0)))
    return both.select(*keys, "n", ari.alias("ari"), nmi.alias("nmi"))


def majority(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., a, major, n_major, n_a): the most common b of each a, the smallest on a tie."""
    w = Window.partitionBy(*keys, "a")
    own = cells.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), "b")), "n_a": F.sum("n").over(w)})
    return own.filter("rn = 1").select(*keys, "a", F.col("b").alias("major"), F.col("n").alias("n_major"), "n_a")


def purity(cells: DataFrame, *keys: str) -> DataFrame:
    return majority(cells, *keys).groupBy(*keys).agg((F.sum("n_major") / F.sum("n_a")).alias("purity"))


def misfits(rows: DataFrame, item: str, a: str, b: str, *keys: str) -> DataFrame:
    """Items whose b isn't the majority of their a."""
    major = majority(contingency(rows, a, b, *keys), *keys).withColumnRenamed("a", a)
    return rows.join(F.broadcast(major), [*keys, a]).filter(F.col(b) != F.col("major")).select(*keys, item)


def crosstab_melted(rows: DataFrame, a: str, b: str, b_values: list) -> DataFrame:
    """Wide contingency table and back to (a, b, n), zero cells dropped."""
    wide = rows.groupBy(a).pivot(b, b_values).count().na.fill(0)
    return wide.unpivot([a], [str(v) for v in b_values], b, "n").filter("n > 0")
