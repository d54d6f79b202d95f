"""Readers and writers, and the adapter from order lines to ballots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.functions.text import lookup

#: The points a ballot may give, and the kinds of ballots.
VALID_POINTS = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0]
KINDS = {"N": "combined", "A": "jury", "R": "televote"}
FIRST_YEAR, SPLIT_YEAR, LAST_YEAR = 1995, 1998, 2001

VOTES_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("edition", "year", "points_type", "voter", "recipient", "points")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, all text unless a schema is given; an index column without a name goes."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.drop(*[c for c in df.columns if c.strip() in ("", "_c0", "Unnamed: 0")])


def read_votes(spark: SparkSession, paths: list[str], schema: T.StructType = VOTES_SCHEMA) -> DataFrame:
    """Vote files of one schema, put together before they are cleaned."""
    frames = [read_csv(spark, p, schema) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_labels(spark: SparkSession, path: str, label: str = "label", country: str = "country") -> DataFrame:
    """(country, label) of a file of labels; rows without a number as the label go."""
    df = read_csv(spark, path)
    return df.select(F.col(country).alias("country"), F.expr(f"try_cast(`{label}` AS int)").alias("label")).filter("label IS NOT NULL")


def read_window_labels(spark: SparkSession, paths: dict[str, str], label: str = "label") -> DataFrame:
    """(window, country, label) of one file of labels for each window."""
    return stacked(*(read_labels(spark, path, label).select(F.lit(w).alias("window"), "country", "label") for w, path in paths.items()))


def read_long_labels(spark: SparkSession, path: str, window: str = "window", label: str = "label", names: dict[str, str] | None = None) -> DataFrame:
    """(window, country, label) of one file for all windows; names are replaced as given, so that files agree."""
    df = read_csv(spark, path)
    country = lookup(names, F.col("country"), F.col("country")) if names else F.col("country")
    return df.select(F.col(window).alias("window"), country.alias("country"), F.expr(f"try_cast(`{label}` AS int)").alias("label")).filter("label IS NOT NULL")


def read_wide_features(spark: SparkSession, path: str, first: int) -> DataFrame:
    """A CSV file whose columns from number ``first`` on (0-based) become one array column ``features``."""
    df = read_csv(spark, path)
    names = df.columns[first:]
    return df.select(*df.columns[:first], F.array(*[F.expr(f"try_cast(`{c}` AS double)") for c in names]).alias("features"))


def read_json_map(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A JSON object of id to record: one row (id, fields...) each."""
    lines = spark.read.text(path, wholetext=True)
    parsed = lines.select(F.explode(F.from_json("value", f"map<string, struct<{record}>>")).alias("id", "r"))
    return parsed.select("id", "r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matrix_csv(long: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """A long frame as one wide CSV file; the column values must be a small dimension."""
    names = [r[0] for r in long.select(column).distinct().orderBy(column).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("too many columns for a wide file")
    write_csv(long.groupBy(row).pivot(column, names).agg(F.first(value)).orderBy(row).coalesce(1), path)


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def points_type(flag: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(flag == k, v).otherwise(out)
    return out


def raw_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as votes: the customer's nation gives the supplier's nation l_quantity points.

    Valid points are a pushed-down filter of the scan. Nations are a dimension of a fixed size.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    lines = lines.filter(F.col("l_quantity").isin(VALID_POINTS))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    voters = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("voter"))
    recipients = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("recipient"))
    cast = orders.join(customers.join(voters, "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(suppliers.join(recipients, "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(cast, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.col("year").cast("string"), F.lit("f")).alias("edition"),
        "year",
        points_type(F.col("l_returnflag")).alias("points_type"),
        "voter",
        "recipient",
        F.col("l_quantity").alias("points"),
    )


def labels(spark: SparkSession, sf_dir: str, kind: str = "region") -> DataFrame:
    """(country, label): the region of each nation, or its key modulo 3."""
    nation = table(spark, sf_dir, "nation")
    label = F.col("n_regionkey") if kind == "region" else F.col("n_nationkey") % 3
    return nation.select(F.col("n_name").alias("country"), label.cast("int").alias("label"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, lon, lat) of the nations that geography counts."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(k != 0).select(
        F.col("n_name").alias("country"), (-20 + (k * 37) % 65).cast("double").alias("lon"), (35 + (k * 17) % 30).cast("double").alias("lat")
    )


def entries(spark: SparkSession, sf_dir: str, years: DataFrame | None = None) -> DataFrame:
    """(year, country, lyrics, language, themes): each document is the entry of a nation in a year.

    Years go on as long as there are documents, 25 a year, so that keys are unique and no year grows; those
    beyond LAST_YEAR have no ballots. Vectors, whose ids count up from 0, are dealt to the documents in turn.
    years (year), a small frame: entries of other years go before texts and vectors meet.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vectors = vectors.agg((F.max("vec_id") + 1).alias("n_vectors"))
    year = (FIRST_YEAR + F.floor(F.col("doc_id") / 25)).cast("int")
    language = F.concat(F.initcap("lang"), F.when(F.col("doc_id") % 3 == 0, "/English (live)").otherwise(" (studio)"))
    rows = docs.select("doc_id", year.alias("year"), (F.col("doc_id") % 25).alias("n_nationkey"), F.col("text").alias("lyrics"), language.alias("language"))
    if years is not None:
        rows = rows.join(F.broadcast(years.select("year").distinct()), "year", "left_semi")
    rows = rows.crossJoin(F.broadcast(n_vectors)).withColumn("vec_id", F.col("doc_id") % F.col("n_vectors"))
    return rows.join(F.broadcast(nation), "n_nationkey").join(vectors, "vec_id").select(
        "year", "country", "lyrics", "language", F.transform("embedding", lambda x: x.cast("double")).alias("themes")
    )
