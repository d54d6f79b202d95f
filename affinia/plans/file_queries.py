"""Queries through files: each writes tables in the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.functions.render import report_lines, write_lines
from affinia.operators import clean, grids, recommend
from affinia.plans.base import BALLOTS, COUNTRIES, ballots, query
from affinia.sources import tables
from affinia.sources.shared import scratch


@query("q76_votes_files", f"WITH {BALLOTS} SELECT * FROM ballots")
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in a base file and an extension file, put together and cleaned."""
    votes, paths = ballots(spark, sf_dir), []
    for name, part in (("base", "year < 1999"), ("extension", "year >= 1999")):
        paths.append(scratch(spark, f"votes-{name}"))
        tables.write_csv(votes.filter(part), paths[-1])
    return clean.clean_votes(tables.read_votes(spark, paths), names=False)


@query("q76_votes_base_file", f"WITH {BALLOTS} SELECT * FROM ballots WHERE year BETWEEN 1996 AND 2000")
def q76_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of one file, cleaned and cut to years."""
    path = scratch(spark, "votes")
    tables.write_csv(ballots(spark, sf_dir), path)
    return clean.in_window(clean.clean_votes(tables.read_votes(spark, [path]), names=False), 1996, 2000, None)


@query(
    "q76_votes_nodes",
    f"""WITH {BALLOTS}, first AS (SELECT min(n_name) AS a, max(n_name) AS z FROM nation),
r AS (SELECT CASE x WHEN a THEN 'The Netherlands' WHEN z THEN 'Bosnia and Herzegovina' ELSE x END AS node, x FROM (SELECT n_name AS x FROM nation), first)
SELECT v.node AS voter, w.node AS recipient, sum(points) AS points FROM ballots JOIN r v ON v.x = voter JOIN r w ON w.x = recipient GROUP BY ALL""",
)
def q76_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of all years, under the names that graphs have of the file's spellings."""
    first = tables.table(spark, sf_dir, "nation").agg(F.min("n_name").alias("a"), F.max("n_name").alias("z"))
    spelled = lambda c: F.when(F.col(c) == F.col("a"), "The-Netherlands").when(F.col(c) == F.col("z"), "Bosnia & Herzegovina").otherwise(F.col(c))
    path = scratch(spark, "votes")
    tables.write_csv(ballots(spark, sf_dir).crossJoin(F.broadcast(first)).withColumns({c: spelled(c) for c in ("voter", "recipient")}).drop("a", "z"), path)
    votes = clean.clean_votes(tables.read_votes(spark, [path]), names=False)
    return votes.groupBy(clean.node_name(F.col("voter")).alias("voter"), clean.node_name(F.col("recipient")).alias("recipient")).agg(F.sum("points").alias("points"))


@query(
    "q77_matrix_file",
    f"WITH {BALLOTS}, {COUNTRIES} SELECT a.country AS voter, b.country AS recipient, coalesce(sum(points), 0.0) AS points FROM countries a CROSS JOIN countries b LEFT JOIN ballots ON voter = a.country AND recipient = b.country GROUP BY ALL",
)
def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points matrix as a wide file, and long again."""
    path = scratch(spark, "matrix")
    tables.write_matrix_csv(grids.points_matrix(ballots(spark, sf_dir)), path, "voter", "recipient", "points")
    wide = tables.read_csv(spark, path)
    names = [c for c in wide.columns if c != "voter"]
    return wide.unpivot(["voter"], names, "recipient", "p").select("voter", "recipient", F.expr("try_cast(p AS double)").alias("points"))


@query(
    "q78_label_files",
    """SELECT 'one' AS window, n_name AS country, n_regionkey AS label FROM nation UNION ALL SELECT 'three', n_name, CAST(n_nationkey % 3 AS INTEGER) FROM nation
UNION ALL SELECT 'long full', CASE n_name WHEN 'UNITED KINGDOM' THEN 'UK' ELSE n_name END, n_regionkey FROM nation UNION ALL SELECT 'long other', CASE n_name WHEN 'UNITED KINGDOM' THEN 'UK' ELSE n_name END, CAST(n_nationkey % 3 AS INTEGER) FROM nation""",
)
def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in a file for each window, and in one file for all of them with other names."""
    own = {w: tables.labels(spark, sf_dir, kind) for w, kind in (("one", "region"), ("three", "key"))}
    paths = {w: scratch(spark, f"labels-{w}") for w in own}
    for w, df in own.items():
        tables.write_csv(df, paths[w])
    apart = tables.read_window_labels(spark, paths)
    path = scratch(spark, "labels-long")
    tables.write_csv(tables.stacked(*(df.select(F.lit(w).alias("graph"), "country", "label") for w, df in zip(("long full", "long other"), own.values(), strict=True))), path)
    return apart.unionByName(tables.read_long_labels(spark, path, "graph", "label", {"UNITED KINGDOM": "UK"}))


@query("q79_wide_feature_file", "SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding[1:12]] AS features FROM embeddings")
def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in the columns of a wide file from a number on."""
    path = scratch(spark, "features")
    rows = tables.table(spark, sf_dir, "embeddings")
    tables.write_csv(rows.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(12))), path)
    return tables.read_wide_features(spark, path, 2).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "features")


@query("q53_encoder", f"WITH {BALLOTS}, n AS (SELECT 'voter' AS kind, voter AS name FROM ballots UNION SELECT 'entry', year || ' ' || recipient FROM ballots) SELECT kind, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS INTEGER) AS idx FROM n")
def q53_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous numbers of voters and entries."""
    votes = ballots(spark, sf_dir).withColumn("entry", F.concat_ws(" ", F.col("year").cast("string"), "recipient"))
    return tables.stacked(*(recommend.encoder(votes, c).select(F.lit(c).alias("kind"), F.col(c).alias("name"), "idx") for c in ("voter", "entry")))


@query(
    "q80_report",
    """WITH b AS (SELECT r_regionkey, r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
l AS (SELECT 0 AS p, 0 AS k, '# Regions' AS line UNION ALL SELECT 0, 1, '' UNION ALL SELECT 1, 0, '## Sizes' UNION ALL SELECT 1, 1, '' UNION ALL SELECT 1, 2, '| r_regionkey | nations |' UNION ALL SELECT 1, 3, '| --- | --- |'
  UNION ALL SELECT 1, 4 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || nations || ' |' FROM b UNION ALL SELECT 1, 1000, ''
  UNION ALL SELECT 2, 0, '## Names' UNION ALL SELECT 2, 1, '' UNION ALL SELECT 2, 2, '| r_name |' UNION ALL SELECT 2, 3, '| --- |' UNION ALL SELECT 2, 4 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' |' FROM b UNION ALL SELECT 2, 1000, '')
SELECT CAST(row_number() OVER (ORDER BY p, k) AS INTEGER) AS line_no, line FROM l""",
)
def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two tables, written as one text file and read back."""
    nation = tables.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"))
    rows = tables.table(spark, sf_dir, "region").join(nation, "r_regionkey")
    path = scratch(spark, "report")
    write_lines(report_lines("Regions", [("Sizes", rows.select("r_regionkey", "nations"), ["r_regionkey"]), ("Names", rows.select("r_name"), ["r_name"])]), path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("k", "line"))
    return whole.select((F.col("k") + 1).alias("line_no"), "line")
