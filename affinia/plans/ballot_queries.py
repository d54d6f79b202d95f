"""Queries over ballots: cleaning, grids, similarity, clusters and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.functions.numeric import rounded
from affinia.operators import clean, clustering, graphs, grids, similarity
from affinia.plans.base import BALLOTS, COORDS, COSINE, COUNTRIES, LABELS, OPPORTUNITY, PROFILES, SPLIT, WINDOWS, ballots, perms, query, r6, split_ballots, windowed
from affinia.sources.shared import written
from affinia.sources.tables import coordinates, labels, raw_ballots, stacked, table

#: Fixed value: the published number of draws of the geography test.
GEO_DRAWS = 2_000


@query("q01_clean_ballots", f"WITH {BALLOTS} SELECT * FROM ballots")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_votes(raw_ballots(spark, sf_dir), names=False)


_DECORATED = """raw AS (SELECT n_nationkey AS k, '  ' || lower(replace(n_name, ' ', '   ')) || ' ' AS name FROM nation UNION ALL SELECT n_nationkey + 100, replace(n_name, ' ', '-') FROM nation
  UNION ALL SELECT * FROM (VALUES (200, 'sweeden'), (201, 'The-Netherlands'), (202, '  united   kingdom '), (203, NULL), (204, 'Bosnia & Herzegovina'), (205, 'bosnia')) v(k, name))"""


@query(
    "q02_name_normalise",
    f"""WITH {_DECORATED}, s AS (SELECT *, lower(trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g'))) AS q FROM raw),
t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(q, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda x: upper(x[1]) || x[2:]), '') AS tc FROM s)
SELECT CAST(k AS INTEGER) AS k, CASE q WHEN 'aerbaijan' THEN 'Azerbaijan' WHEN 'sweeden' THEN 'Sweden' WHEN 'bosnia' THEN 'Bosnia and Herzegovina' WHEN 'bosnia and herzegovina' THEN 'Bosnia and Herzegovina' ELSE tc END AS country,
CASE name WHEN 'The-Netherlands' THEN 'Netherlands' WHEN 'United-Kingdom' THEN 'United Kingdom' WHEN 'Bosnia & Herzegovina' THEN 'Bosnia and Herzegovina' ELSE name END AS harmonised,
CASE name WHEN 'The-Netherlands' THEN 'The Netherlands' WHEN 'United-Kingdom' THEN 'United Kingdom' WHEN 'Bosnia & Herzegovina' THEN 'Bosnia and Herzegovina' ELSE name END AS node,
replace(name, '-', ' ') AS unhyphenated, CASE WHEN q LIKE '%jury%' THEN 'Jury' WHEN q LIKE '%televote%' THEN 'Public' ELSE 'Other' END AS grp FROM t""",
)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    more = spark.createDataFrame([(200, "sweeden"), (201, "The-Netherlands"), (202, "  united   kingdom "), (203, None), (204, "Bosnia & Herzegovina"), (205, "bosnia")], "k int, name string")
    raw = nation.select(F.col("n_nationkey").cast("int").alias("k"), F.concat(F.lit("  "), F.lower(F.replace("n_name", F.lit(" "), F.lit("   "))), F.lit(" ")).alias("name"))
    raw = raw.union(nation.select((F.col("n_nationkey") + 100).cast("int"), F.replace("n_name", F.lit(" "), F.lit("-")))).union(more)
    n = F.col("name")
    group = clean.points_group(F.coalesce(n, F.lit("")))
    return raw.select("k", clean.country_name(n).alias("country"), clean.harmonised(n).alias("harmonised"), clean.node_name(n).alias("node"), clean.unhyphenated(n).alias("unhyphenated"), group.alias("grp"))


@query(
    "q03_points_matrix",
    f"WITH {BALLOTS}, {COUNTRIES} SELECT a.country AS voter, b.country AS recipient, coalesce(sum(points), 0.0) AS points FROM countries a CROSS JOIN countries b LEFT JOIN ballots ON voter = a.country AND recipient = b.country GROUP BY ALL",
)
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.points_matrix(ballots(spark, sf_dir))


@query("q04_opportunity", f"WITH {BALLOTS}, {OPPORTUNITY} SELECT * FROM opportunity")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.opportunity(ballots(spark, sf_dir))


@query("q05_rate_centered", f"WITH {BALLOTS}, {PROFILES} SELECT voter, recipient, {r6('rate')} AS rate, {r6('centred')} AS centred FROM profiles")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = similarity.profiles(ballots(spark, sf_dir))
    return own.select("voter", "recipient", rounded("rate").alias("rate"), rounded("centred").alias("centred"))


def centred_pairs(votes: DataFrame) -> DataFrame:
    return similarity.cosine_pairs(similarity.profiles(votes), "voter", "recipient", "centred")


@query("q06_cosine_similarity", f"WITH {BALLOTS}, {COSINE} SELECT a, b, {r6('sim')} AS sim FROM pairs")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centred_pairs(ballots(spark, sf_dir)).select("a", "b", rounded("sim").alias("sim"))


@query(
    "q07_jaccard_similarity",
    f"""WITH {BALLOTS}, {PROFILES}, m AS (SELECT voter, recipient FROM profiles WHERE rate >= 1.0),
s AS (SELECT v.voter, count(m.recipient) AS n FROM (SELECT DISTINCT voter FROM profiles) v LEFT JOIN m ON m.voter = v.voter GROUP BY v.voter),
i AS (SELECT x.voter AS a, y.voter AS b, count(*) AS n FROM m x JOIN m y ON x.recipient = y.recipient AND x.voter < y.voter GROUP BY ALL)
SELECT x.voter AS a, y.voter AS b, round(coalesce(coalesce(i.n, 0) / nullif(x.n + y.n - coalesce(i.n, 0), 0), 0), 6) + 0.0 AS sim FROM s x JOIN s y ON x.voter < y.voter LEFT JOIN i ON i.a = x.voter AND i.b = y.voter""",
)
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(similarity.profiles(ballots(spark, sf_dir))).select("a", "b", rounded("sim").alias("sim"))


@query("q08_voting_editions", f"WITH {BALLOTS} SELECT voter, count(DISTINCT year) AS editions, count(DISTINCT year) >= 4 AS eligible FROM ballots GROUP BY voter ORDER BY editions DESC, voter")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grids.voting_editions(ballots(spark, sf_dir))
    return own.withColumn("eligible", F.col("editions") >= 4).orderBy(F.desc("editions"), "voter")


@query("q09_split_years", f"WITH {BALLOTS} SELECT year FROM ballots GROUP BY year HAVING bool_or(points_type = 'jury') AND bool_or(points_type = 'televote')")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.split_years(ballots(spark, sf_dir))


@query(
    "q10_net_relations",
    f"""WITH {BALLOTS}, {COUNTRIES}, m AS (SELECT a.country AS voter, b.country AS recipient, coalesce(sum(points), 0.0) AS points FROM countries a CROSS JOIN countries b LEFT JOIN ballots ON voter = a.country AND recipient = b.country GROUP BY ALL)
SELECT x.voter, x.recipient, x.points - y.points AS net FROM m x JOIN m y ON x.voter = y.recipient AND x.recipient = y.voter""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.net_relations(ballots(spark, sf_dir))


@query(
    "q11_jury_televote_diff",
    f"""WITH {BALLOTS}, {COUNTRIES}, g AS (SELECT country, coalesce(sum(points) FILTER (WHERE points_type = 'jury'), 0.0) AS jury, coalesce(sum(points) FILTER (WHERE points_type = 'televote'), 0.0) AS televote
FROM countries LEFT JOIN ballots ON recipient = country GROUP BY country) SELECT *, jury - televote AS diff FROM g ORDER BY diff, country""",
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.kind_difference(ballots(spark, sf_dir)).orderBy("diff", "country")


@query(
    "q12_split_matrices",
    f"""WITH {BALLOTS}, {SPLIT}, c AS (SELECT voter AS country FROM split UNION SELECT recipient FROM split)
SELECT t.points_type, a.country AS voter, b.country AS recipient, coalesce(sum(points), 0.0) AS points FROM (VALUES ('jury'), ('televote')) t(points_type) CROSS JOIN c a CROSS JOIN c b
LEFT JOIN split s ON s.voter = a.country AND s.recipient = b.country AND s.points_type = t.points_type GROUP BY ALL""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = split_ballots(spark, sf_dir)
    dim = grids.countries(votes)
    parts = [grids.points_matrix(votes.filter(F.col("points_type") == k), dim).withColumn("points_type", F.lit(k)) for k in ("jury", "televote")]
    return parts[0].unionByName(parts[1]).select("points_type", "voter", "recipient", "points")


@query(
    "q13_country_set_algebra",
    f"""WITH {BALLOTS}, {COUNTRIES}, v AS (SELECT DISTINCT voter AS country FROM ballots), r AS (SELECT DISTINCT recipient AS country FROM ballots),
e AS (SELECT voter AS country FROM ballots GROUP BY voter HAVING count(DISTINCT year) >= 4), eu AS (SELECT n_name AS country FROM nation WHERE n_regionkey = 3)
SELECT 'all' AS grp, country FROM countries UNION ALL SELECT 'both', country FROM (SELECT * FROM v INTERSECT SELECT * FROM r) UNION ALL SELECT 'voters_only', country FROM (SELECT * FROM v EXCEPT SELECT * FROM r)
UNION ALL SELECT 'excluded', country FROM countries WHERE country NOT IN (SELECT country FROM e) UNION ALL SELECT 'target', country FROM countries WHERE country IN (SELECT country FROM eu)""",
)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = ballots(spark, sf_dir)
    every = grids.countries(votes)
    v, r = votes.select(F.col("voter").alias("country")).distinct(), votes.select(F.col("recipient").alias("country")).distinct()
    e = grids.eligible(votes).withColumnRenamed("voter", "country")
    target = labels(spark, sf_dir).filter("label = 3").select("country")
    parts = {"all": every, "both": v.intersect(r), "voters_only": v.subtract(r), "excluded": every.join(e, "country", "left_anti"), "target": every.join(F.broadcast(target), "country", "left_semi")}
    return stacked(*(df.select(F.lit(k).alias("grp"), "country") for k, df in parts.items()))


@query(
    "q14_stacked_union",
    f"""WITH {BALLOTS} SELECT voter, CAST(count(DISTINCT year) AS DOUBLE) AS editions, NULL::VARCHAR AS recipient, NULL::DOUBLE AS total FROM ballots GROUP BY voter
UNION ALL SELECT NULL, NULL, recipient, sum(points) FROM ballots GROUP BY recipient""",
)
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = ballots(spark, sf_dir)
    return stacked(grids.voting_editions(votes).withColumn("editions", F.col("editions").cast("double")), votes.groupBy("recipient").agg(F.sum("points").alias("total")))


@query("q15_distance_long", f"WITH {BALLOTS}, {COSINE} SELECT a, b, {r6('dist')} AS dist FROM dist")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.distances(centred_pairs(ballots(spark, sf_dir))).select("a", "b", rounded("dist").alias("dist"))


@query(
    "q16_silhouette_given_labels",
    f"""WITH {BALLOTS}, {COSINE}, {LABELS}, m AS (SELECT d.a AS country, la.label AS label, lb.label AS other, avg(dist) AS m FROM dist d JOIN labels la ON la.country = d.a JOIN labels lb ON lb.country = d.b GROUP BY ALL),
s AS (SELECT country, label, max(m) FILTER (WHERE label = other) AS i, min(m) FILTER (WHERE label <> other) AS o FROM m GROUP BY ALL)
SELECT country, CAST(label AS INTEGER) AS label, round(CASE WHEN i IS NULL THEN 0.0 ELSE (o - i) / greatest(i, o) END, 6) + 0.0 AS s FROM s""",
)
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clustering.silhouette_of(similarity.distances(centred_pairs(ballots(spark, sf_dir))), labels(spark, sf_dir))
    return own.select("country", "label", rounded("s").alias("s"))


@query(
    "q17_cluster_cohesion",
    f"""WITH {BALLOTS}, {COSINE}, {LABELS}, p AS (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs),
c AS (SELECT la.label, count(DISTINCT a) AS n, coalesce(avg(sim) FILTER (WHERE la.label = lb.label), 0) AS i, coalesce(avg(sim) FILTER (WHERE la.label <> lb.label), 0) AS o
FROM p JOIN labels la ON la.country = a JOIN labels lb ON lb.country = b GROUP BY ALL)
SELECT CAST(label AS INTEGER) AS label, n, {r6('i')} AS inside, {r6('o')} AS outside, {r6('i - o')} AS cohesion FROM c""",
)
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clustering.cohesion(centred_pairs(ballots(spark, sf_dir)), labels(spark, sf_dir))
    return own.select("label", "n", *(rounded(c).alias(c) for c in ("inside", "outside", "cohesion")))


#: Named groups of nations to hold clusters against; they overlap.
NAMED = {"tens": [f"NATION_{k}" for k in range(10, 20)], "even": [f"NATION_{k}" for k in range(0, 25, 2)], "fives": [f"NATION_{k}" for k in range(0, 25, 5)], "first": ["NATION_0", "NATION_1", "NATION_2"]}
_NAMED_SQL = "named(bloc, country) AS (VALUES " + ", ".join(f"('{b}', '{c}')" for b, cs in NAMED.items() for c in cs) + ")"


@query(
    "q18_bloc_overlap",
    f"""WITH {LABELS}, {_NAMED_SQL}, z AS (SELECT bloc, count(*) AS bloc_size FROM named GROUP BY bloc)
SELECT CAST(label AS INTEGER) AS label, bloc, count(*) AS n, max(bloc_size) AS bloc_size, round(count(*) / max(bloc_size), 3) AS share FROM labels JOIN named USING (country) JOIN z USING (bloc) GROUP BY ALL ORDER BY label, n DESC, bloc""",
)
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([(b, c) for b, cs in NAMED.items() for c in cs], "bloc string, country string")
    own = clustering.bloc_overlap(labels(spark, sf_dir), named)
    return own.withColumn("share", F.round("share", 3)).orderBy("label", F.desc("n"), "bloc")


def _distances(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    return similarity.distances(written(centred_pairs(windowed(spark, sf_dir, window)), "pairs"))


@query("q19_hierarchical_clusters")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stacked(*(_distances(spark, sf_dir, w).withColumn("window", F.lit(w)) for w in WINDOWS))
    return clustering.cluster(every, ["window"])


@query("q19_silhouette_curve")
def q19_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stacked(*(_distances(spark, sf_dir, w).withColumn("window", F.lit(w)) for w in WINDOWS))
    return clustering.silhouette_curve(every, ["window"])


@query("q20_linkage_and_metric_bakeoff")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(similarity.profiles(ballots(spark, sf_dir)), "profiles")
    metrics = {"cosine_rates": similarity.cosine_pairs(own, "voter", "recipient", "rate"), "cosine_centred": similarity.cosine_pairs(own, "voter", "recipient", "centred"), "jaccard": similarity.jaccard_pairs(own)}
    every = stacked(*(similarity.distances(p).withColumn("metric", F.lit(m)) for m, p in metrics.items()))
    every = every.withColumn("method", F.explode(F.array(F.lit("average"), F.lit("complete"))))
    return clustering.silhouette_curve(every, ["metric", "method"], range(9, 10), "method")


@query("q21_holdout_clusters")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = clean.in_window(ballots(spark, sf_dir), 1995, 1997)
    pairs = similarity.cosine_pairs(similarity.profiles(votes, 3), "voter", "recipient", "centred")
    return clustering.cluster(similarity.distances(pairs).withColumn("window", F.lit("holdout")), ["window"], fixed_k=9)


_EDGES = "edges AS (SELECT voter AS src, recipient AS dst, sum(points) AS w, count(DISTINCT year) AS n_years FROM ballots WHERE points > 0 GROUP BY ALL)"


@query("q22_digraph_edges", f"WITH {BALLOTS}, {_EDGES} SELECT src, dst, w, n_years, {r6('w / n_years')} AS mean_w FROM edges")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.digraph(ballots(spark, sf_dir)).withColumn("mean_w", rounded("mean_w"))


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(*(graphs.digraph(windowed(spark, sf_dir, w)).select(F.lit(w).alias("graph"), "src", "dst", "w") for w in WINDOWS))


_GRAPHS = """win AS (SELECT 'full' AS graph, * FROM ballots UNION ALL SELECT points_type, * FROM ballots WHERE year >= 1998 AND points_type IN ('jury', 'televote')),
g AS (SELECT graph, voter AS src, recipient AS dst, sum(points) AS w FROM win WHERE points > 0 GROUP BY ALL)"""


@query(
    "q23_symmetrised_graph_stats",
    f"""WITH {BALLOTS}, {_GRAPHS}, n AS (SELECT graph, count(DISTINCT x) AS nodes FROM (SELECT graph, src AS x FROM g UNION ALL SELECT graph, dst FROM g) GROUP BY graph), d AS (SELECT graph, count(*) AS directed_edges FROM g GROUP BY graph),
u AS (SELECT graph, count(*) AS edges, sum(w) AS weight FROM (SELECT graph, least(src, dst) AS a, greatest(src, dst) AS b, sum(w) AS w FROM g GROUP BY ALL) GROUP BY graph)
SELECT graph, nodes, directed_edges, edges, {r6('edges / (nodes * (nodes - 1) / 2)')} AS density FROM n JOIN d USING (graph) JOIN u USING (graph)""",
)
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.graph_stats(_graphs(spark, sf_dir), "graph").withColumn("density", rounded("density"))


@query(
    "q24_modularity_given_labels",
    f"""WITH {BALLOTS}, {_GRAPHS}, {LABELS}, e AS (SELECT g.*, a.label AS ls, b.label AS ld FROM g JOIN labels a ON a.country = src JOIN labels b ON b.country = dst),
t AS (SELECT graph, sum(w) AS m, sum(w) FILTER (WHERE ls = ld) AS i FROM e GROUP BY graph), o AS (SELECT graph, ls AS l, sum(w) AS o FROM e GROUP BY ALL), n AS (SELECT graph, ld AS l, sum(w) AS n FROM e GROUP BY ALL),
b AS (SELECT coalesce(o.graph, n.graph) AS graph, coalesce(o, 0) AS o, coalesce(n, 0) AS n FROM o FULL JOIN n ON o.graph = n.graph AND o.l = n.l), x AS (SELECT graph, sum(o * n) AS d, sum(pow((o + n) / 2, 2)) AS u FROM b GROUP BY graph)
SELECT graph, {r6('i / m - u / (m * m)')} AS q, {r6('i / m - d / (m * m)')} AS q_directed FROM t JOIN x USING (graph)""",
)
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, own = _graphs(spark, sf_dir), labels(spark, sf_dir)
    directed = graphs.modularity(edges, own, "graph", directed=True).withColumnRenamed("q", "q_directed")
    return graphs.modularity(edges, own, "graph").join(directed, "graph").select("graph", rounded("q").alias("q"), rounded("q_directed").alias("q_directed"))


@query("q25_louvain_best")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.louvain_best(spark, graphs.symmetrised(_graphs(spark, sf_dir), "graph"), "graph")


@query("q26_girvan_newman_best")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.girvan_newman_best(graphs.symmetrised(_graphs(spark, sf_dir), "graph").filter("graph = 'full'"), "graph")


@query("q27_align_labels")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.align_labels(labels(spark, sf_dir, "key"), labels(spark, sf_dir))


@query("q28_haversine_pairs", f"WITH {COORDS} SELECT a, b, {r6('km')} AS km FROM km")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.pair_distances(coordinates(spark, sf_dir)).select("a", "b", rounded("km").alias("km"))


@query(
    "q29_geo_compactness",
    f"""WITH {COORDS}, known AS (SELECT n_name AS country, n_regionkey AS label FROM nation WHERE n_nationkey <> 0), {perms('geo', GEO_DRAWS, 'known')},
o AS (SELECT avg(km) AS o FROM km JOIN known x ON x.country = a JOIN known y ON y.country = b WHERE x.label = y.label),
n AS (SELECT x.draw, avg(km) AS km FROM km JOIN perms x ON x.node = a JOIN perms y ON y.node = b AND y.draw = x.draw WHERE x.label = y.label GROUP BY x.draw)
SELECT {r6('max(o)')} AS observed_km, {r6('avg(km)')} AS expected_km, {r6('avg(CAST(km <= o AS DOUBLE))')} AS p_value, {r6('max(o) / avg(km)')} AS ratio FROM n, o""",
)
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graphs.compactness(spark, coordinates(spark, sf_dir), labels(spark, sf_dir), GEO_DRAWS, "geo")
    return own.select(*(rounded(c).alias(c) for c in ("observed_km", "expected_km", "p_value", "ratio")))


@query(
    "q30_movers_and_spread",
    f"""WITH {COORDS}, {LABELS}, alt AS (SELECT n_name AS country, n_nationkey % 3 AS label FROM nation),
r AS (SELECT a AS country, avg(km) AS km FROM km2 JOIN labels x ON x.country = a JOIN labels y ON y.country = b WHERE x.label = y.label GROUP BY a),
t AS (SELECT a AS country, avg(km) AS km FROM km2 JOIN alt x ON x.country = a JOIN alt y ON y.country = b WHERE x.label = y.label GROUP BY a),
d AS (SELECT country, round(r.km - t.km, 6) + 0.0 AS diff FROM r JOIN t USING (country)), top AS (SELECT * FROM d ORDER BY diff DESC, country DESC LIMIT 6),
s AS (SELECT label, round(avg(km), 6) + 0.0 AS spread FROM r JOIN labels USING (country) GROUP BY label)
SELECT 'mover' AS kind, country AS name, diff AS value FROM top UNION ALL (SELECT 'tightest', CAST(label AS VARCHAR), spread FROM s ORDER BY spread, label LIMIT 1) UNION ALL (SELECT 'widest', CAST(label AS VARCHAR), spread FROM s ORDER BY spread DESC, label LIMIT 1)""",
)
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, own = graphs.pair_distances(coordinates(spark, sf_dir)), labels(spark, sf_dir)
    r = graphs.distance_to_own(pairs, own)
    t = graphs.distance_to_own(pairs, labels(spark, sf_dir, "key")).withColumnRenamed("km", "km_t")
    diff = r.join(t, "country").select("country", rounded(F.col("km") - F.col("km_t")).alias("value"))
    movers = diff.orderBy(F.desc("value"), F.desc("country")).limit(6).select(F.lit("mover").alias("kind"), F.col("country").alias("name"), "value")
    spread = r.join(F.broadcast(own), "country").groupBy("label").agg(rounded(F.avg("km")).alias("value"))
    low = spread.orderBy("value", "label").limit(1).select(F.lit("tightest").alias("kind"), F.col("label").cast("string").alias("name"), "value")
    high = spread.orderBy(F.desc("value"), "label").limit(1).select(F.lit("widest").alias("kind"), F.col("label").cast("string").alias("name"), "value")
    return stacked(movers, low, high)
