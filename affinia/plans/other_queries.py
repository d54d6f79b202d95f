"""Queries of recommenders, partitions, texts and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.functions import gazetteer
from affinia.functions.numeric import format_p, rounded
from affinia.functions.render import markdown_lines
from affinia.operators import clustering, grids, inference, partitions, recommend, regression, textmatch, themes
from affinia.plans.base import BALLOTS, ballots, query, r6
from affinia.sources.shared import written
from affinia.sources.tables import entries, stacked, table

CELLS = """
gg AS (SELECT a.year, a.points_type, a.voter, b.recipient FROM (SELECT DISTINCT year, points_type, voter FROM ballots) a
  JOIN (SELECT DISTINCT year, points_type, recipient FROM ballots) b ON a.year = b.year AND a.points_type = b.points_type AND a.voter <> b.recipient),
tt AS (SELECT year, points_type, voter, recipient, sum(points) AS points FROM ballots GROUP BY ALL),
cells AS (SELECT g.year, g.points_type, g.voter, g.recipient, coalesce(points, 0.0) AS points, g.year || ' ' || g.recipient AS entry, g.year || ' ' || g.points_type || ' ' || g.voter AS ballot, g.year || ' ' || g.voter AS voter_year
  FROM gg g LEFT JOIN tt t ON t.year = g.year AND t.points_type = g.points_type AND t.voter = g.voter AND t.recipient = g.recipient)"""
MARKED = f"""{CELLS},
vy AS (SELECT voter_year, row_number() OVER (ORDER BY md5('42:' || voter_year), voter_year) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT voter_year FROM cells)),
marked AS (SELECT cells.*, rn <= greatest(1, round(n * 0.2)) AS is_test FROM cells JOIN vy USING (voter_year)),
agg AS (SELECT voter, entry, avg(points) AS points FROM marked WHERE NOT is_test GROUP BY ALL),
mu AS (SELECT avg(points) AS mu FROM agg), r0 AS (SELECT voter, entry, points - mu AS r FROM agg, mu), v0 AS (SELECT DISTINCT voter, 0.0 AS bias FROM r0)"""
_ROUNDS = "".join(
    f""",
e{k} AS MATERIALIZED (SELECT entry, sum(r - bias) / (count(*) + 5.0) AS bias FROM r0 JOIN v{k - 1} USING (voter) GROUP BY entry),
v{k} AS MATERIALIZED (SELECT voter, sum(r - bias) / (count(*) + 10.0) AS bias FROM r0 JOIN e{k} USING (entry) GROUP BY voter)"""
    for k in range(1, 6)
)
BIAS = f"""{MARKED}{_ROUNDS},
test AS (SELECT m.*, mu + coalesce(v5.bias, 0) + coalesce(e5.bias, 0) AS base FROM marked m CROSS JOIN mu LEFT JOIN v5 ON v5.voter = m.voter LEFT JOIN e5 ON e5.entry = m.entry WHERE is_test),
scored AS (SELECT *, greatest(0.0, least(12.0, base)) AS prediction FROM test)"""


def ranked(source: str, prediction: str, name: str) -> str:
    """CTE of ranks as in recommend.ranks."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY round({prediction}, 9) DESC, md5('42:' || ballot || ':' || recipient)) AS rp,
  row_number() OVER (PARTITION BY ballot ORDER BY points DESC, recipient) AS ra FROM {source}),
{name} AS (SELECT ballot, coalesce(sum(CASE WHEN rp <= 5 THEN points / log2(rp + 1) ELSE 0 END) / nullif(sum(CASE WHEN ra <= 5 THEN points / log2(ra + 1) ELSE 0 END), 0), 0) AS ndcg,
  coalesce(sum(CASE WHEN rp <= 10 THEN points / log2(rp + 1) ELSE 0 END) / nullif(sum(CASE WHEN ra <= 10 THEN points / log2(ra + 1) ELSE 0 END), 0), 0) AS ndcg2,
  count(*) FILTER (WHERE rp <= 5 AND ra <= 5) / 5.0 AS "precision", avg(pow({prediction} - points, 2)) AS mse FROM {name}_r GROUP BY ballot)"""


def marked(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    return written(recommend.split(grids.interactions(ballots(spark, sf_dir)), seed), "split")


def parts(spark: SparkSession, sf_dir: str, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train cells, test cells and fitted biases."""
    cells = marked(spark, sf_dir, seed)
    train, test = cells.filter("NOT is_test"), cells.filter("is_test")
    return train, test, recommend.biases(train)


@query("q53_interaction_grid", f"WITH {BALLOTS}, {CELLS} SELECT * FROM cells")
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.interactions(ballots(spark, sf_dir))


@query("q54_holdout_split", f"WITH {BALLOTS}, {MARKED} SELECT voter_year, is_test, count(*) AS n FROM marked GROUP BY ALL")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).groupBy("voter_year", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q55_baseline_means",
    f"""WITH {BALLOTS}, {MARKED}, g AS (SELECT avg(points) AS g FROM marked WHERE NOT is_test), v AS (SELECT voter, avg(points) AS v FROM marked WHERE NOT is_test GROUP BY voter),
p AS (SELECT points, g, coalesce(v, g) AS v FROM marked LEFT JOIN v USING (voter) CROSS JOIN g WHERE is_test)
SELECT 'global_mean' AS model, count(*) AS n, {r6('sqrt(avg(pow(g - points, 2)))')} AS rmse, {r6('sqrt(avg(pow(g - points, 2)) FILTER (WHERE points > 0))')} AS rmse_awarded FROM p
UNION ALL SELECT 'voter_mean', count(*), {r6('sqrt(avg(pow(v - points, 2)))')}, {r6('sqrt(avg(pow(v - points, 2)) FILTER (WHERE points > 0))')} FROM p""",
)
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recommend.mean_predictions(marked(spark, sf_dir))
    long = own.select("points", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("global_mean", "voter_mean")))).alias("x"))
    e2 = F.pow(F.col("x.p") - F.col("points"), 2)
    return long.groupBy(F.col("x.model").alias("model")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sqrt(F.avg(e2))).alias("rmse"), rounded(F.sqrt(F.avg(F.when(F.col("points") > 0, e2)))).alias("rmse_awarded"))


@query(
    "q56_bias_model",
    f"""WITH {BALLOTS}, {BIAS} SELECT 'mu' AS kind, '' AS name, {r6('mu')} AS bias FROM mu UNION ALL SELECT 'voter', voter, {r6('bias')} FROM v5 UNION ALL SELECT 'entry', entry, {r6('bias')} FROM e5""",
)
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.biases(marked(spark, sf_dir).filter("NOT is_test")).withColumn("bias", rounded("bias"))


KNN = f"""{BIAS}, res AS MATERIALIZED (SELECT a.voter, a.entry, a.points - mu - v5.bias - e5.bias AS r FROM agg a CROSS JOIN mu JOIN v5 USING (voter) JOIN e5 USING (entry)),
rn AS (SELECT voter, sqrt(sum(r * r)) AS n FROM res GROUP BY voter), dt AS (SELECT x.voter, y.voter AS other, sum(x.r * y.r) AS d, count(*) AS n FROM res x JOIN res y USING (entry) WHERE x.voter <> y.voter GROUP BY ALL),
sims AS MATERIALIZED (SELECT dt.voter, other, CASE WHEN dt.n >= 30 THEN coalesce(d / nullif(a.n * b.n, 0), 0) * dt.n / (dt.n + 25.0) ELSE 0 END AS sim FROM dt JOIN rn a ON a.voter = dt.voter JOIN rn b ON b.voter = dt.other),
nb AS (SELECT q.voter, q.entry, sim, r, row_number() OVER (PARTITION BY q.voter, q.entry ORDER BY round(abs(sim), 12) DESC, other) AS k FROM (SELECT DISTINCT voter, entry FROM test) q JOIN sims ON sims.voter = q.voter AND sim <> 0 JOIN res ON res.voter = other AND res.entry = q.entry),
adj AS (SELECT voter, entry, sum(sim * r) / sum(abs(sim)) AS adj FROM nb WHERE k <= 10 GROUP BY ALL),
knn AS (SELECT test.*, greatest(0.0, least(12.0, base + coalesce(adj, 0))) AS prediction FROM test LEFT JOIN adj USING (voter, entry))"""


@query("q57_knn_cf", f"WITH {BALLOTS}, {KNN} SELECT ballot, recipient, {r6('prediction')} AS prediction FROM knn")
def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, fitted = parts(spark, sf_dir)
    return recommend.knn_predictions(test, train, fitted).select("ballot", "recipient", rounded("prediction").alias("prediction"))


def _runs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, recommend.RUNS)


def _factor_scores(spark: SparkSession, sf_dir: str, grid: list[tuple]) -> DataFrame:
    train, test, fitted = parts(spark, sf_dir)
    return recommend.factor_predictions(train, test, fitted, _runs(spark, grid), ["ballot", "recipient"])


@query("q58_mf_als")
def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _factor_scores(spark, sf_dir, [("mf", "mf", 4, 20.0, 0.0)])
    return own.select("ballot", "recipient", "points", rounded("prediction").alias("prediction"))


@query("q59_implicit_als")
def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _factor_scores(spark, sf_dir, [("implicit", "implicit", 16, 20.0, 1.0)])
    return own.select("ballot", "recipient", "points", rounded("prediction").alias("prediction"))


_METRICS = ["rmse", "rmse_awarded", "precision", "ndcg", "ndcg2"]


@query(
    "q60_ranking_metrics",
    f"""WITH {BALLOTS}, {BIAS}, {ranked('scored', 'prediction', 'pb')}, e AS (SELECT count(*) AS n_cells, sqrt(avg(pow(prediction - points, 2))) AS rmse, sqrt(avg(pow(prediction - points, 2)) FILTER (WHERE points > 0)) AS rmse_awarded FROM scored)
SELECT max(n_cells) AS n_cells, count(*) AS n_ballots, {r6('max(rmse)')} AS rmse, {r6('max(rmse_awarded)')} AS rmse_awarded, {r6('avg("precision")')} AS "precision", {r6('avg(ndcg)')} AS ndcg, {r6('avg(ndcg2)')} AS ndcg2 FROM pb, e""",
)
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, fitted = parts(spark, sf_dir)
    own = recommend.evaluation(recommend.bias_predictions(test, fitted), 42)
    return own.select("n_cells", "n_ballots", *(rounded(c).alias(c) for c in _METRICS))


@query(
    "q61_paired_ttest",
    f"""WITH {BALLOTS}, {KNN}, {ranked('scored', 'prediction', 'pb')}, {ranked('knn', 'prediction', 'pk')},
x AS (SELECT 'ndcg' AS metric, true AS up, pk.ndcg AS a, pb.ndcg AS b FROM pk JOIN pb USING (ballot) UNION ALL SELECT 'mse', false, pk.mse, pb.mse FROM pk JOIN pb USING (ballot))
SELECT metric, {r6('avg(a)')} AS model_mean, {r6('avg(b)')} AS reference_mean, {r6('avg(a - b)')} AS mean_difference, CASE WHEN up THEN avg(a - b) > 0 ELSE avg(a - b) < 0 END AS model_better, {r6('avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))')} AS t, count(*) AS n FROM x GROUP BY metric, up""",
)
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, fitted = parts(spark, sf_dir)
    left = recommend.per_ballot(recommend.knn_predictions(test, train, fitted), 42)
    right = recommend.per_ballot(recommend.bias_predictions(test, fitted), 42)
    own = recommend.paired_t(left, right, {"ndcg": True, "mse": False})
    return own.withColumns({c: rounded(c) for c in ("model_mean", "reference_mean", "mean_difference", "t")})


@query("q61_paired_ttest_p")
def q61_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.with_student_p(written(q61(spark, sf_dir), "paired")).withColumn("shown", format_p(F.col("p_value"), 2000))


@query(
    "q62_top_examples",
    f"""WITH {BALLOTS}, {BIAS}, s AS (SELECT m.*, greatest(0.0, least(12.0, mu + coalesce(v5.bias, 0) + coalesce(e5.bias, 0))) AS prediction FROM marked m CROSS JOIN mu LEFT JOIN v5 ON v5.voter = m.voter LEFT JOIN e5 ON e5.entry = m.entry),
l AS (SELECT *, prediction - avg(prediction) OVER (PARTITION BY entry) AS pl, points - avg(points) OVER (PARTITION BY entry) AS al FROM s),
p AS (SELECT voter, recipient, avg(prediction) AS pm, avg(points) AS am, avg(pl) AS pl, avg(al) AS al, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 5),
x AS (SELECT voter, recipient, n, 'mean_points' AS basis, pm AS p, am AS a FROM p UNION ALL SELECT voter, recipient, n, 'bloc_lift', pl, al FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY voter, basis ORDER BY round(p, 9) DESC, recipient) AS rp, row_number() OVER (PARTITION BY voter, basis ORDER BY round(a, 9) DESC, recipient) AS ra FROM x)
SELECT u.voter, u.basis, CAST(u.rp AS INTEGER) AS rank, u.recipient AS predicted_country, round(u.p, 6) + 0.0 AS predicted_value, u.ra <= 5 AS predicted_in_actual_top, w.recipient AS actual_country, round(w.a, 6) + 0.0 AS actual_value, w.n AS actual_opportunities
FROM r u JOIN r w ON u.voter = w.voter AND u.basis = w.basis AND u.rp = w.ra WHERE u.rp <= 5""",
)
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = marked(spark, sf_dir)
    scored = recommend.bias_predictions(cells, recommend.biases(cells.filter("NOT is_test")))
    return recommend.examples(scored).withColumns({c: rounded(c) for c in ("predicted_value", "actual_value")})


#: CTEs of the predictions of the models that SQL can fit, long, with their names.
_SQL_MODELS = f"""{KNN}, g AS (SELECT avg(points) AS g FROM marked WHERE NOT is_test), vm AS (SELECT voter, avg(points) AS v FROM marked WHERE NOT is_test GROUP BY voter),
preds AS (SELECT 'baseline_global_mean' AS model, '' AS params, ballot, recipient, points, g AS prediction FROM test, g
  UNION ALL SELECT 'baseline_voter_mean', '', ballot, recipient, points, coalesce(v, g) FROM test LEFT JOIN vm USING (voter) CROSS JOIN g
  UNION ALL SELECT 'bias_only_entry_quality', '', ballot, recipient, points, prediction FROM scored
  UNION ALL SELECT 'neighborhood_cf', 'n_neighbors=10, shrinkage=25, min_overlap=30', ballot, recipient, points, prediction FROM knn),
by_ballot_r AS (SELECT *, row_number() OVER (PARTITION BY model, ballot ORDER BY round(prediction, 9) DESC, md5('42:' || ballot || ':' || recipient)) AS rp,
  row_number() OVER (PARTITION BY model, ballot ORDER BY points DESC, recipient) AS ra FROM preds),
by_ballot AS (SELECT model, params, ballot, coalesce(sum(CASE WHEN rp <= 5 THEN points / log2(rp + 1) ELSE 0 END) / nullif(sum(CASE WHEN ra <= 5 THEN points / log2(ra + 1) ELSE 0 END), 0), 0) AS ndcg,
  coalesce(sum(CASE WHEN rp <= 10 THEN points / log2(rp + 1) ELSE 0 END) / nullif(sum(CASE WHEN ra <= 10 THEN points / log2(ra + 1) ELSE 0 END), 0), 0) AS ndcg2,
  count(*) FILTER (WHERE rp <= 5 AND ra <= 5) / 5.0 AS "precision", avg(pow(prediction - points, 2)) AS mse FROM by_ballot_r GROUP BY ALL)"""
_SQL_NAMES = ["baseline_global_mean", "baseline_voter_mean", "bias_only_entry_quality", "neighborhood_cf"]


def _compared(spark: SparkSession, sf_dir: str, models: list[str]) -> DataFrame:
    own = recommend.comparison(recommend.model_predictions(marked(spark, sf_dir), models), 42)
    return own.select("model", "params", "n_cells", "n_ballots", *(rounded(c).alias(c) for c in _METRICS))


@query(
    "q60_model_comparison",
    f"""WITH {BALLOTS}, {_SQL_MODELS}, e AS (SELECT model, count(*) AS n_cells, sqrt(avg(pow(prediction - points, 2))) AS rmse, sqrt(avg(pow(prediction - points, 2)) FILTER (WHERE points > 0)) AS rmse_awarded FROM preds GROUP BY model)
SELECT model, params, max(n_cells) AS n_cells, count(*) AS n_ballots, {r6('max(rmse)')} AS rmse, {r6('max(rmse_awarded)')} AS rmse_awarded, {r6('avg("precision")')} AS "precision", {r6('avg(ndcg)')} AS ndcg, {r6('avg(ndcg2)')} AS ndcg2
FROM by_ballot JOIN e USING (model) GROUP BY model, params""",
)
def q60_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, _SQL_NAMES)


@query("q60_all_models")
def q60_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six models on one split, beside their means and deviations over the repeated splits."""
    return _compared(spark, sf_dir, list(recommend.MODELS)).join(q64(spark, sf_dir), "model", "left")


@query(
    "q61_model_significance",
    f"""WITH {BALLOTS}, {_SQL_MODELS}, x AS (SELECT 'ndcg' AS metric, true AS up, a.ndcg AS a, b.ndcg AS b FROM by_ballot a JOIN by_ballot b USING (ballot) WHERE a.model = 'neighborhood_cf' AND b.model = 'bias_only_entry_quality'
  UNION ALL SELECT 'mse', false, a.mse, b.mse FROM by_ballot a JOIN by_ballot b USING (ballot) WHERE a.model = 'neighborhood_cf' AND b.model = 'bias_only_entry_quality')
SELECT 'neighborhood_cf' AS model, 'bias_only_entry_quality' AS reference, metric, {r6('avg(a)')} AS model_mean, {r6('avg(b)')} AS reference_mean, {r6('avg(a - b)')} AS mean_difference,
  CASE WHEN up THEN avg(a - b) > 0 ELSE avg(a - b) < 0 END AS model_better, {r6('avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))')} AS t, count(*) AS n FROM x GROUP BY metric, up""",
)
def q61_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = recommend.model_predictions(marked(spark, sf_dir), ["bias_only_entry_quality", "neighborhood_cf"])
    own = recommend.significance(scored, 42, comparisons=[("neighborhood_cf", "bias_only_entry_quality")])
    return own.withColumns({c: rounded(c) for c in ("model_mean", "reference_mean", "mean_difference", "t")})


@query("q61_all_significance")
def q61_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published comparisons, with p-values: a row for each pair and metric."""
    own = written(recommend.significance(recommend.model_predictions(marked(spark, sf_dir), list(recommend.MODELS)), 42), "significance")
    return inference.with_student_p(own).withColumns({c: rounded(c) for c in ("model_mean", "reference_mean", "mean_difference", "t", "p_value")})


@query("q63_grid_search")
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published grids: 4 x 5 of factorisation, 3 x 3 x 3 of implicit feedback, on an inner split; the best first."""
    cells = marked(spark, sf_dir).filter("NOT is_test").drop("is_test")
    inner = written(recommend.split(cells, 43), "inner-split")
    train, test = inner.filter("NOT is_test"), inner.filter("is_test")
    grid = [(f"mf n_factors={f}, reg={r:g}", "mf", f, r, 0.0) for f in (2, 4, 8, 16) for r in (1.0, 5.0, 20.0, 50.0, 100.0)]
    grid += [(f"implicit n_factors={f}, reg={r:g}, alpha={a:g}", "implicit", f, r, a) for f in (4, 8, 16) for r in (1.0, 5.0, 20.0) for a in (0.5, 1.0, 4.0)]
    own = recommend.factor_predictions(train, test, recommend.biases(train), _runs(spark, grid), ["ballot", "recipient"])
    found = recommend.evaluation(written(own, "grid"), 42, 5, "run")
    return found.select("run", *(rounded(c).alias(c) for c in _METRICS)).orderBy("rmse", "run")


@query("q64_repeated_splits")
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six models over the published seeds, fitted at once."""
    cells = written(recommend.splits(grids.interactions(ballots(spark, sf_dir)), recommend.SEEDS), "splits")
    own = recommend.over_seeds(written(recommend.model_predictions(cells, list(recommend.MODELS), ("seed",)), "predictions"))
    return own.select("model", *(rounded(c).alias(c) for c in own.columns if c != "model"))


_AGREE = """z AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p FROM c), ka AS (SELECT a, sum(n) AS n FROM c GROUP BY a), kb AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
ha AS (SELECT sum(k.n * (k.n - 1) / 2) AS p, sum(-(k.n / z.n) * ln(k.n / z.n)) AS h FROM ka k, z), hb AS (SELECT sum(k.n * (k.n - 1) / 2) AS p, sum(-(k.n / z.n) * ln(k.n / z.n)) AS h FROM kb k, z),
mi AS (SELECT sum(c.n / z.n * ln(c.n * z.n / (ka.n * kb.n))) AS mi FROM c JOIN ka ON ka.a = c.a JOIN kb ON kb.b = c.b CROSS JOIN z)"""


@query(
    "q65_ari_nmi",
    f"""WITH c AS (SELECT lang AS a, source AS b, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL), {_AGREE}
SELECT CAST(z.n AS BIGINT) AS n, {r6('(z.p - ha.p * hb.p / (z.n * (z.n - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (z.n * (z.n - 1) / 2))')} AS ari, {r6('mi / ((ha.h + hb.h) / 2)')} AS nmi FROM z, ha, hb, mi""",
)
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = partitions.agreement(partitions.contingency(table(spark, sf_dir, "documents"), "lang", "source"))
    return own.select("n", rounded("ari").alias("ari"), rounded("nmi").alias("nmi"))


@query(
    "q66_nesting_purity",
    """WITH c AS (SELECT source AS a, lang AS b, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn, sum(n) OVER (PARTITION BY a) AS n_a FROM c)
SELECT a, b AS major, n AS n_major, CAST(n_a AS BIGINT) AS n_a, round((SELECT sum(n) / sum(n_a) FROM m WHERE rn = 1), 6) + 0.0 AS purity FROM m WHERE rn = 1""",
)
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = partitions.contingency(table(spark, sf_dir, "documents"), "source", "lang")
    total = partitions.purity(cells).select(rounded("purity").alias("purity"))
    return partitions.majority(cells).crossJoin(F.broadcast(total))


@query("q67_crosstab_melt", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.crosstab_melted(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", ["de", "en", "es", "fr"])


#: Two labellings of nations in three windows, with some nations in one of them only.
_WINDOW_SQL = """w AS (SELECT * FROM (VALUES ('full', 0), ('jury', 2), ('televote', 4)) v(win, k)),
f AS (SELECT win, n_name AS country, n_regionkey AS fine FROM nation, w WHERE n_nationkey >= k), g AS (SELECT win, n_name AS country, (n_nationkey + k) % 3 AS coarse FROM nation, w WHERE n_nationkey < 25 - k)"""


def _window_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(win, country, fine) and (win, country, coarse)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"), "n_nationkey", "n_regionkey")
    win = nation.withColumn("w", F.explode(F.array(*(F.struct(F.lit(w).alias("win"), F.lit(k).alias("k")) for w, k in (("full", 0), ("jury", 2), ("televote", 4))))))
    key, k = F.col("n_nationkey"), F.col("w.k")
    fine = win.filter(key >= k).select("w.win", "country", F.col("n_regionkey").alias("fine"))
    return fine, win.filter(key < 25 - k).select("w.win", "country", ((key + k) % 3).alias("coarse"))


@query(
    "q68_window_agreement",
    f"""WITH {_WINDOW_SQL}, s AS (SELECT win, country, fine, coarse FROM f JOIN g USING (win, country)), c AS (SELECT win, fine AS a, coarse AS b, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY win, a ORDER BY n DESC, b) AS rn, sum(n) OVER (PARTITION BY win, a) AS n_a FROM c),
x AS (SELECT country, count(*) AS times FROM s JOIN m ON m.win = s.win AND m.a = s.fine AND m.rn = 1 WHERE coarse <> m.b GROUP BY country),
p AS (SELECT win, sum(n) / sum(n_a) AS purity FROM m WHERE rn = 1 GROUP BY win)
SELECT 'purity' AS kind, win AS name, {r6('purity')} AS value FROM p UNION ALL SELECT 'shared', win, CAST(count(*) AS DOUBLE) FROM s GROUP BY win
UNION ALL SELECT 'fine_only', win, CAST(count(*) AS DOUBLE) FROM f ANTI JOIN g USING (win, country) GROUP BY win UNION ALL SELECT 'misfit_windows', n_name, CAST(coalesce(times, 0) AS DOUBLE) FROM nation LEFT JOIN x ON x.country = n_name
UNION ALL SELECT 'repeat_misfits', 'all', CAST(count(*) AS DOUBLE) FROM x WHERE times >= 2 UNION ALL SELECT 'purity_high_everywhere', 'all', CAST(bool_and(purity >= 0.5) AS DOUBLE) FROM p""",
)
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    fine, coarse = _window_labels(spark, sf_dir)
    shared = fine.join(coarse, ["win", "country"])
    purity = partitions.purity(partitions.contingency(shared, "fine", "coarse", "win"), "win")
    wrong = partitions.misfits(shared, "country", "fine", "coarse", "win").groupBy("country").agg(F.count(F.lit(1)).alias("times"))
    number = lambda c: c.cast("double").alias("value")
    return stacked(
        purity.select(F.lit("purity").alias("kind"), F.col("win").alias("name"), rounded("purity").alias("value")),
        shared.groupBy(F.col("win").alias("name")).agg(number(F.count(F.lit(1)))).select(F.lit("shared").alias("kind"), "name", "value"),
        fine.join(coarse, ["win", "country"], "left_anti").groupBy(F.col("win").alias("name")).agg(number(F.count(F.lit(1)))).select(F.lit("fine_only").alias("kind"), "name", "value"),
        nation.join(wrong, "country", "left").select(F.lit("misfit_windows").alias("kind"), F.col("country").alias("name"), number(F.coalesce("times", F.lit(0)))),
        wrong.filter("times >= 2").agg(number(F.count(F.lit(1)))).select(F.lit("repeat_misfits").alias("kind"), F.lit("all").alias("name"), "value"),
        purity.agg(number(F.bool_and(F.col("purity") >= 0.5))).select(F.lit("purity_high_everywhere").alias("kind"), F.lit("all").alias("name"), "value"),
    )


@query(
    "q68_matched_families",
    f"""WITH {_WINDOW_SQL}, s AS (SELECT win, country, coarse FROM f JOIN g USING (win, country)), c AS (SELECT win, coarse, count(*) AS n FROM s GROUP BY ALL)
SELECT win, CAST(sum(n) AS BIGINT) AS n_shared, 1 AS n_families, count(*) AS n_coarse, CAST(0 AS DOUBLE) AS ari, CAST(0 AS DOUBLE) AS nmi, {r6('max(n) / sum(n)')} AS purity, CAST(sum(n) - max(n) AS BIGINT) AS n_exceptions FROM c GROUP BY win""",
)
def q68_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's fine clusters as families against its coarse communities."""
    fine, coarse = _window_labels(spark, sf_dir)
    kin = clustering.families(fine.withColumnRenamed("fine", "label"), "win").withColumnRenamed("label", "fine")
    shared = fine.join(coarse, ["win", "country"]).join(F.broadcast(kin), ["win", "fine"])
    cells = partitions.contingency(shared, "family", "coarse", "win")
    wrong = partitions.misfits(shared, "country", "family", "coarse", "win").groupBy("win").agg(F.count(F.lit(1)).alias("wrong"))
    sizes = shared.groupBy("win").agg(F.count(F.lit(1)).alias("n_shared"), F.count_distinct("family").cast("int").alias("n_families"), F.count_distinct("coarse").alias("n_coarse"))
    own = sizes.join(partitions.agreement(cells, "win"), "win").join(partitions.purity(cells, "win"), "win").join(wrong, "win", "left")
    return own.select("win", "n_shared", "n_families", "n_coarse", *(rounded(c).alias(c) for c in ("ari", "nmi", "purity")), F.coalesce("wrong", F.lit(0)).alias("n_exceptions"))


#: A small gazetteer over the invented words of the documents: name to key.
GAZETTEER = {"the of": "of_the", "and the": "and_the", "de la": "de_la", "le la": "le_la", "und": "und", "the": "the", "token": "token"}
#: Doubled separators let a pattern without lookaround take neighbouring names.
_APART, _DOUBLED = r"[^\p{L}\p{N}_]", r"regexp_replace(lower({}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
_G_PATTERN = rf"(?:^|{_APART})(and  the|de  la|the  of|le  la|token|the|und)(?:$|{_APART})"
_G_KEY = "CASE replace(n, '  ', ' ') " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in GAZETTEER.items()) + " END"


@query(
    "q69_gazetteer_match",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({_DOUBLED.format('text')}, '{_G_PATTERN}', 1) AS ns FROM documents)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(ns, lambda n: {_G_KEY}))), ','), '') AS keys FROM t""",
)
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(textmatch.names_in(F.col("text"), GAZETTEER), ",").alias("keys"))


#: Titles for the country gazetteer: a whole text, the name of a nation and a flag.
_C_TITLE = "text || ' ' || lower(n_name) || ', ' || chr(127462 + CAST(doc_id % 26 AS INTEGER)) || chr(127462 + CAST(doc_id // 26 % 26 AS INTEGER))"
_C_NAMES = "|".join(sorted((n.replace("&", "&&").replace(" ", "  ") for n in gazetteer.NAME_KEYS), key=lambda x: (-len(x), x)))
_C_KEY = "CASE replace(replace(n, '  ', ' '), '&&', '&') " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in gazetteer.NAME_KEYS.items()) + " END"
_C_FLAG = "CASE chr(unicode(f[1]) - 127397) || chr(unicode(f[2]) - 127397) " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in gazetteer.FLAG_KEYS.items()) + " END"


@query(
    "q69_country_gazetteer",
    rf"""WITH d AS (SELECT doc_id, {_C_TITLE} AS title FROM documents JOIN nation ON n_nationkey = doc_id % 25),
t AS (SELECT doc_id, list_transform(regexp_extract_all({_DOUBLED.format('title')}, '(?:^|{_APART})({_C_NAMES})(?:$|{_APART})', 1), lambda n: {_C_KEY}) AS names,
  list_filter(list_transform(regexp_extract_all(title, '[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}'), lambda f: {_C_FLAG}), lambda k: k IS NOT NULL) AS flags FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(names, flags))), ',') AS keys FROM t""",
)
def q69_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(nation, F.col("doc_id") % 25 == F.col("n_nationkey"))
    letters = F.array(*(F.lit(chr(127462 + k)) for k in range(26)))
    flag = F.concat(*(F.element_at(letters, (1 + k % 26).cast("int")) for k in (F.col("doc_id"), F.floor(F.col("doc_id") / 26))))
    title = F.concat_ws(" ", "text", F.concat(F.lower("n_name"), F.lit(",")), flag)
    return docs.select("doc_id", F.array_join(textmatch.names_in(title, gazetteer.NAME_KEYS, gazetteer.FLAG_KEYS), ",").alias("keys"))


@query(
    "q02_display_names",
    f"""WITH r AS (SELECT n_name AS raw FROM nation UNION ALL SELECT ' ' || lower(n_name) FROM nation UNION ALL SELECT * FROM (VALUES ('UK'), ('czechia'), ('FYR Macedonia '), ('The Netherlands'), ('bosnia & herzegovina'), ('Nowhere'), (NULL)) v(raw))
SELECT raw, coalesce(CASE lower(trim(raw)) {' '.join(f"WHEN '{n}' THEN '{gazetteer.DISPLAY[k]}'" for n, k in gazetteer.NAME_KEYS.items())} END, raw) AS shown FROM r""",
)
def q02_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.explode(F.array("n_name", F.concat(F.lit(" "), F.lower("n_name")))).alias("raw"))
    more = spark.createDataFrame([(x,) for x in ("UK", "czechia", "FYR Macedonia ", "The Netherlands", "bosnia & herzegovina", "Nowhere", None)], "raw string")
    return names.union(more).select("raw", gazetteer.display_name(F.col("raw")).alias("shown"))


def _posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents have no title of their own, so the whole text is looked through as one."""
    docs = table(spark, sf_dir, "documents")
    year = (1995 + F.col("doc_id") % 7).cast("int")
    posts = docs.select(F.col("doc_id").alias("slug"), year.alias("year"), F.col("text").alias("title"), "text")
    nation = table(spark, sf_dir, "nation")
    artists = nation.select((1995 + F.col("n_nationkey") % 7).cast("int").alias("year"), F.concat(F.initcap(F.substring("n_name", 1, 2)), F.lit(" ones-haa (2)")).alias("artist"), F.col("n_name").alias("country"))
    return posts, textmatch.artist_index(artists)


_NAMES = {"und": "Und", "de la": "De La", "token": "Token"}
_N_PATTERN = rf"(?:^|{_APART})(de  la|token|und)(?:$|{_APART})"
_N_KEY = "CASE replace(n, '  ', ' ') WHEN 'und' THEN 'Und' WHEN 'de la' THEN 'De La' WHEN 'token' THEN 'Token' END"


_RESOLVED = f"""WITH p AS (SELECT doc_id AS slug, CAST(1995 + doc_id % 7 AS INTEGER) AS year, text AS title, text FROM documents),
a AS (SELECT CAST(1995 + n_nationkey % 7 AS INTEGER) AS year, upper(n_name[1]) || lower(n_name[2]) || ' ones-haa' AS full_name, n_name AS country FROM nation),
k AS (SELECT year, country, lower(unnest(list_filter(regexp_split_to_array(full_name, '[\\s''’\\-]+'), lambda t: len(t) >= 3 AND lower(t) NOT IN ('the', 'dj', 'and', 'feat', 'feat.', 'de', 'van', 'el', 'of', 'for')))) AS tok FROM a),
u AS (SELECT year, tok, min(country) AS country FROM k GROUP BY ALL HAVING count(DISTINCT country) = 1),
fm AS (SELECT slug, list_sort(list(DISTINCT country)) AS names FROM p JOIN a ON a.year = p.year AND contains(lower(title), lower(full_name)) GROUP BY slug),
tm AS (SELECT slug, list_sort(list(DISTINCT country)) AS names FROM (SELECT slug, year, unnest(list_distinct(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+'))) AS tok FROM p) w JOIN u USING (year, tok) GROUP BY slug),
r AS (SELECT p.slug, list_sort(list_distinct(list_transform(regexp_extract_all({_DOUBLED.format('title')}, '{_N_PATTERN}', 1), lambda n: {_N_KEY}))) AS t1, coalesce(fm.names, tm.names, []) AS t2,
  list_sort(list_distinct(list_transform(regexp_extract_all({_DOUBLED.format('left(text, 800)')}, '{_N_PATTERN}', 1), lambda n: {_N_KEY}))) AS t3 FROM p LEFT JOIN fm USING (slug) LEFT JOIN tm USING (slug)),
s AS (SELECT slug, CASE WHEN len(t1) > 0 THEN t1 WHEN len(t2) > 0 THEN t2 WHEN len(t3) > 0 THEN t3 ELSE [NULL] END AS names, CASE WHEN len(t1) > 0 THEN 'title_country' WHEN len(t2) > 0 THEN 'title_artist' WHEN len(t3) > 0 THEN 'text_fallback' ELSE 'none' END AS source FROM r)"""


@query("q70_entity_resolver", f"{_RESOLVED} SELECT slug, unnest(names) AS country, source FROM s")
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, index = _posts(spark, sf_dir)
    return textmatch.resolve(posts, index, _NAMES)


@query(
    "q70_resolver_counts",
    f"""{_RESOLVED} SELECT count(*) AS posts, CAST(sum(len(names)) AS BIGINT) AS "rows", count(*) FILTER (WHERE source = 'none') AS unmatched, count(*) FILTER (WHERE len(names) > 1) AS multi FROM s""",
)
def q70_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, index = _posts(spark, sf_dir)
    return textmatch.resolution_counts(textmatch.resolve(posts, index, _NAMES))


THEMES = [f"theme_{k}" for k in range(10)]
_WINNERS = """yt AS (SELECT year, recipient AS country, sum(points) AS p FROM ballots GROUP BY ALL), win AS (SELECT year, country, row_number() OVER (PARTITION BY year ORDER BY p DESC, country) = 1 AS is_winner FROM yt)"""


@query(
    "q71_theme_distribution",
    f"""WITH {BALLOTS}, {_WINNERS}, e AS (SELECT CAST(1995 + doc_id // 25 AS INTEGER) AS year, n_name AS country, 'theme_' || (list_position(embedding[1:10], list_max(embedding[1:10])) - 1) AS theme
  FROM documents CROSS JOIN (SELECT max(vec_id) + 1 AS nv FROM embeddings) JOIN embeddings ON vec_id = doc_id % nv JOIN nation ON n_nationkey = doc_id % 25),
x AS (SELECT theme, coalesce(is_winner, false) AS w FROM e LEFT JOIN win USING (year, country)), g AS (SELECT 'all' AS grp, theme FROM x UNION ALL SELECT CASE WHEN w THEN 'winners' ELSE 'losers' END, theme FROM x)
SELECT grp, theme, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY grp), 1) + 0.0 AS pct FROM g GROUP BY grp, theme""",
)
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    totals = ballots(spark, sf_dir).groupBy("year", F.col("recipient").alias("country")).agg(F.sum("points").alias("p"))
    win = totals.select("year", "country", (F.row_number().over(Window.partitionBy("year").orderBy(F.desc("p"), "country")) == 1).alias("is_winner"))
    own = entries(spark, sf_dir).select("year", "country", themes.dominant(F.slice("themes", 1, 10), THEMES).alias("theme"))
    rows = own.join(F.broadcast(win), ["year", "country"], "left").na.fill(False, ["is_winner"])
    domain = spark.createDataFrame([(t,) for t in THEMES], "theme string")
    return themes.distribution(rows, domain).withColumn("pct", rounded("pct", 1))


@query(
    "q72_twelve_flags",
    f"""WITH {BALLOTS}, e AS (SELECT DISTINCT CAST(1995 + doc_id // 25 AS INTEGER) AS year, n_name AS country FROM documents JOIN nation ON n_nationkey = doc_id % 25),
f AS (SELECT year, recipient AS country, max(CAST(points_type = 'jury' AS INTEGER)) AS j, max(CAST(points_type = 'televote' AS INTEGER)) AS t FROM ballots WHERE points = 12 GROUP BY ALL)
SELECT year, country, coalesce(j, 0) AS jury12, coalesce(t, 0) AS public12 FROM e LEFT JOIN f USING (year, country)""",
)
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.twelve_flags(entries(spark, sf_dir).select("year", "country").distinct(), ballots(spark, sf_dir))


_KEYWORDS = {"love": ["the", "la", "die"], "war": ["of", "de", "und"]}


def _keyword_score(words: list[str]) -> str:
    found = " + ".join(f"len(regexp_extract_all(low, '(?:^|{_APART}){w}(?:$|{_APART})'))" for w in words)
    return f"({found}) / greatest(1, len(list_filter(regexp_split_to_array(cut, '\\s+'), lambda x: x <> '')))"


@query(
    "q71_theme_scores",
    f"""WITH c AS (SELECT doc_id, lower(left(text, 2500)) AS cut FROM documents), d AS (SELECT *, {_DOUBLED.format('cut')} AS low FROM c),
s AS (SELECT doc_id, {_keyword_score(_KEYWORDS['love'])} AS love, {_keyword_score(_KEYWORDS['war'])} AS war FROM d)
SELECT doc_id, CASE WHEN love >= war THEN 'love' ELSE 'war' END AS theme, {r6('greatest(love, war)')} AS score FROM s""",
)
def q71_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable scorer over texts, with the deterministic keyword model."""
    words = _KEYWORDS
    own = themes.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", list(words), lambda s: themes.keyword_scores(s, words))
    scores = F.array(F.col("scores")["love"], F.col("scores")["war"])
    return own.select("doc_id", themes.dominant(scores, list(words)).alias("theme"), rounded(F.array_max(scores)).alias("score"))


@query(
    "q73_json_fields",
    """SELECT event_id, try_cast(props->>'$.k' AS DOUBLE) AS k, coalesce(nullif(trim(props->>'$.missing'), ''), event_type) AS label FROM events WHERE try_cast(props->>'$.k' AS DOUBLE) IS NOT NULL""",
)
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string, string>").alias("p"))
    k = F.expr("try_cast(p['k'] AS double)")
    label = F.coalesce(F.expr("nullif(trim(p['missing']), '')"), F.col("event_type"))
    return rows.select("event_id", k.alias("k"), label.alias("label")).filter("k IS NOT NULL")


@query(
    "q74_markdown_table",
    """WITH b AS (SELECT r_regionkey, r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT 1 AS line_no, '| r_regionkey | r_name | nations |' AS line UNION ALL SELECT 2, '| --- | --- | --- |'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_regionkey) + 2 AS INTEGER), '| ' || r_regionkey || ' | ' || r_name || ' | ' || nations || ' |' FROM b""",
)
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"))
    rows = table(spark, sf_dir, "region").join(nation, "r_regionkey").select("r_regionkey", "r_name", "nations")
    return markdown_lines(rows, ["r_regionkey"])


@query("q75_score_regression")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = [f"f{k}" for k in range(10)]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score"), *(F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(features)))
    own = regression.score_regression(rows, features, "score")
    return own.select("term", *(rounded(c).alias(c) for c in ("coefficient", "mse", "r2")))
