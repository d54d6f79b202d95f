"""Queries over dyad panels: inference and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.functions.numeric import format_p, rounded
from affinia.operators import grids, inference, regression, similarity
from affinia.plans.base import BALLOTS, ORACLES, PANEL, ballots, perms, query, r6, split_ballots
from affinia.sources.shared import written
from affinia.sources.tables import entries, labels, stacked

#: The published numbers of draws of each test.
QAP_DRAWS, BOOTSTRAP_DRAWS, NAIVE_DRAWS, MRQAP_DRAWS = 20_000, 5_000, 2_000, 2_000


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.gap_panel(split_ballots(spark, sf_dir), labels(spark, sf_dir))


@query("q31_dyad_grid", f"WITH {BALLOTS} SELECT a.year, a.voter, b.recipient FROM (SELECT DISTINCT year, voter FROM ballots) a JOIN (SELECT DISTINCT year, recipient FROM ballots) b ON a.year = b.year AND a.voter <> b.recipient")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.group_grid(ballots(spark, sf_dir))


@query("q32_gap_panel", f"WITH {BALLOTS}, {PANEL} SELECT * REPLACE (CAST(from_label AS INTEGER) AS from_label, CAST(to_label AS INTEGER) AS to_label) FROM panel")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(spark, sf_dir)


_STATS = ["mean_jury", "mean_televote", "mean_gap", "median_gap", "sd_gap", "share_nonzero", "share_jury_top", "share_televote_top"]


@query(
    "q33_group_summary",
    f"""WITH {BALLOTS}, {PANEL} SELECT CASE WHEN same THEN 'within_bloc' ELSE 'between_bloc' END AS "group", count(*) AS n_pair_years, {r6('avg(jury)')} AS mean_jury, {r6('avg(tele)')} AS mean_televote, {r6('avg(gap)')} AS mean_gap,
{r6('median(gap)')} AS median_gap, {r6('stddev_samp(gap)')} AS sd_gap, {r6('avg(CAST(gap <> 0 AS DOUBLE))')} AS share_nonzero, {r6('avg(CAST(jury >= 10 AS DOUBLE))')} AS share_jury_top, {r6('avg(CAST(tele >= 10 AS DOUBLE))')} AS share_televote_top FROM panel GROUP BY same""",
)
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.group_summary(panel_of(spark, sf_dir))
    return own.select("group", "n_pair_years", *(rounded(c).alias(c) for c in _STATS))


@query(
    "q34_bloc_breakdown",
    f"""WITH {BALLOTS}, {PANEL}, m AS (SELECT label, string_agg(country, ', ' ORDER BY country) AS members FROM labels GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, members, count(*) AS n_dyad_years, {r6('avg(jury)')} AS mean_jury, {r6('avg(tele)')} AS mean_televote, {r6('avg(gap)')} AS mean_gap FROM panel JOIN m ON label = from_label WHERE same GROUP BY ALL ORDER BY mean_gap""",
)
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.bloc_breakdown(panel_of(spark, sf_dir), labels(spark, sf_dir))
    return own.select("label", "members", "n_dyad_years", *(rounded(c).alias(c) for c in ("mean_jury", "mean_televote", "mean_gap"))).orderBy("mean_gap")


@query(
    "q35_yearly_breakdown",
    f"""WITH {BALLOTS}, {PANEL}, y AS (SELECT year, count(*) FILTER (WHERE same) AS n_within, count(*) FILTER (WHERE NOT same) AS n_between, avg(gap) FILTER (WHERE same) AS w, avg(gap) FILTER (WHERE NOT same) AS b FROM panel GROUP BY year)
SELECT year, n_within, n_between, {r6('w')} AS mean_gap_within, {r6('b')} AS mean_gap_between, {r6('w - b')} AS t FROM y""",
)
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.yearly_breakdown(panel_of(spark, sf_dir))
    return own.select("year", "n_within", "n_between", *(rounded(c).alias(c) for c in ("mean_gap_within", "mean_gap_between", "t")))


@query(
    "q36_bloc_dispersion",
    f"""WITH {BALLOTS}, {PANEL}, m AS (SELECT from_label, avg(gap) AS m, count(*) AS n, sum(gap) AS s FROM panel WHERE same GROUP BY ALL HAVING count(*) >= 20), g AS (SELECT sum(s) / sum(n) AS g FROM m)
SELECT round(CASE WHEN count(*) >= 2 THEN sqrt(sum(pow(m - g, 2) * n) / sum(n)) END, 6) + 0.0 AS sd FROM m, g""",
)
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.dispersion(panel_of(spark, sf_dir), "gap", 20).select(rounded("sd").alias("sd"))


_NULL = f"""{perms('qap', QAP_DRAWS)},
dy AS (SELECT voter, recipient, sum(gap) AS gap, sum(top_gap) AS top_gap, count(*) AS n FROM panel GROUP BY ALL),
pd AS (SELECT x.draw, gap, top_gap, n, x.label = y.label AS s FROM dy JOIN perms x ON x.node = voter JOIN perms y ON y.node = recipient AND y.draw = x.draw),
nul AS (SELECT draw, sum(gap) FILTER (WHERE s) / sum(n) FILTER (WHERE s) - sum(gap) FILTER (WHERE NOT s) / sum(n) FILTER (WHERE NOT s) AS gap,
  sum(top_gap) FILTER (WHERE s) / sum(n) FILTER (WHERE s) - sum(top_gap) FILTER (WHERE NOT s) / sum(n) FILTER (WHERE NOT s) AS top_gap FROM pd GROUP BY draw)"""


@query("q37_qap_null", f"WITH {BALLOTS}, {PANEL}, {_NULL} SELECT CAST(draw AS INTEGER) AS draw, {r6('gap')} AS gap, {r6('top_gap')} AS top_gap FROM nul")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.label_null(spark, panel_of(spark, sf_dir), labels(spark, sf_dir), QAP_DRAWS, "qap", "gap", "top_gap")
    return own.select("draw", rounded("gap").alias("gap"), rounded("top_gap").alias("top_gap"))


@query(
    "q38_qap_test",
    f"""WITH {BALLOTS}, {PANEL}, {_NULL}, u AS (SELECT 'gap' AS outcome, round(gap, 9) AS x FROM nul UNION ALL SELECT 'top_gap', round(top_gap, 9) FROM nul),
o AS (SELECT 'gap' AS outcome, round(avg(gap) FILTER (WHERE same) - avg(gap) FILTER (WHERE NOT same), 9) AS o FROM panel UNION ALL SELECT 'top_gap', round(avg(top_gap) FILTER (WHERE same) - avg(top_gap) FILTER (WHERE NOT same), 9) FROM panel)
SELECT outcome, {r6('max(o)')} AS observed, {r6('stddev_samp(x)')} AS null_sd, {r6('(count(*) FILTER (WHERE abs(x) >= abs(o)) + 1) / (count(*) + 1)')} AS p_value, {r6('max(o) / stddev_samp(x)')} AS z, {r6('2.8 * stddev_samp(x)')} AS mde
FROM u JOIN o USING (outcome) GROUP BY outcome""",
)
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_of(spark, sf_dir)
    null = inference.label_null(spark, panel, labels(spark, sf_dir), QAP_DRAWS, "qap", "gap", "top_gap")
    seen = inference.observed(panel, "gap", "top_gap")
    parts = [inference.permutation_test(null, seen.filter(F.col("value") == v), v).select(F.lit(v).alias("outcome"), *(rounded(c).alias(c) for c in ("observed", "null_sd", "p_value", "z", "mde"))) for v in ("gap", "top_gap")]
    return parts[0].unionByName(parts[1])


@query(
    "q39_qap_dispersion",
    f"""WITH {BALLOTS}, {PANEL}, {perms('disp', QAP_DRAWS)}, dy AS (SELECT voter, recipient, sum(gap) AS gap, count(*) AS n FROM panel GROUP BY ALL),
m AS (SELECT x.draw, x.label, sum(gap) AS s, sum(n) AS n FROM dy JOIN perms x ON x.node = voter JOIN perms y ON y.node = recipient AND y.draw = x.draw WHERE x.label = y.label GROUP BY ALL),
c AS (SELECT *, s / n AS m, sum(s) OVER (PARTITION BY draw) / sum(n) OVER (PARTITION BY draw) AS g FROM m), d AS (SELECT draw, CASE WHEN count(*) >= 2 THEN sqrt(sum(pow(m - g, 2) * n) / sum(n)) END AS sd FROM c GROUP BY draw),
om AS (SELECT from_label, sum(gap) AS s, count(*) AS n FROM panel WHERE same GROUP BY ALL), og AS (SELECT sum(s) / sum(n) AS g FROM om), o AS (SELECT sqrt(sum(pow(s / n - g, 2) * n) / sum(n)) AS o FROM om, og)
SELECT {r6('max(o)')} AS observed, {r6('avg(sd)')} AS null_mean, {r6('(count(*) FILTER (WHERE round(sd, 9) >= round(o, 9)) + 1) / (count(*) + 1)')} AS p_value, count(*) AS n_draws FROM d, o WHERE sd IS NOT NULL""",
)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.dispersion_test(spark, panel_of(spark, sf_dir), labels(spark, sf_dir), QAP_DRAWS, "disp")
    return own.select(*(rounded(c).alias(c) for c in ("observed", "null_mean", "p_value")), "n_draws")


@query(
    "q40_naive_permutation",
    f"""WITH {BALLOTS}, {PANEL}, r AS (SELECT year || '|' || voter || '|' || recipient AS k, gap, same, row_number() OVER (ORDER BY year || '|' || voter || '|' || recipient) AS place FROM panel),
p AS (SELECT draw, same AS s, row_number() OVER (PARTITION BY draw ORDER BY md5('naive:' || draw || ':' || k)) AS place FROM r, (SELECT unnest(range({NAIVE_DRAWS})) AS draw))
SELECT CAST(draw AS INTEGER) AS draw, round(avg(gap) FILTER (WHERE s) - avg(gap) FILTER (WHERE NOT s), 6) + 0.0 AS stat FROM p JOIN r USING (place) GROUP BY draw""",
)
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.naive_null(spark, panel_of(spark, sf_dir), NAIVE_DRAWS, "naive").select("draw", rounded("stat").alias("stat"))


@query(
    "q41_node_bootstrap_ci",
    f"""WITH {BALLOTS}, {PANEL}, i AS (SELECT country, row_number() OVER (ORDER BY country) - 1 AS place FROM labels), z AS (SELECT count(*) AS size FROM i),
b AS (SELECT draw, i2.country AS node, count(*) AS times FROM (SELECT draw, CAST('0x' || substr(md5('boot:' || draw || ':' || place), 1, 8) AS BIGINT) % size AS pick FROM i, z, (SELECT unnest(range({BOOTSTRAP_DRAWS})) AS draw)) JOIN i i2 ON i2.place = pick GROUP BY ALL),
dy AS (SELECT voter, recipient, same, sum(gap) AS gap, count(*) AS n FROM panel GROUP BY ALL),
w AS (SELECT x.draw, same, gap * x.times * y.times AS g, n * x.times * y.times AS n FROM dy JOIN b x ON x.node = voter JOIN b y ON y.node = recipient AND y.draw = x.draw),
s AS (SELECT draw, sum(g) FILTER (WHERE same) / sum(n) FILTER (WHERE same) - sum(g) FILTER (WHERE NOT same) / sum(n) FILTER (WHERE NOT same) AS stat FROM w GROUP BY draw)
SELECT {r6('quantile_cont(stat, 0.025)')} AS ci_low, {r6('quantile_cont(stat, 0.975)')} AS ci_high, count(*) AS n_draws FROM s WHERE stat IS NOT NULL""",
)
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inference.interval(inference.node_bootstrap(spark, panel_of(spark, sf_dir), labels(spark, sf_dir), BOOTSTRAP_DRAWS, "boot"))
    return own.select(rounded("ci_low").alias("ci_low"), rounded("ci_high").alias("ci_high"), "n_draws")


@query(
    "q42_cliffs_delta",
    f"""WITH {BALLOTS}, {PANEL}, a AS (SELECT gap, count(*) AS n FROM panel WHERE same GROUP BY gap), b AS (SELECT gap, count(*) AS n FROM panel WHERE NOT same GROUP BY gap), s AS (SELECT (SELECT sum(n) FROM a) AS na, (SELECT sum(n) FROM b) AS nb)
SELECT CAST(max(na) AS BIGINT) AS n_within, CAST(max(nb) AS BIGINT) AS n_between, round(sum(a.n * b.n * sign(a.gap - b.gap)) / max(na * nb), 6) + 0.0 AS delta FROM a, b, s""",
)
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.cliffs_delta(panel_of(spark, sf_dir)).withColumn("delta", rounded("delta"))


def _bootstrap_sql(value: str) -> str:
    return ORACLES["q41_node_bootstrap_ci"].replace("sum(gap) AS gap, count(*) AS n FROM panel GROUP BY ALL),\nw AS", f"sum({value}) AS gap, count(*) AS n FROM panel GROUP BY ALL),\nw AS")


def _least_sql(least: int) -> str:
    """The dispersion test for labels of so many dyads at least."""
    own = ORACLES["q39_qap_dispersion"].replace("WHERE x.label = y.label GROUP BY ALL)", f"WHERE x.label = y.label GROUP BY ALL HAVING sum(n) >= {least})")
    return own.replace("FROM panel WHERE same GROUP BY ALL), og", f"FROM panel WHERE same GROUP BY ALL HAVING count(*) >= {least}), og")


_PAIR = ("gap", "top_gap")
_TESTED = {
    "tests": ORACLES["q38_qap_test"], "panel_rows": ORACLES["q32_gap_panel"], "spread": ORACLES["q39_qap_dispersion"], "spread20": _least_sql(20),
    "naive": ORACLES["q40_naive_permutation"], "cliff": ORACLES["q42_cliffs_delta"], **{f"boot_{v}": _bootstrap_sql(v) for v in _PAIR},
}
_RESULTS = f"WITH {', '.join(f'{name} AS MATERIALIZED ({sql})' for name, sql in _TESTED.items())} " + " UNION ALL ".join(
    [f"SELECT '{name}_{v}' AS quantity, {column} AS value FROM tests WHERE outcome = '{v}'" for name, column in (("observed_T", "observed"), ("qap_p", "p_value"), ("qap_null_sd", "null_sd")) for v in _PAIR]
    + [f"SELECT 'bootstrap_{side}_{v}', {side} FROM boot_{v}" for side in ("ci_low", "ci_high") for v in _PAIR]
    + [f"SELECT '{name}', {column} FROM spread" for name, column in (("bloc_dispersion_observed", "observed"), ("bloc_dispersion_null_mean", "null_mean"), ("bloc_dispersion_p", "p_value"))]
    + [f"SELECT '{name}', {column} FROM spread20" for name, column in (("bloc_dispersion_observed_min20", "observed"), ("bloc_dispersion_p_min20", "p_value"))]
    + [
        f"SELECT 'naive_permutation_p_gap', {r6('(count(*) FILTER (WHERE abs(round(stat, 6)) >= abs(round(observed, 6))) + 1) / (count(*) + 1)')} FROM naive, (SELECT observed FROM tests WHERE outcome = 'gap')",
        "SELECT 'cliffs_delta_gap', delta FROM cliff",
        "SELECT 'mde_80pct_power_gap', mde FROM tests WHERE outcome = 'gap'",
        "SELECT 'n_dyad_years', CAST(count(*) AS DOUBLE) FROM panel_rows",
        "SELECT 'n_countries', CAST(count(*) AS DOUBLE) FROM (SELECT voter FROM panel_rows UNION SELECT recipient FROM panel_rows)",
        f"SELECT 'n_permutations', {QAP_DRAWS}.0",
    ]
)


@query("q38_results_table", _RESULTS)
def q38_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of the panel as one table of quantities and values."""
    panel, own = written(panel_of(spark, sf_dir), "panel"), labels(spark, sf_dir)
    null = written(inference.label_null(spark, panel, own, QAP_DRAWS, "qap", *_PAIR), "null")
    seen = inference.observed(panel, *_PAIR)
    tests = {v: inference.permutation_test(null, seen.filter(F.col("value") == v), v) for v in _PAIR}
    parts = [inference.quantities(tests[v], {f"observed_T_{v}": "observed", f"qap_p_{v}": "p_value", f"qap_null_sd_{v}": "null_sd"}) for v in _PAIR]
    parts += [inference.quantities(inference.interval(inference.node_bootstrap(spark, panel, own, BOOTSTRAP_DRAWS, "boot", v)), {f"bootstrap_ci_low_{v}": "ci_low", f"bootstrap_ci_high_{v}": "ci_high"}) for v in _PAIR]
    for least, end in ((1, ""), (20, "_min20")):
        spread = inference.dispersion_test(spark, panel, own, QAP_DRAWS, "disp", "gap", least)
        names = {f"bloc_dispersion_observed{end}": "observed", f"bloc_dispersion_null_mean{end}": "null_mean", f"bloc_dispersion_p{end}": "p_value"}
        parts.append(inference.quantities(spread, {k: c for k, c in names.items() if not end or c != "null_mean"}))
    naive = inference.naive_null(spark, panel, NAIVE_DRAWS, "naive").crossJoin(F.broadcast(seen.filter("value = 'gap'").select("observed")))
    parts.append(inference.quantities(naive.agg(inference.two_sided_p(F.round("stat", 6), F.round("observed", 6)).alias("p")), {"naive_permutation_p_gap": "p"}))
    parts.append(inference.quantities(inference.cliffs_delta(panel), {"cliffs_delta_gap": "delta"}))
    parts.append(inference.quantities(tests["gap"], {"mde_80pct_power_gap": "mde"}))
    nodes = panel.select(F.explode(F.array("voter", "recipient")).alias("node")).agg(F.count_distinct("node").alias("n"))
    parts += [inference.quantities(panel.agg(F.count(F.lit(1)).alias("n")), {"n_dyad_years": "n"}), inference.quantities(nodes, {"n_countries": "n"})]
    parts.append(spark.createDataFrame([("n_permutations", float(QAP_DRAWS))], "quantity string, value double"))
    return stacked(*parts).select("quantity", rounded("value").alias("value"))


@query("q38_shown_p", f"SELECT outcome, CASE WHEN p_value <= 1.0 / {QAP_DRAWS + 1} THEN printf('< %.5f', 1.0 / {QAP_DRAWS + 1}) ELSE printf('%.4f', p_value) END AS shown FROM ({ORACLES['q38_qap_test']})")
def q38_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q38(spark, sf_dir).select("outcome", format_p(F.col("p_value"), QAP_DRAWS).alias("shown"))


# ---- features of entries

_ACC, _PLAIN = "éóèñüçäöêíáúàâîôûëïÉÓÈÑÜÇÄÖÊÍÁÚÀÂÎÔÛËÏ", "eoenucaoeiauaaioueiEOENUCAOEIAUAAIOUEI"
ENTRIES = """n_vec AS (SELECT max(vec_id) + 1 AS nv FROM embeddings),
entries AS (SELECT CAST(1995 + doc_id // 25 AS INTEGER) AS year, n_name AS country, text AS lyrics,
  upper(lang[1]) || lang[2:] || CASE WHEN doc_id % 3 = 0 THEN '/English (live)' ELSE ' (studio)' END AS language, embedding AS themes
  FROM documents CROSS JOIN n_vec JOIN embeddings ON vec_id = doc_id % nv JOIN nation ON n_nationkey = doc_id % 25)"""
LANGS = """langs AS (SELECT year, country, list_distinct(list_filter(list_transform(string_split(split_part(language, '(', 1), '/'), lambda x: lower(trim(x))), lambda x: x <> '')) AS l FROM entries),
flags AS (SELECT x.year, x.country AS a, y.country AS b, CAST(len(list_intersect(x.l, y.l)) > 0 AS DOUBLE) AS shared_language,
  CAST(len(list_filter(list_intersect(x.l, y.l), lambda z: z <> 'english')) > 0 AS DOUBLE) AS shared_non_english FROM langs x JOIN langs y ON x.year = y.year AND x.country < y.country)"""
THEME = """tv AS (SELECT year, country, unnest(range(1, 65)) AS dim, CAST(unnest(themes) AS DOUBLE) AS x FROM entries),
tz AS (SELECT year, country, dim, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END AS z FROM tv WINDOW w AS (PARTITION BY year, dim)),
tn AS (SELECT year, country, sqrt(sum(z * z)) AS n FROM tz GROUP BY ALL),
theme AS (SELECT x.year, x.country AS a, y.country AS b, coalesce(sum(x.z * y.z) / nullif(max(nx.n) * max(ny.n), 0), 0) AS sim FROM tz x JOIN tz y ON x.year = y.year AND x.dim = y.dim AND x.country < y.country
  JOIN tn nx ON nx.year = x.year AND nx.country = x.country JOIN tn ny ON ny.year = y.year AND ny.country = y.country GROUP BY ALL)"""
TFIDF = f"""tok AS (SELECT year, country, unnest(regexp_extract_all(lower(translate(lyrics, '{_ACC}', '{_PLAIN}')), '([a-z0-9_]{{2,}})', 1)) AS term FROM entries),
tf AS (SELECT year, country, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT year, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2), nd AS (SELECT year, count(*) AS n FROM entries GROUP BY year),
tw AS (SELECT tf.year, country, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.year = tf.year AND df.term = tf.term JOIN nd ON nd.year = tf.year),
wn AS (SELECT year, country, sqrt(sum(w * w)) AS n FROM tw GROUP BY ALL),
wd AS (SELECT x.year, x.country AS a, y.country AS b, sum(x.w * y.w) AS d FROM tw x JOIN tw y ON x.year = y.year AND x.term = y.term AND x.country < y.country GROUP BY ALL),
tfidf AS (SELECT x.year, x.country AS a, y.country AS b, coalesce(d / nullif(nx.n * ny.n, 0), 0) AS sim FROM entries x JOIN entries y ON x.year = y.year AND x.country < y.country
  LEFT JOIN wd ON wd.year = x.year AND wd.a = x.country AND wd.b = y.country LEFT JOIN wn nx ON nx.year = x.year AND nx.country = x.country LEFT JOIN wn ny ON ny.year = y.year AND ny.country = y.country)"""


@query("q43_language_flags", f"WITH {ENTRIES}, {LANGS} SELECT * FROM flags")
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.language_flags(entries(spark, sf_dir))


@query("q44_theme_similarity", f"WITH {ENTRIES}, {THEME} SELECT year, a, b, {r6('sim')} AS sim FROM theme")
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.theme_similarity(entries(spark, sf_dir)).select("year", "a", "b", rounded("sim").alias("sim"))


@query("q45_tfidf_similarity", f"WITH {ENTRIES}, {TFIDF} SELECT year, a, b, {r6('sim')} AS sim FROM tfidf")
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.tfidf_similarity(entries(spark, sf_dir)).select("year", "a", "b", rounded("sim").alias("sim"))


CAUSAL = f"""{PANEL}, {ENTRIES}, {LANGS}, {THEME}, {TFIDF},
c0 AS (SELECT p.*, t.sim AS theme, f.sim AS tfidf, shared_language, shared_non_english FROM panel p JOIN theme t ON t.year = p.year AND t.a = least(voter, recipient) AND t.b = greatest(voter, recipient)
  JOIN tfidf f ON f.year = p.year AND f.a = t.a AND f.b = t.b JOIN flags l ON l.year = p.year AND l.a = t.a AND l.b = t.b),
hold AS (SELECT n_name AS country, n_nationkey % 3 AS label FROM nation WHERE n_nationkey < 20),
causal AS (SELECT c0.year, voter, recipient, jury, tele, jury + tele AS points, CAST(same AS DOUBLE) AS same_bloc, CAST(coalesce(h.label = k.label, false) AS DOUBLE) AS same_holdout, h.label IS NOT NULL AND k.label IS NOT NULL AS has_holdout,
  theme, tfidf, shared_language, shared_non_english, (theme - avg(theme) OVER ()) / stddev_samp(theme) OVER () AS theme_z, (tfidf - avg(tfidf) OVER ()) / stddev_samp(tfidf) OVER () AS tfidf_z, recipient || '_' || c0.year AS to_year
  FROM c0 LEFT JOIN hold h ON h.country = voter LEFT JOIN hold k ON k.country = recipient)"""


def causal_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    hold = labels(spark, sf_dir, "key").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 20").select(F.col("n_name").alias("country"))), "country", "left_semi")
    votes = split_ballots(spark, sf_dir)
    return regression.causal_panel(votes, labels(spark, sf_dir), hold, entries(spark, sf_dir, votes))


@query(
    "q46_similarity_validity",
    f"""WITH {BALLOTS}, {CAUSAL}, s AS (SELECT 'all dyads' AS subset, * FROM causal UNION ALL SELECT CASE WHEN shared_language > 0 THEN 'dyads sharing a language' ELSE 'dyads sharing no language' END, * FROM causal)
SELECT subset, count(*) AS n, {r6('corr(theme, tfidf)')} AS corr_theme_vs_tfidf, {r6('stddev_samp(theme)')} AS sd_theme, {r6('stddev_samp(tfidf)')} AS sd_tfidf FROM s GROUP BY subset HAVING count(*) >= 3""",
)
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = causal_of(spark, sf_dir)
    groups = F.explode(F.array(F.lit("all dyads"), F.when(F.col("shared_language") > 0, "dyads sharing a language").otherwise("dyads sharing no language")))
    out = own.select(groups.alias("subset"), "theme", "tfidf").groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.corr("theme", "tfidf")).alias("corr_theme_vs_tfidf"), rounded(F.stddev_samp("theme")).alias("sd_theme"), rounded(F.stddev_samp("tfidf")).alias("sd_tfidf")
    )
    return out.filter("n >= 3")


@query(
    "q47_vector_duplication",
    f"""WITH {ENTRIES}, v AS (SELECT year, list_transform(themes[1:2], lambda x: round(CAST(x AS DOUBLE), 0) + 0.0) AS v, count(*) AS n FROM entries GROUP BY ALL)
SELECT year, CAST(sum(n) AS BIGINT) AS n_entries, count(*) AS n_unique_vectors, {r6('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)')} AS share_in_duplicate_group, max(n) AS largest_duplicate_group FROM v GROUP BY year""",
)
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).select("year", F.slice("themes", 1, 2).alias("v2"))
    own = similarity.vector_duplication(rows, "year", "v2", 0)
    return own.withColumn("share_in_duplicate_group", rounded("share_in_duplicate_group"))


_NUM = ["theme", "tfidf", "theme_z", "tfidf_z"]


@query("q48_causal_panel", f"WITH {BALLOTS}, {CAUSAL} SELECT * REPLACE ({', '.join(f'{r6(c)} AS {c}' for c in _NUM)}) FROM causal")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_of(spark, sf_dir).withColumns({c: rounded(c) for c in _NUM})


@query(
    "q49_ols_year_fe",
    f"""WITH {BALLOTS}, {CAUSAL}, d AS (SELECT points AS y, points - avg(points) OVER (PARTITION BY year) AS yd, same_bloc - avg(same_bloc) OVER (PARTITION BY year) AS xd FROM causal),
s AS (SELECT sum(xd * yd) AS xy, sum(xd * xd) AS xx, sum(yd * yd) AS yy, var_pop(y) * count(*) AS sst, count(*) AS n FROM d)
SELECT {r6('xy / xx')} AS coefficient, n, {r6('1 - (yy - xy * xy / xx) / sst')} AS r2 FROM s""",
)
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regression.year_effects(causal_of(spark, sf_dir))
    return own.select(rounded("coefficient").alias("coefficient"), "n", rounded("r2").alias("r2"))


@query("q50_ols_models_cluster_se")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.tidy(regression.fit_models(causal_of(spark, sf_dir)))


@query("q51_attenuation")
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.attenuation(regression.fit_models(causal_of(spark, sf_dir)), "M1").withColumn("ratio", rounded("ratio"))


@query(
    "q52_mrqap_year_fe",
    f"""WITH {BALLOTS}, {CAUSAL}, {perms('mrqap', MRQAP_DRAWS)}, o AS (SELECT year, voter, recipient, points - avg(points) OVER (PARTITION BY year) AS yd FROM causal),
y AS (SELECT x.draw, year, sum(CAST(x.label = z.label AS DOUBLE) * yd) AS xy, sum(CAST(x.label = z.label AS DOUBLE)) AS x, count(*) AS n FROM o JOIN perms x ON x.node = voter JOIN perms z ON z.node = recipient AND z.draw = x.draw GROUP BY ALL),
c AS (SELECT draw, sum(xy) / nullif(sum(x - x * x / n), 0) AS c FROM y GROUP BY draw),
d AS (SELECT yd, same_bloc - avg(same_bloc) OVER (PARTITION BY causal.year) AS xd FROM causal JOIN o USING (year, voter, recipient)), b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b FROM d)
SELECT {r6('max(b)')} AS observed, {r6('(count(*) FILTER (WHERE abs(round(c, 9)) >= abs(round(b, 9))) + 1) / (count(c) + 1)')} AS p_value, count(c) AS n_draws FROM c, b""",
)
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = causal_of(spark, sf_dir)
    null = regression.label_permutation_coefficients(spark, panel, labels(spark, sf_dir), MRQAP_DRAWS, "mrqap")
    seen = regression.year_effects(panel).select(F.round("coefficient", 9).alias("b"))
    rows = null.select(F.round("coefficient", 9).alias("c")).crossJoin(F.broadcast(seen))
    return rows.agg(rounded(F.max("b")).alias("observed"), rounded(inference.two_sided_p(F.col("c"), F.col("b"))).alias("p_value"), F.count("c").alias("n_draws"))


@query("q52_mrqap_song_fe")
def q52_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = written(causal_of(spark, sf_dir), "causal-panel")
    null = regression.song_permutation_coefficients(spark, panel, labels(spark, sf_dir), MRQAP_DRAWS, "mrqap")
    p = inference.two_sided_p(F.round("coefficient", 9), F.round("observed", 9))
    return null.agg(rounded(F.max("observed")).alias("observed"), rounded(p).alias("p_value"), F.count("coefficient").alias("n_draws"))
