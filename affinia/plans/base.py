"""Registry of queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinia.operators.clean import in_window
from affinia.sources.shared import exists, written
from affinia.sources.tables import FIRST_YEAR, LAST_YEAR, SPLIT_YEAR, raw_ballots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Vote facts that this process has written, by session and folder.
_FACTS: dict[tuple[str, str], DataFrame] = {}
KEY = ["edition", "year", "points_type", "voter", "recipient", "points"]
WINDOWS = {"full": (FIRST_YEAR, LAST_YEAR, None), "jury": (SPLIT_YEAR, LAST_YEAR, ["jury"]), "televote": (SPLIT_YEAR, LAST_YEAR, ["televote"])}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote fact of the tables, equal rows once: at most nations^2 x years x kinds x points rows at any
    scale. It is a rollup of the order lines that is written once a session, for further queries too, until
    ``shared.free`` removes it or ``forget`` drops it, as is needed where the tables change."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FACTS or not exists(_FACTS[at]):
        _FACTS[at] = written(raw_ballots(spark, sf_dir).filter("voter <> recipient").dropDuplicates(KEY), "ballots")
    return _FACTS[at]


def forget() -> None:
    """Make the vote facts anew when they are next asked for."""
    _FACTS.clear()


def split_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_window(ballots(spark, sf_dir), SPLIT_YEAR, LAST_YEAR, ["jury", "televote"])


def windowed(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    return in_window(ballots(spark, sf_dir), *WINDOWS[window])


# ---- SQL that the oracles share

BALLOTS = """
ballots AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || 'f' AS edition, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE l_returnflag WHEN 'N' THEN 'combined' WHEN 'A' THEN 'jury' WHEN 'R' THEN 'televote' END AS points_type,
  vn.n_name AS voter, rn.n_name AS recipient, l_quantity AS points
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation vn ON c_nationkey = vn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation rn ON s_nationkey = rn.n_nationkey
  WHERE l_quantity IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12) AND vn.n_name <> rn.n_name)"""
COUNTRIES = "countries AS (SELECT voter AS country FROM ballots UNION SELECT recipient FROM ballots)"
OPPORTUNITY = """
opportunity AS (SELECT a.voter, b.recipient, count(*) AS n FROM (SELECT DISTINCT year, voter FROM ballots) a
  JOIN (SELECT DISTINCT year, recipient FROM ballots) b ON a.year = b.year AND a.voter <> b.recipient GROUP BY ALL)"""
RATES = f"""{OPPORTUNITY},
totals AS (SELECT voter, recipient, sum(points) AS points FROM ballots GROUP BY ALL),
rates AS (SELECT o.voter, o.recipient, n, coalesce(points, 0) / n AS rate FROM opportunity o LEFT JOIN totals t ON o.voter = t.voter AND o.recipient = t.recipient)"""
PROFILES = f"""{RATES},
eligible AS (SELECT voter FROM ballots GROUP BY voter HAVING count(DISTINCT year) >= 4),
profiles AS (SELECT voter, recipient, rate, rate - avg(rate) OVER (PARTITION BY recipient) AS centred FROM rates WHERE voter IN (SELECT voter FROM eligible))"""
COSINE = f"""{PROFILES},
norms AS (SELECT voter, sqrt(sum(centred * centred)) AS norm FROM profiles GROUP BY voter),
dots AS (SELECT x.voter AS a, y.voter AS b, sum(x.centred * y.centred) AS dot FROM profiles x JOIN profiles y ON x.recipient = y.recipient AND x.voter < y.voter GROUP BY ALL),
pairs AS (SELECT x.voter AS a, y.voter AS b, coalesce(dot / nullif(x.norm * y.norm, 0), 0) AS sim FROM norms x JOIN norms y ON x.voter < y.voter
  LEFT JOIN dots ON dots.a = x.voter AND dots.b = y.voter),
dist AS (SELECT a, b, greatest(0.0, 1 - sim) AS dist FROM pairs UNION ALL SELECT b, a, greatest(0.0, 1 - sim) FROM pairs)"""
LABELS = "labels AS (SELECT n_name AS country, n_regionkey AS label FROM nation)"
SPLIT = "split AS (SELECT * FROM ballots WHERE year BETWEEN 1998 AND 2001 AND points_type IN ('jury', 'televote'))"
PANEL = f"""{SPLIT}, {LABELS},
grid AS (SELECT a.year, a.voter, b.recipient FROM (SELECT DISTINCT year, voter FROM split) a JOIN (SELECT DISTINCT year, recipient FROM split) b ON a.year = b.year AND a.voter <> b.recipient),
kinds AS (SELECT year, voter, recipient, coalesce(sum(points) FILTER (WHERE points_type = 'jury'), 0) AS jury, coalesce(sum(points) FILTER (WHERE points_type = 'televote'), 0) AS tele
  FROM split GROUP BY ALL),
panel AS (SELECT g.year, g.voter, g.recipient, coalesce(jury, 0.0) AS jury, coalesce(tele, 0.0) AS tele, coalesce(jury, 0.0) - coalesce(tele, 0.0) AS gap,
  CAST(coalesce(jury, 0) >= 10 AS DOUBLE) - CAST(coalesce(tele, 0) >= 10 AS DOUBLE) AS top_gap, lf.label AS from_label, lt.label AS to_label, lf.label = lt.label AS same
  FROM grid g LEFT JOIN kinds k ON g.year = k.year AND g.voter = k.voter AND g.recipient = k.recipient
  JOIN labels lf ON lf.country = g.voter JOIN labels lt ON lt.country = g.recipient)"""
COORDS = """coords AS (SELECT n_name AS country, CAST(-20 + (n_nationkey * 37) % 65 AS DOUBLE) AS lon, CAST(35 + (n_nationkey * 17) % 30 AS DOUBLE) AS lat FROM nation WHERE n_nationkey <> 0),
km AS (SELECT a.country AS a, b.country AS b, 2 * 6371.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))) AS km FROM coords a JOIN coords b ON a.country < b.country),
km2 AS (SELECT * FROM km UNION ALL SELECT b, a, km FROM km)"""


def perms(seed: str, draws: int, labels: str = "labels") -> str:
    """CTE perms (draw, node, label): relabellings as in functions.hashing.relabelled."""
    return f"""places AS (SELECT country, label, row_number() OVER (ORDER BY country) AS place FROM {labels}),
perms AS (SELECT r.draw, p.country AS node, r.label FROM (SELECT d.draw, l.label, row_number() OVER (PARTITION BY d.draw ORDER BY md5('{seed}:' || d.draw || ':' || l.country)) AS place
  FROM (SELECT unnest(range({draws})) AS draw) d, {labels} l) r JOIN places p ON p.place = r.place)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
