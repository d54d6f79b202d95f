"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinia.llm import chat, decontaminate, html_text, language, near_dups, packing, pii, quality, token_counts, token_store
from affinia.llm.common import documents, scratch, table, tokenizer_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match_benchmark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), width=8, min_items=2, slack=4).drop("hits")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.detect_language(documents(spark, sf_dir))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir).select("doc_id", "text"), pii.session_key(spark))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_chat_formatting,
        op4_near_duplicates,
        op5_decontamination,
        op6_token_store,
        op7_packing,
        op8_language_id,
        op9_pii_surrogates,
        op10_html_extraction,
    )
}

_BENCHMARK_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns FROM i GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS n_copies FROM c GROUP BY n_turns, turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS prefix FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS k)),
kept AS (SELECT u.* FROM u ANTI JOIN p ON u.turns = p.prefix)
SELECT i.conv_id, (place - 1) // 1024 AS part, n_turns, count(*) AS n_part_turns, n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM i JOIN kept USING (conv_id) GROUP BY i.conv_id, (place - 1) // 1024, n_turns, n_copies
""",
    "op5_decontamination": rf"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_BENCHMARK_WORDS}') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '{_BENCHMARK_WORDS}') AS w FROM benchmark),
starts AS (SELECT item_id, w, s, least(8, len(w)) AS n FROM bw, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + n - 1) AS win FROM starts),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
dwin AS (SELECT rid, s, n, list_slice(w, s, s + n - 1) AS win FROM dw, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
hit AS (SELECT rid, s, n, item_id FROM dwin JOIN win USING (win)),
hit_places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid),
tokens AS (SELECT rid, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw),
counts AS (SELECT term, count(*) AS c FROM tokens GROUP BY term),
inside AS (SELECT item_id, w, s, s + k AS item_pos, w[s + k] AS term FROM starts, LATERAL (SELECT unnest(range(0, n)) AS k)),
rare AS (SELECT DISTINCT item_id, w, item_pos, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id, w, s ORDER BY c, term, item_pos) AS rn FROM inside JOIN counts USING (term)) WHERE rn <= 2),
met AS (SELECT DISTINCT item_id, w, rid, CAST(floor((pos - item_pos) / 4) AS BIGINT) AS band, item_pos FROM rare JOIN tokens USING (term)),
bands AS (SELECT item_id, w, rid, band, item_pos FROM met UNION SELECT item_id, w, rid, band - 1, item_pos FROM met),
near AS (SELECT DISTINCT rid, item_id FROM (SELECT rid, item_id, item_pos - lag(item_pos, 2) OVER (PARTITION BY item_id, w, rid, band ORDER BY item_pos) AS far FROM bands) WHERE far < 16),
near_items AS (SELECT rid, count(*) AS n_near_items FROM near ANTI JOIN hit USING (rid, item_id) GROUP BY rid)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM dw LEFT JOIN hit_places USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near_items USING (rid)
""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) END AS x FROM w),
u AS (SELECT x, min(doc_id) AS id, len(x) AS n FROM (SELECT doc_id, list_sort(x) AS x FROM sets) GROUP BY x),
sh AS (SELECT id, n, unnest(x) AS s FROM u),
pairs AS (SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, to_id) AS (SELECT id, id FROM u UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.to_id = e.a),
comp AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id)
SELECT sets.doc_id, CAST(len(sets.x) AS BIGINT) AS n_shingles,
  CASE WHEN len(sets.x) = 0 THEN sets.doc_id ELSE component END AS component_id,
  CASE WHEN len(sets.x) = 0 THEN true ELSE sets.doc_id = component END AS kept
FROM sets LEFT JOIN u ON list_sort(sets.x) = u.x LEFT JOIN comp ON comp.id = u.id
""",
}
