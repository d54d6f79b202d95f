"""Every query of the catalogue: against its SQL where there is some, else that it runs and has rows."""

import pytest

from affinia.plans.catalog import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    folder, con = tables
    assert_same(QUERIES[name](spark, folder), con.sql(ORACLES[name]))


#: Run by test_all_models, which looks at their values.
COMPARED = {"q60_all_models", "q61_all_significance", "q63_grid_search", "q64_repeated_splits"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - COMPARED))
def test_other_queries_run(spark, tables, name):
    assert QUERIES[name](spark, tables[0]).count() > 0


def test_all_models(spark, tables):
    """All six models beside the repeated splits; those that SQL can fit have its metrics; tests and grid agree with them."""
    folder, con = tables
    every = {r.model: r for r in QUERIES["q60_all_models"](spark, folder).collect()}
    sql = con.sql(ORACLES["q60_model_comparison"])
    names = sql.columns
    fitted = [dict(zip(names, r)) for r in sql.fetchall()]
    assert len(every) == 6 and len(fitted) == 4
    for r in fitted:
        got = every[r["model"]]
        assert (got.params, got.n_cells, got.n_ballots) == (r["params"], r["n_cells"], r["n_ballots"])
        assert [got[c] for c in ("rmse", "precision", "ndcg", "ndcg2")] == pytest.approx([r[c] for c in ("rmse", "precision", "ndcg", "ndcg2")], abs=2e-6)
    assert all(r.rmse_mean_over_seeds > 0 and r.rmse_std_over_seeds > 0 and 0 < r.ndcg_mean_over_seeds < 1 for r in every.values())
    tests = QUERIES["q61_all_significance"](spark, folder).collect()
    assert len(tests) == 8 and all(0 <= r.p_value <= 1 and r.n == every[r.model].n_ballots for r in tests)
    for r in tests:
        if r.metric == "ndcg":
            assert r.model_mean == pytest.approx(every[r.model].ndcg, abs=2e-6) and r.reference_mean == pytest.approx(every[r.reference].ndcg, abs=2e-6)
    grid = QUERIES["q63_grid_search"](spark, folder).collect()
    assert len(grid) == len({r.run for r in grid}) == 47 and [r.rmse for r in grid] == sorted(r.rmse for r in grid)


def test_entry(spark, tables):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["a", "b", "sim"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_song_effects_agree(spark, tables):
    """The permutation test's observed coefficient is that of model M4."""
    q = QUERIES["q52_mrqap_song_fe"](spark, tables[0]).first()
    m4 = QUERIES["q50_ols_models_cluster_se"](spark, tables[0]).filter("model = 'M4' AND term = 'same_bloc'").first()
    assert abs(q.observed - m4.coefficient) < 1e-3 and 0 < q.p_value <= 1 and q.n_draws > 0


@pytest.fixture
def small_tables(spark, tmp_path):
    """A folder for hand-made tables, and a function that writes one of them there."""
    return str(tmp_path), lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_names_in_whole_texts(spark, small_tables):
    """Names are found wherever they stand in a document."""
    folder, write = small_tables
    far = "x " * 2000
    write("documents", [(1, far + "token"), (2, far + "Zz ones-haa"), (3, "nothing"), (4, None)], "doc_id long, text string")
    write("nation", [(2, "ZZLAND", 1)], "n_nationkey int, n_name string, n_regionkey int")
    assert {r.doc_id: r["keys"] for r in QUERIES["q69_gazetteer_match"](spark, folder).collect()} == {1: "token", 2: "", 3: "", 4: ""}
    found = {r.slug: (r.country, r.source) for r in QUERIES["q70_entity_resolver"](spark, folder).collect()}
    assert found == {1: ("Token", "title_country"), 2: ("ZZLAND", "title_artist"), 3: (None, "none"), 4: (None, "none")}
    assert tuple(QUERIES["q70_resolver_counts"](spark, folder).first()) == (4, 4, 2, 0)


def test_entries_hold_all_documents(spark, small_tables):
    """Pairs, duplicates and counts over documents beyond the first ballots' years, against brute force."""
    folder, write = small_tables
    ids, vectors = [0, 24, 174, 175, 176, 199, 200, 5001, 5002], 4
    write("documents", [(i, f"same words w{i % 2}", "en") for i in ids], "doc_id long, text string, lang string")
    write("embeddings", [(v, [float(v % 2), 0.0, 1.0 + v]) for v in range(vectors)], "vec_id long, embedding array<float>")
    write("nation", [(k, f"N{k:02}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    pairs = {(1995 + i // 25, *sorted((f"N{i % 25:02}", f"N{j % 25:02}"))) for i in ids for j in ids if i < j and i // 25 == j // 25}
    for name in ("q43_language_flags", "q44_theme_similarity", "q45_tfidf_similarity"):
        assert {(r.year, r.a, r.b) for r in QUERIES[name](spark, folder).collect()} == pairs
    n = {1995 + y: [i % vectors % 2 for i in ids if i // 25 == y] for y in {i // 25 for i in ids}}
    got = {r.year: (r.n_entries, r.n_unique_vectors) for r in QUERIES["q47_vector_duplication"](spark, folder).collect()}
    assert got == {y: (len(v), len(set(v))) for y, v in n.items()}


def test_causal_panel_compares_entries_of_years_with_votes(spark, tables, monkeypatch):
    """Similarities of the panel are made for the years of its dyads, once, however many years of entries there are."""
    from affinia.operators import regression
    from affinia.sources.tables import entries

    seen, own = [], regression.theme_similarity
    monkeypatch.setattr(regression, "theme_similarity", lambda e: seen.append({r.year for r in e.select("year").distinct().collect()}) or own(e))
    panel = QUERIES["q48_causal_panel"](spark, tables[0])
    years = {r.year for r in panel.select("year").distinct().collect()}
    assert seen == [years] and years < {r.year for r in entries(spark, tables[0]).select("year").distinct().collect()}
    assert entries(spark, tables[0], panel).count() == 25 * len(years)
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "regexp_extract_all" not in plan, "z-scores make the similarities anew"
