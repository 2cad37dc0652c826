"""A part of the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from newsloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = "normalize_url title_similarity simhash story_pairs assign_stories story_coverage source_health list_by_group replay_events decide classify signals concept_pairs graph_neighbors index_by_category hybrid_search stream_health upsert_articles add_to_index reconcile_documents merged_notes merge_plan classify_plan model_classify embed_missing ingest_pages index_document daily_documents electron_view dedup_by_url".split()


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(map(tuple, df[columns].astype(str).to_numpy().tolist())) for df in (got, want)]
    assert rows[0] == rows[1] and rows[0]


def test_nearly_all_queries_have_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 0.95 * len(QUERIES) - 1
