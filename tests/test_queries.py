"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

SAMPLE = (
    "variants_delimiter", "variants_encoding", "check_iban", "synth_national_ids", "near_miss_iban", "detection_run",
    "score_by_technique", "score_best_and_worst", "score_key_findings", "score_recommendations", "score_feedback",
    "score_regression_cases", "score_bucket_metrics", "compare_row_diffs", "compare_by_technique", "detect_context_gate",
    "edm_find_documents", "edm_find_typed", "corpus_allow_list", "corpus_all_families", "corpus_random_mode", "source_run_order", "neardup_evaluation",
    "entropy_tokens_gated", "neardup_ladder", "neardup_match_registered", "corpus_random",
    "sink_json_records", "history_baseline", "history_pair_false_positives", "history_fast_subset", "stream_windowed_rate",
    "stream_drop_alerts",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_reference_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
