"""A quick part of the registered queries against their SQL twins; check.py runs all of them."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUICK = ["conflict_groups", "signature_counts", "document_chunks", "article_segments", "legal_segments", "dictionary_hits", "instrument_summary",
         "final_judgements", "batch_list", "atom_trace", "review_metrics", "similarity_scores", "quality_funnel", "capped_ranking", "matched_chunks", "event_windows",
         "scene_gaps", "scene_judgements", "merged_nodes", "bundle_results", "late_events", "resolved_documents", "flattened_atoms", "citation_chunks", "csv_read_back"]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, connection, name):
    same, note = compare(spark, connection, name, SF_DIR)
    assert same, note


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()
