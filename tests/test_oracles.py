"""Queries against DuckDB on the smallest tables; ``LECTERN_ORACLE=all`` runs every one."""

import os

import pytest

from lectern import queries as q
from tests.compare import DATA, compare, duck

q.load_all()
SOME = [
    "dedup_exact", "token_budget", "boilerplate_lines", "headings", "sentences", "sentence_chunks", "compact_blocks", "references", "title_resolve", "coupling", "subtree_counts", "evidence",
    "library_listing", "effective_metadata", "file_reconcile", "stratified_sample", "latest_state", "next_revision", "carry_forward", "upsert_orders", "cut_runs", "reproject_spans", "lanes",
    "cache_pending", "enrich_units", "best_pass", "publish_gate", "burst_sessions", "progress_fold", "activity_fold", "tool_calls",
]


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(q.QUERIES) if os.environ.get("LECTERN_ORACLE") == "all" else SOME)
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, q.QUERIES[name], q.ORACLES.get(name), "sf0.001")
    assert ok, message
