"""Costly text work is done once, on all cores, and nothing is joined that one grouping can give."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lectern import queries as q
from lectern.operators import biblio
from lectern.sources import sinks
from lectern.streaming import jobs as J
from tests.compare import DATA

q.load_all()
driver_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reference_lists_are_cut_once(spark):
    parts = ['REFERENCES\n[1] First author, "A title of some words", 2001.\n[2] Second', "REFERENCES\nauthor goes on here\n", "REFERENCES\n, and on\n[3] A third author, 2003"]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(parts)], ["paper_id", "ord", "markdown"])
    entries = biblio.reference_entries(rows)
    assert "regexp_instr" not in plan(entries)
    assert [r["raw"] for r in entries.orderBy("ord", "piece").collect()] == ['First author, "A title of some words", 2001', "Second author goes on here , and on", "A third author, 2003"]


def test_tool_calls_are_one_grouping(spark):
    call = '{"choices": [{"delta": {"tool_calls": [{"index": 0, %s}]}}]}'
    rows = [("r", 1, call % '"id": "c", "function": {"name": "f"}'), ("r", 3, call % '"function": {"arguments": "b"}'), ("r", 2, call % '"function": {"arguments": "a"}'), ("s", 1, call % '"id": "d", "function": {"name": "g"}')]
    calls = J.tool_calls(spark.createDataFrame(rows, ["request_id", "seq", "json"]).withColumn("format", F.lit("openai")))
    assert "Join" not in plan(calls)
    assert sorted(tuple(r) for r in calls.collect()) == [("r", 0, "c", "f", "ab"), ("s", 0, "d", "g", None)]


def test_table_lines_are_cut_once(spark):
    rows = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| 1 | |"), (2, "no table")], ["table_id", "markdown"])
    cells = sinks.table_cells(rows)
    assert plan(cells).count("split(markdown") == 1
    assert sorted(tuple(r) for r in cells.collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "1"), (1, 1, 1, "")]


@driver_tables
@pytest.mark.parametrize("name", ["tool_calls", "page_answers", "embed_figures"])
def test_a_table_of_one_row_group_is_dealt_out(spark, name):
    assert "Repartition" in plan(q.QUERIES[name](spark, f"{DATA}/sf0.001"))


@driver_tables
def test_coupling_pairs_only_members_of_shared_groups(spark):
    assert "Aggregate" not in plan(q.QUERIES["coupling"](spark, f"{DATA}/sf0.001")).split("Join", 1)[1]


@driver_tables
def test_enrichment_units_are_made_distinct_without_their_keys(spark):
    assert not re.search(r"Aggregate \[l_partkey#\w+, l_suppkey#\w+, cache_key", plan(q.QUERIES["enrich_units"](spark, f"{DATA}/sf0.001")))


@driver_tables
def test_digests_of_enrichment_units_do_not_travel(spark):
    assert plan(q.QUERIES["enrich_units"](spark, f"{DATA}/sf0.001")).splitlines()[0].count("sha2") == plan(q.QUERIES["enrich_units"](spark, f"{DATA}/sf0.001")).count("sha2") == 1


@driver_tables
def test_passes_are_dealt_by_page_into_tasks_of_bounded_rows(spark):
    """The tasks that sort and join the passes grow in number with the table, not in size."""
    from lectern.session import dealt_by

    rows = spark.range(10_000).withColumn("k", F.col("id") % 5000)
    assert dealt_by(rows, ["k"], 100).rdd.getNumPartitions() == 100
    plan = q.QUERIES["best_pass"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
