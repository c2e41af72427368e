import datetime
import os

import pytest

from lectern import queries as q
from lectern.plans.ingest import read_pages
from lectern.streaming import events
from tests.compare import DATA

q.load_all()


def test_pages_to_references(spark):
    pages = [("p", 1, "Abstract\nShort summary of bi-\nases.\n1 Introduction\ncites [1] and [2]"), ("p", 2, "References\n[1] A. Author, \"A useful paper title\", 2020.\n[2] B. Writer, \"Another useful title\", 2021.")]
    out = read_pages(spark.createDataFrame(pages, "paper_id string, page int, text string"))
    assert [r["section_id"] for r in out["sections"].orderBy("ord").collect()] == ["abstract", "1-introduction", "references"]
    assert [r["title"] for r in out["references"].orderBy("index").collect()] == ["A useful paper title", "Another useful title"]
    assert out["anchors"].where("section_id = 'abstract'").first()["source_text"] == "Short summary of biases."


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("module", q.MODULES)
def test_no_query_plans_a_nested_loop(spark, module):
    """Every registered query of a module: no nested-loop and no Cartesian join."""
    for name, query in q.QUERIES.items():
        if query.__module__ == f"lectern.queries.{module}":
            run = query(spark, f"{DATA}/sf0.001")._jdf.queryExecution()
            plan = run.optimizedPlan().toString() + run.executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_pending_events_by_batch(spark, tmp_path):
    write = events.write_pending(str(tmp_path / "pending"))
    shape = "path string, previous_path string, event_type string, ts timestamp, event_id long"
    at = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in range(5)]
    write(spark.createDataFrame([("a", "old", "moved", at[0], 1), ("a", None, "modified", at[1], 2), ("b", None, "created", at[1], 3)], shape), 0)
    write(spark.createDataFrame([("a", None, "modified", at[2], 4)], shape), 1)
    write(spark.createDataFrame([("a", "old", "modified", at[2], 4)], shape), 1)  # a retried batch replaces its own rows
    got = {r["path"]: r for r in events.read_pending(spark, str(tmp_path / "pending")).collect()}
    assert (got["a"]["event_type"], got["a"]["previous_path"], got["b"]["event_id"]) == ("modified", "old", 3)
    told = {r["path"]: r["status"] for r in events.marked(events.read_pending(spark, str(tmp_path / "pending")), spark.createDataFrame([("a", "broken"), ("c", None)], "path string, error string")).collect()}
    assert told == {"a": "failed", "b": "pending"}
