"""Read tools: declared arguments, a table of calls, and the same functions from SQL."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import tools


@pytest.fixture(scope="module")
def library(spark):
    frame = spark.createDataFrame
    return tools.Library(
        papers=frame([("p1", "Straße of Graphs", "READY", 3, 1), ("p2", "Graphs again", "QUEUED", 0, 2)], "id string, title string, status string, page_count int, updated_at long"),
        documents=frame([("p1", "x" * 1500), ("p2", "short")], "paper_id string, markdown string"),
        sections=frame([("p1", "s1", "Intro", 1, 1, "Spark joins graphs."), ("p1", "s2", "intro", 2, 2, "Nothing here"), ("p2", "s1", "Method", 3, 1, "We join\tby spark")], "paper_id string, section_id string, title string, ord int, page int, markdown string"),
        figures=frame([("p1", "f1", 2, "late"), ("p1", "f2", 1, "early")], "paper_id string, figure_id string, page int, caption string"),
        references=frame([("p1", i, f"r{i}", f"Work {i}") for i in range(1, 6)], "paper_id string, pos int, ref_id string, title string"))


CASES = [
    ("search_library", {"query": "STRASSE"}, [("p1",)]), ("search_library", {"query": "graphs"}, [("p2",), ("p1",)]), ("search_library", {"query": "graphs", "limit": 1}, [("p2",)]),
    ("search_library", {"query": "graphs", "limit": 21}, "limit must be between 1 and 20"), ("search_library", {"query": "  "}, "query is required"), ("search_library", {"query": 5}, "query must be a string"),
    ("search_library", {"query": "a", "limit": "3"}, "limit must be an integer"), ("search_library", {"query": "a", "limit": 2.5}, "limit must be an integer"), ("search_library", {"query": "a", "more": 1}, "unknown argument more"), ("search_library", [1], "arguments must be an object"),
    ("read_paper", {"paperId": "p1", "maxCharacters": 1000}, [("p1",)]), ("read_paper", {"paperId": "p9"}, "unknown paper p9"), ("read_paper", {"paperId": "p1", "maxCharacters": 999}, "maxCharacters must be between 1000 and 100000"), ("read_paper", {}, "paperId is required"),
    ("read_section", {"paperId": "p1", "sectionId": "INTRO"}, [("s1",)]), ("read_section", {"paperId": "p1", "sectionId": "s2"}, [("s2",)]), ("read_section", {"paperId": "p1", "sectionId": "s7"}, "unknown section s7"), ("read_section", {"paperId": "p1"}, "sectionId is required"),
    ("read_figure", {"paperId": "p1"}, [("f2",), ("f1",)]), ("read_figure", {"paperId": "p1", "figureId": "f1"}, [("f1",)]), ("read_figure", {"paperId": "p1", "figureId": "zz"}, "unknown figure zz"), ("read_figure", {"paperId": "p2"}, []),
    ("find_evidence", {"query": "spark by"}, [("p1",), ("p2",)]), ("find_evidence", {"query": "spark", "paperId": "p2"}, [("p2",)]), ("find_evidence", {"query": "spark", "limit": 1}, [("p1",)]), ("find_evidence", {"query": "absent"}, []),
    ("get_references", {"paperId": "p1", "limit": 2}, [("r1",), ("r2",)]), ("get_references", {"paperId": "p1", "limit": None}, [(f"r{i}",) for i in range(1, 6)]), ("get_references", {"paperId": "p1", "limit": 500}, "limit must be between 1 and 200"),
]
SHOWN = {"search_library": "paper_id", "read_paper": "paper_id", "read_section": "section_id", "read_figure": "figure_id", "find_evidence": "paper_id", "get_references": "ref_id"}


def test_table_of_calls(spark, library):
    calls = [(i, tool, json.dumps(a)) for i, (tool, a, _) in enumerate(CASES)] + [(900, "write_paper", "{}"), (901, "read_paper", "no json"), (902, "read_paper", None), (903, "read_paper", json.dumps({"paperId": "x" * 200_000}))]
    rows = tools.run_calls(spark.createDataFrame(calls, "call_id int, tool_name string, arguments string"), library).collect()
    for i, (tool, _, want) in enumerate(CASES):
        mine = sorted((r["place"], r["error"], r["paper_id"], r["part"]) for r in rows if r["call_id"] == i)
        if isinstance(want, str):
            assert [m[1] for m in mine] == [want], tool
        else:
            part = SHOWN[tool] != "paper_id"
            assert [(m[3] if part else m[2],) for m in mine] == want, (tool, i)
    assert {r["call_id"]: r["error"] for r in rows if r["call_id"] >= 900} == {900: "unknown tool", 901: "arguments must be an object", 902: "arguments must be an object", 903: "arguments exceed 131072 bytes"}


def test_functions_from_sql(spark, library):
    assert tools.register_tools(spark, library, "t_") == [f"t_{name}" for name in tools.TOOLS]
    for tool, arguments, want in CASES:
        rows = spark.sql(f"SELECT * FROM t_{tool}(:a)", args={"a": json.dumps(arguments)}).collect()
        if isinstance(want, str):
            assert [r["error"] for r in rows] == [want], (tool, arguments)
        else:
            assert [(r[SHOWN[tool]],) for r in rows] == want and all(r["error"] is None for r in rows), (tool, arguments)
    cut = spark.sql("""SELECT truncated, length(markdown) AS n FROM t_read_paper('{"paperId": "p1", "maxCharacters": 1000}')""").first()
    assert (cut["truncated"], cut["n"]) == (True, 1000)
    found = spark.sql("""SELECT * FROM t_search_library('{"query": "again"}')""").first()
    assert (found["status"], found["page_count"], found["rank"]) == ("QUEUED", 0, 1)


def test_arguments_reach_the_scan(spark, library, tmp_path):
    """Literal arguments are pushed into the file scan of the view."""
    library.documents.write.parquet(str(tmp_path / "documents"))
    stored = tools.Library(library.papers, spark.read.parquet(str(tmp_path / "documents")), library.sections, library.figures, library.references)
    tools.register_tools(spark, stored, "s_")
    plan = spark.sql("""SELECT * FROM s_read_paper('{"paperId": "p2"}')""")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(paper_id,p2)" in plan and "Python" not in plan
    assert spark.sql("""SELECT * FROM s_read_paper('{"paperId": "p2"}')""").agg(F.count("*")).first()[0] == 1
