"""Expected values on small literals for text, bibliography and section rules."""

from pyspark.sql import functions as F

from lectern.functions import biblio as B
from lectern.functions import markup as M
from lectern.functions import segments as S
from lectern.functions import text as T
from lectern.operators import biblio, corpus, retrieval


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("v")).first()["v"]


def test_clean_text_rejoins_wrapped_words(spark):
    got = one(spark, T.clean_extracted(F.col("t")), t="bi-\nases cross-\nmodal \x00x\x01 é")
    assert got == "biases cross-modal (x) é"


def test_headings(spark):
    lines = ["1 Introduction", "2.1 Experimental Setup", "## Foo:", "References", "# Page 2", "CONFERENCE HEADER TEXT", "plain text here", "3 This ends with a dot."]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], ["i", "l"]).select("i", T.heading(F.col("l")).alias("h")).orderBy("i").collect()
    got = [tuple(r["h"]) if r["h"] else None for r in rows]
    assert got == [("1 Introduction", 1, True), ("2.1 Experimental Setup", 2, True), ("Foo", 2, True), ("References", 1, True), None, ("Conference Header Text", 1, False), None, None]


def test_headings_keep_letters_without_a_capital_of_one_letter(spark):
    assert one(spark, T.capital(F.col("t")), t="straße ŉ ᾀ") == "STRAẞE ŉ ᾈ"
    lines = ["STRAẞE INDEX", "ẞB INDEX", "STRAßE INDEX", "AΣ İB ŉ", "# A\u2028b", "# A\rb"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], ["i", "l"]).select("i", T.heading(F.col("l")).alias("h")).orderBy("i").collect()
    got = [tuple(r["h"]) if r["h"] else None for r in rows]
    assert got == [("Straße Index", 1, False), ("ẞb Index", 1, False), None, ("Aσ Ib ŉ", 1, False), ("A b", 1, True), ("A b", 1, True)]


def test_bibliography(spark):
    text = (
        'We conclude.\nREFERENCES\n[1] A. Author and B. Writer, "A useful paper title," in Proc. X, 2023. doi:10.1000/example.1\n'
        "[2] C. Third, Another long title without quotes, arXiv:2401.12345, 2024.\n[3] Repeat of one, 2020. DOI 10.1000/EXAMPLE.1\n[4] short"
    )
    rows = spark.createDataFrame([("p", 0, "references are discussed"), ("p", 1, text)], ["paper_id", "ord", "markdown"])
    got = biblio.extract_references(rows).orderBy("piece").collect()
    assert [r["index"] for r in got] == [1, 2]
    assert got[0]["title"] == "A useful paper title" and got[0]["doi"] == "10.1000/example.1" and got[0]["authors"] == ["A. Author", "B. Writer"]
    assert got[1]["arxiv"] == "2401.12345" and got[1]["year"] == 2024


def test_reference_list_over_two_sections(spark):
    first, second = "REFERENCES\n[1] One long entry that is", "References\ncontinued over here, 1999.\n[2] Two long entry number, 2001"
    rows = spark.createDataFrame([("p", 0, first), ("p", 1, second)], ["paper_id", "ord", "markdown"])
    got = {r["index"]: r["raw"] for r in biblio.extract_references(rows).collect()}
    assert got == {1: "One long entry that is continued over here, 1999", 2: "Two long entry number, 2001"}


def test_spread_entries_leaves_body_alone(spark):
    text = "Body cites [1] and [2].\n# References\n[1] first entry [2] second entry"
    assert one(spark, B.spread_entries(F.col("t")), t=text) == "Body cites [1] and [2].\n# References\n\n[1] first entry\n\n[2] second entry"


def test_sections_over_pages(spark):
    pages = [
        ("p", 1, "RUNNING PAPER HEADER\nAbstract\nShort summary.\n1 Introduction\nfirst part"),
        ("p", 2, "RUNNING PAPER HEADER\nsecond part\n2.1 Experimental Setup\nsetup"),
        ("p", 3, "RUNNING PAPER HEADER\nmore setup"),
        ("q", 1, "no headings at all"),
    ]
    chunks = corpus.section_chunks(spark.createDataFrame(pages, "paper_id string, page int, text string")).cache()
    got = [tuple(r) for r in corpus.sections(chunks).select("paper_id", "section_id", "title", "level", "ord", "page_start", "page_end").orderBy("paper_id", "ord").collect()]
    assert got == [
        ("p", "abstract", "Abstract", 1, 0, 1, 1), ("p", "1-introduction", "1 Introduction", 1, 1, 1, 2), ("p", "2-1-experimental-setup", "2.1 Experimental Setup", 2, 2, 2, 3),
        ("q", "document", "Document", 1, 0, 1, 1),
    ]
    bodies = {(r["section_no"], r["page"]): r["body"] for r in chunks.where("paper_id = 'p'").collect()}
    assert bodies[(2, 2)] == "second part" and bodies[(3, 3)] == "more setup"


def test_margins(spark):
    pages = [("p", i, f"Running Header {i}\nbody {'abc'[i - 1]}\n# 15\nmore\n{i}") for i in (1, 2, 3)]
    got = corpus.remove_margins(spark.createDataFrame(pages, "paper_id string, page int, text string")).orderBy("page").collect()
    assert [r["removed"] for r in got] == [3, 3, 3]
    assert got[0]["text"] == "body a\n15"


def test_sentences_protect_formulas_and_tile(spark):
    text = "First $a. b$ part. Version 3.5 works! ![fig. 1](x. png) 你好。 End"
    df = S.with_sentences(spark.createDataFrame([(text,)], ["t"]), "t")
    got = df.first()["sentences"]
    assert [s["text"] for s in got] == ["First", "part.", "Version 3.5 works!", "你好。", "End"]
    assert all(text[s["start"]:s["end"]] == s["text"] for s in got)


def test_long_arrays_of_sentences_have_right_offsets(spark):
    text = " ".join(f"Sentence {i}." for i in range(700))
    got = S.with_sentences(spark.createDataFrame([(text,)], ["t"]), "t").first()["sentences"]
    assert len(got) == 700 and all(text[s["start"]:s["end"]] == s["text"] for s in got)


def test_chunks_have_at_most_four_sentences(spark):
    df = S.with_sentences(spark.createDataFrame([("A b. " * 9,)], ["t"]), "t")
    spans = df.select(S.chunk_spans(F.col("sentences"), F.col("t")).alias("c")).first()["c"]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 19), (20, 39), (40, 44)]


def test_compact_blocks(spark):
    texts = ["one", "two", "three", "four", "- item", "five"]
    got = one(spark, S.compact_blocks(F.col("b")), b=texts)
    assert [(r["text"], r["n"], r["compacted"]) for r in got] == [("one; two; three; four", 4, True), ("- item", 1, False), ("five", 1, False)]


def test_runs_of_long_lists_are_whole(spark):
    """More runs than one part of the gathered list holds, against the plain walk."""
    n = 5000
    ends = [i * 400 + 399 for i in range(n)]
    rows = spark.createDataFrame([([(i * 400, e, "s") for i, e in enumerate(ends)], "s" * 10)], "sentences array<struct<start:int,end:int,text:string>>, t string")
    spans = rows.select(S.chunk_spans(F.col("sentences"), F.col("t")).alias("c")).first()["c"]
    assert [(s["start"], s["end"]) for s in spans] == [(i * 400, ends[min(i + 2, n - 1)]) for i in range(0, n, 3)]
    texts = [t for i in range(700) for t in (f"a{i}", "b", "c", "d", "- item")]
    got = one(spark, S.compact_blocks(F.col("b")), b=texts)
    assert [(r["first"], r["n"], r["text"]) for r in got] == [x for i in range(700) for x in ((5 * i, 4, f"a{i}; b; c; d"), (5 * i + 4, 1, "- item"))]


def test_long_text_split_loses_nothing(spark):
    text = "\n\n".join("word " * 90 for _ in range(12)).strip()
    got = one(spark, S.long_text_chunks(F.col("t"), 2000), t=text)
    assert all(len(c) <= 2000 for c in got) and " ".join(" ".join(got).split()) == " ".join(text.split())


def test_math_delimiters_keep_length_and_code(spark):
    text = "a \\(x\\) `\\(y\\)` \\[z\\]\n```\n\\[w\\]\n```\n"
    got = one(spark, M.normalize_math(F.col("t")), t=text)
    assert got == "a $ x $ `\\(y\\)` $$z$$\n```\n\\[w\\]\n```\n" and len(got) == len(text)


def test_quality_issue_kinds(spark):
    text = "Table 1: scores\n1 2 3 4 5 6 7\n\nz {a_b = c + d} x"
    assert {i["kind"] for i in one(spark, M.quality_issues(F.col("t")), t=text)} == {"formula", "table"}


def test_tables(spark):
    text = "x\n| a | b |\n|---|:---:|\n| 1 | 2 |"
    assert one(spark, M.table_rows(F.col("t")), t=text) == [["a", "b"], ["1", "2"]]
    assert one(spark, M.table_rows(F.col("t")), t="| a |\n| b |\n| c |") is None


def test_anchor_roundtrip(spark):
    text = 'a <a data-block-id="x"></a> b'
    df = spark.createDataFrame([(text,)], ["t"]).select(M.mask_anchors(F.col("t")).alias("m"))
    assert df.select(M.restore_anchors(F.col("m.text"), F.col("m.anchors"))["markdown"].alias("r")).first()["r"] == text


def test_nothing_matches_ambiguous_replacement(spark):
    got = one(spark, M.replace_unique(F.col("m"), F.lit("x y"), F.lit("Z")), m="xy and x  y")
    assert got["replaced"] is False


def test_evidence_reads_texts_once_for_its_lists(spark):
    texts = [(i, i, f"p{i % 2}", f"term{i % 3} shared Alpha{i}") for i in range(12)]
    sections = spark.createDataFrame(texts, "section_key long, ord long, paper_id string, text string")
    lists = retrieval.term_postings(sections, 2, spark.createDataFrame([("p1",)], ["scope"]))
    got = {(r["scope"], r["token"]): [] for r in lists.collect()}
    for r in lists.collect():
        got[r["scope"], r["token"]].append(r["ord"])
    assert sorted(got["", "shared"]) == [0, 1] and sorted(got["p1", "shared"]) == [1, 3] and ("p0", "shared") not in got
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan  # stored: read back, not split again
    asked = spark.createDataFrame([("q", "alpha SHARED", "p1", 2), ("r", "hared", "", 3), ("s", "nothing", "", 5)], "query_id string, query string, paper_id string, limit int")
    found = sorted((r["query_id"], r["rank"], r["section_key"]) for r in retrieval.find_evidence(asked, sections).collect())
    assert found == [("q", 1, 1), ("q", 2, 3), ("r", 1, 0), ("r", 2, 1), ("r", 3, 2)]
    assert retrieval.find_evidence(asked, sections.where("false")).count() == 0


def test_evidence_meets_sections_in_batches(spark):
    texts = [(i, None if i == 7 else i, f"p{i % 3}", "common word" + (" late" if i >= 2990 else "") + (" seldom" if i in (5, 600, 2500) else "")) for i in range(3000)]
    sections = spark.createDataFrame(texts, "section_key long, ord long, paper_id string, text string")
    batches = retrieval.section_batches(sections)
    inside = [{r["section_key"] for r in sections.where(b).select("section_key").collect()} for b in batches]
    assert len(batches) == 3 and set().union(*inside) == set(range(3000)) and sum(map(len, inside)) == 3000
    assert 7 in inside[0] and max(inside[0] - {7}) < min(inside[1]) and max(inside[1]) < min(inside[2]) and len(inside[0]) < len(inside[1])
    asked = spark.createDataFrame([("a", "common", "", 3), ("b", "late", "", 2), ("c", "seldom", "", 20), ("d", "seldom late", "p1", 3)], "query_id string, query string, paper_id string, limit int")
    found = retrieval.find_evidence(asked, sections).collect()
    got = {q: [r["section_key"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in "abcd"}
    assert got == {"a": [7, 0, 1], "b": [2990, 2991], "c": [5, 600, 2500], "d": [2500, 2992, 2995]}


def test_sentences_are_trimmed_once(spark):
    from lectern.functions import segments as S

    df = S.with_sentences(spark.createDataFrame([(" A b.  C [x](y. z) d!  \n",), ("   ",), ("",), (None,), ("`a. b` $c. d$ e",)], ["t"]), "t")
    got = [None if r["sentences"] is None else [tuple(s) for s in r["sentences"]] for r in df.select("sentences").collect()]
    assert got == [[(1, 5, "A b."), (7, 8, "C"), (19, 21, "d!")], [], [], None, [(14, 15, "e")]]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("trim(") == 2  # one for each side; four before
