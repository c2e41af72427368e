"""Reconciliation, revisions, spans, layout, sampling and enrichment on small literals."""

import collections
import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import biblio, corpus, enrichment, files, graph, layout, metrics, retrieval, revisions, spans

KNOWN = "id string, paper_id string, path string, sha256 string, size_bytes long, modified_at_ns long, is_missing boolean, created_at long"
LISTING = "path string, size_bytes long, modified_at_ns long, sha256 string"


def walk(listing, known):
    """The rules of reconciliation, path by path."""
    rows = [dict(zip(("id", "paper", "path", "sha", "size", "time", "missing", "at"), k, strict=True)) for k in known]
    now = {p for p, *_ in listing}
    out, seen = [], set()
    for path, size, time, sha in sorted(listing):
        own = next((r for r in rows if r["path"] == path), None)
        if own and (own["size"], own["time"]) == (size, time):
            out.append((path, "unchanged"))
            continue
        if own and own["sha"] == sha:
            out.append((path, "touched"))
            continue
        if own:
            own["path"] = path + ".superseded"
        same = sorted((r for r in rows if r["sha"] == sha), key=lambda r: r["at"])
        free = next((r for r in same if r["missing"] or r["path"] not in now), None)
        if free:
            free["path"], free["missing"] = path, False
            out.append((path, "moved"))
        elif same or sha in seen:
            out.append((path, "duplicate"))
        else:
            seen.add(sha)
            out.append((path, "new"))
    return sorted(out)


def test_reconcile_against_the_sequential_rules(spark):
    rng = random.Random(11)
    for _ in range(3):
        known = [(f"f{i}", f"p{i % 7}", f"/l/{i:02d}.pdf", f"h{i % 6}", 1, 1, False, i) for i in range(18)]
        listing = [(f"/l/{i:02d}.pdf", 1, rng.choice([1, 2]), f"h{rng.randint(0, 8)}") for i in range(30) if rng.random() < 0.7]
        # A file that kept size and time kept its bytes.
        stable = {k[2]: k for k in known}
        listing = [(p, s, t, stable[p][3] if p in stable and t == 1 else h) for p, s, t, h in listing]
        got = files.reconcile(spark.createDataFrame(listing, LISTING), spark.createDataFrame(known, KNOWN))
        actions = sorted((r["path"], r["action"]) for r in got.where(F.col("action").isin("unchanged", "touched", "moved", "duplicate", "new")).collect())
        assert actions == walk(listing, known)


def test_missing_and_back(spark):
    known = spark.createDataFrame([("f", "p", "/l/a.pdf", "h", 1, 1, False, 1)], KNOWN)
    papers = spark.createDataFrame([("p", "READY")], ["id", "status"])
    gone = files.reconcile(spark.createDataFrame([("/l/z.pdf", 1, 1, "other")], LISTING), known)
    assert files.paper_states(papers, known, gone).first()["status"] == "MISSING"
    moved = files.reconcile(spark.createDataFrame([("/l/b.pdf", 1, 1, "h")], LISTING), known)
    assert files.paper_states(papers.withColumn("status", F.lit("MISSING")), known, moved).first()["status"] == "READY"


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], ["id", "v", "created_at"])
    change = spark.createDataFrame([(2, "c", 30, 1), (2, "d", 31, 2), (3, "e", 32, 1)], ["id", "v", "created_at", "seq"])
    once = revisions.upsert(table, change, ["id"], ["seq"], ["created_at"])
    twice = revisions.upsert(once, change, ["id"], ["seq"], ["created_at"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, "d", 20), (3, "e", 32)] == sorted(map(tuple, twice.collect()))


def test_reprojection(spark):
    old = "One two. Three four. Five."
    seg = [("s1", 0, 8), ("s2", 9, 20), ("s3", 21, 26)]
    rows = [("same", old, old, seg), ("space", old, "One  two.\n\nThree four. Five.", seg), ("edit", old, "Zero. One two. Three 4our. Five.", seg), ("twice", old, "One two. One two. Five.", seg)]
    df = spark.createDataFrame(rows, "record_id string, old_text string, new_text string, segments array<struct<segment_id:string,start:int,end:int>>")
    got = {(r["record_id"], r["segment_id"]): (r["start"], r["end"], r["status"]) for r in spans.reproject(df).collect()}
    assert got[("same", "s2")] == (9, 20, "exact")
    assert got[("space", "s2")] == (11, 22, "whitespace-remapped")
    assert got[("edit", "s1")] == (6, 14, "whitespace-remapped") and got[("edit", "s2")] == (0, 0, "stale") and got[("edit", "s3")][2] == "whitespace-remapped"
    assert got[("twice", "s1")][2] == "stale"


def test_lane_clusters_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("p", 1, 600.0, 800.0, f"b{i}", (float(x), float(y), float(x + 200), float(y + 20)), f"t{i}") for i, (x, y) in enumerate((rng.choice([10, 320]), rng.randint(70, 700)) for _ in range(25))]
    df = spark.createDataFrame(rows, "paper_id string, page int, page_w double, page_h double, block_id string, rect struct<x0:double,y0:double,x1:double,y1:double>, text string")
    got = layout.lane_clusters(df).collect()
    for lane, left in ((1, 10), (2, 320)):
        want, blocks = [], sorted(r[5] for r in rows if r[5][0] == left)
        for x0, y0, x1, y1 in sorted(blocks, key=lambda b: (b[1], b[0])):
            if want and y0 - want[-1][1] <= 38 and max(want[-1][1], y1) - want[-1][0] <= 800 * 0.43:
                want[-1][1] = max(want[-1][1], y1)
            else:
                want.append([y0, y1])
        assert [[r["y0"], r["y1"]] for r in sorted(got, key=lambda r: r["seq"]) if r["lane"] == lane] == want


def test_figure_and_table_boxes(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = [
        ("p", 1, 600.0, 800.0, "c", (50.0, 400.0, 290.0, 415.0), "Figure 1: A plot"), ("p", 1, 600.0, 800.0, "t", (50.0, 500.0, 290.0, 515.0), "Table 1: Scores"),
        ("p", 1, 600.0, 800.0, "r1", (50.0, 520.0, 290.0, 560.0), "a 1 2"), ("p", 1, 600.0, 800.0, "h", (50.0, 570.0, 290.0, 580.0), "2 Method"), ("p", 1, 600.0, 800.0, "r2", (50.0, 590.0, 290.0, 610.0), "after"),
    ]
    df = spark.createDataFrame(blocks, f"paper_id string, page int, page_w double, page_h double, block_id string, rect {rect}, text string")
    graphics = spark.createDataFrame([("p", 1, (60.0, 300.0, 280.0, 390.0)), ("p", 1, (400.0, 300.0, 500.0, 390.0))], f"paper_id string, page int, rect {rect}")
    box = layout.figure_boxes(df, graphics).first()["box"]
    assert tuple(box) == (54.0, 294.0, 286.0, 396.0)
    table = layout.table_bodies(df).first()
    assert tuple(table["box"]) == (45.0, 496.0, 295.0, 565.0) and table["source_text"] == "a 1 2"


def test_sample_fills_quotas(spark):
    rows = [(f"{c}{i}", f"{(i * 7919) % 1000:04d}", c, i % 3) for c, n in (("finft", 20), ("multimodal", 20), ("icassp", 8), ("unfiled", 8)) for i in range(n)]
    got = metrics.stratified_sample(spark.createDataFrame(rows, ["item", "sha256", "category", "bucket"])).where("selected").groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in got} == {"finft": 13, "multimodal": 17}


def test_second_run_has_nothing_to_do(spark):
    units = spark.createDataFrame([(i, f"k{i % 4}") for i in range(8)], ["unit", "cache_key"])
    empty = spark.createDataFrame([], "cache_key string, response string")
    first = enrichment.enrich(units, empty, lambda u: {"response": u["cache_key"]}, 2)
    assert first.where("cache_hit").count() == 0 and first.where("status = 'completed'").count() == 8
    pending, _ = enrichment.split_by_cache(units, first.select("cache_key", "response").distinct())
    assert pending.count() == 0


def test_units_meet_the_cache_by_the_parts_of_their_key(spark):
    """Units that repeat, a cache with several answers and none, a unit without a key, a failing call; the digest is not asked for."""
    units = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, "b", "v"), (4, None, "w"), (5, "c", "u")], "part long, supplier string, status string")
    cache = spark.createDataFrame([(1, "a", "second"), (1, "a", "first"), (5, "c", None)], "part long, supplier string, response string")

    def call(unit):
        if unit["part"] == 3:
            raise ValueError("bad answer")
        return {"response": f"{unit['part']}{unit['supplier']}", "input_tokens": 7}

    got = enrichment.enrich(units, cache, call, 2, ["part", "supplier"])
    assert got.columns == ["part", "supplier", "status", "response", "status", "error", "input_tokens", "output_tokens", "duration_ms", "error_kind", "cache_hit"]
    assert sorted(map(tuple, got.collect())) == [
        (1, "a", "x", "first", "completed", None, 0, 0, 0, None, True), (1, "a", "y", "first", "completed", None, 0, 0, 0, None, True), (2, "a", "z", "2a", "completed", None, 7, 0, 0, None, False),
        (3, "b", "v", None, "failed", "bad answer", 0, 0, 0, "validation", False), (5, "c", "u", None, "completed", None, 0, 0, 0, None, True)]


def test_terms_of_every_document(spark, monkeypatch):
    """All documents reach align_terms, those with plain answers too, which give no term."""
    from lectern import queries as q
    from tests.compare import DATA

    q.load_all()
    seen, whole = [], spans.align_terms
    monkeypatch.setattr(spans, "align_terms", lambda rows: seen.append(rows) or whole(rows))
    got = {r.unit_id for r in q.QUERIES["aligned_terms"](spark, f"{DATA}/sf0.001").select("unit_id").distinct().collect()}
    asked = {r.unit_id: r.response for r in seen[0].select("unit_id", "response").collect()}
    assert set(asked) == {r.doc_id for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id").collect()}
    assert got and got.isdisjoint(i for i, response in asked.items() if response == "plain answer ")


def test_repeated_calls_return_the_stored_result(spark):
    rows = [("r", "a", 1, 1, "one"), ("r", "a", 2, 1, "two"), ("r", "a", 3, 2, "three"), ("s", "a", 4, 1, "other"), ("r", "b", 5, 7, "late"), ("r", "a", 6, 9, "wrong")]
    calls = spark.createDataFrame(rows, "run_id string, tool_call_id string, at int, iteration int, result string")
    got = {r["at"]: (r.stored.result, r.replayed, r.call_no) for r in metrics.call_answers(calls, ["at"]).collect()}
    assert got == {1: ("one", False, 1), 2: ("one", True, 1), 3: ("one", True, 1), 4: ("other", False, 1)}


def test_backlog_goes_on_after_a_killed_round(spark, tmp_path):
    """Rounds that were committed are never called again; the one that died is; failed units are tried once a run."""
    calls, store = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    units = spark.createDataFrame([(f"k{i}", i) for i in range(60)] + [("k0", 0)], "cache_key string, n int").repartition(3)

    def calling(deadly):
        def call(unit):
            with open(f"{calls}/{unit['cache_key']}-{uuid.uuid4().hex}", "w"):
                pass
            if deadly and len(os.listdir(calls)) > 25:
                os._exit(1)
            if unit["n"] % 20 == 7:
                raise ValueError("bad unit")
            return {"response": f"answer {unit['n']}", "input_tokens": 2}
        return call

    with pytest.raises(Exception):  # noqa: B017 - the task is lost with its worker
        enrichment.enrich_backlog(units, store, calling(True), concurrency=2, round_size=10).collect()
    first = enrichment.stored_answers(spark, store)
    assert 0 < first.count() < 60
    settled = {r["cache_key"] for r in first.where("status = 'completed'").collect()}
    seen = collections.Counter(f.split("-")[0] for f in os.listdir(calls))
    done = enrichment.enrich_backlog(units, store, calling(False), concurrency=2, round_size=10)
    rows = done.collect()
    assert len(rows) == 61 and {r["response"] for r in rows if r["n"] % 20 != 7} == {f"answer {i}" for i in range(60) if i % 20 != 7}
    assert {r["cache_key"] for r in rows if r["status"] == "failed"} == {"k7", "k27", "k47"}
    after = collections.Counter(f.split("-")[0] for f in os.listdir(calls))
    assert all(after[k] == seen[k] == 1 for k in settled) and all(after[k] >= 1 for k in after)
    before = sum(after.values())
    assert enrichment.enrich_backlog(units, store, calling(False), concurrency=2, round_size=10).count() == 61
    assert sum(collections.Counter(f.split("-")[0] for f in os.listdir(calls)).values()) == before + 3


def test_backlog_keeps_its_rate(spark, tmp_path):
    units = spark.createDataFrame([(f"k{i}",) for i in range(6)], "cache_key string")
    began = time.monotonic()
    enrichment.enrich_backlog(units, str(tmp_path / "answers"), lambda unit: {"response": "x"}, concurrency=1, per_second=4).collect()
    assert time.monotonic() - began >= 5 / 4


def test_neighbours_move_each_text_once(spark):
    rows = [("a", i, f"t{i}") for i in range(40) if i not in (7, 20)] + [("b", 3, "only"), ("b", 4, None)]
    blocks = spark.createDataFrame(rows, "doc string, pos int, text string").repartition(3)
    texts = {(d, i): t for d, i, t in rows}
    for before, after, block in ((1, 1, 8), (2, 0, 4), (0, 9, 4), (1, 1, 8192)):
        df = corpus.neighbours(blocks, ["doc"], "pos", "text", before, after, block=block)
        assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
        got = {(r["doc"], r["pos"]): r["context"] for r in df.collect()}
        assert got == {(d, i): "\n\n".join(texts[d, j] for j in range(i - before, i + after + 1) if texts.get((d, j))) for d, i, _ in rows}
    assert corpus.neighbours(blocks, ["doc"], "pos", "text", limit=3).where("doc = 'a' and pos = 0").first()["context"] == "t0\n"


def test_graph_cache_recomputes_stale_roots(spark, tmp_path):
    papers = spark.createDataFrame([(i, f"Paper number {i} of the cache") for i in "abcd"], "id string, title string")
    refs = spark.createDataFrame([(a, 1, f"r{a}{b}", f"Paper number {b} of the cache", ["X"], 2020, None, None) for a, b in ("ab", "bc", "cd", "da")], "paper_id string, pos int, ref_id string, title string, authors array<string>, year int, doi string, arxiv string")
    refs = biblio.resolve_references(refs, papers)
    ask = lambda roots, mark, r=refs: graph.cached_graphs(spark.createDataFrame([(x,) for x in roots], "root_id string"), papers, r, mark, str(tmp_path / "cache"), buckets=3)
    plain = graph.build_graphs(papers.select(F.col("id").alias("root_id")), papers, refs)
    first = ask("ab", "f1")
    assert first.computed == 2 and sorted(r["root_id"] for r in first.summary.collect()) == ["a", "b"]
    assert ask("ab", "f1").computed == 0
    more = ask("abcd", "f1")
    assert more.computed == 2
    for mine, want in ((more.nodes, plain.nodes), (more.edges, plain.edges), (more.summary, plain.summary)):
        assert sorted(map(str, mine.select(*sorted(want.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    fewer = refs.where("paper_id <> 'a'")
    again = ask("a", "f2", fewer)
    assert again.computed == 1 and again.edges.count() == 0 and ask("bcd", "f1").computed == 0
    assert ask("a", "f1").computed == 1  # the entry of the other state has replaced it


def test_imports_update_source_rows(spark):
    """A known row keeps its item key and first import; a candidate without a paper leaves none; the first collection counts."""
    shape = "attachment_key string, item_key string, sha256 string, title string, authors array<string>, year int, doi string, target_path string, modified_at long"
    rows = [("A1", "I1", "x", "T", ["a"], 1999, None, "/1", 5), ("A2", "I2", "x", None, [], None, "10.1/2", "/2", None), ("A3", "I3", "y", "U", None, 2, None, "/3", 6)]
    candidates = spark.createDataFrame(rows, shape)
    names = spark.createDataFrame([("A1", 1, "second"), ("A1", 0, "first")], "attachment_key string, collection_order int, collection string")
    papers = spark.createDataFrame([(7, "x")], "id long, sha256 string")
    columns = "source_type string, attachment_key string, item_key string, paper_id long, source_collection string, source_path string, source_modified_at long, metadata_json string, imported_at string"
    known = spark.createDataFrame([("zotero", "A2", "old", 3, "gone", "/old", 1, "{}", "before"), ("folder", "A1", "k", 4, "c", "/k", 1, "{}", "before")], columns)
    sources = files.import_sources(candidates, names, papers, known, F.lit("now"))
    assert {tuple(r) for r in sources.collect()} == {
        ("zotero", "A1", "I1", 7, "first", "/1", 5, '{"title":"T","authors":["a"],"year":1999,"DOI":null}', "now"),
        ("zotero", "A2", "old", 7, None, "/2", None, '{"title":null,"authors":[],"year":null,"DOI":"10.1/2"}', "before"),
        ("folder", "A1", "k", 4, "c", "/k", 1, "{}", "before")}
    assert {tuple(r) for r in files.collection_members(sources).collect()} == {("first", 7), ("c", 4)}
    again = files.import_sources(candidates, names, papers, sources, F.lit("later"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in sources.collect()}


def test_tree_order_is_collated(spark):
    """Roots first, names by sound and a missing one first; children stay numbered under a parent."""
    rows = [("1", None, "中", 0), ("2", None, "阿", 0), ("3", "1", "A", 0), ("4", None, "b", 0), ("5", None, "B", 1), ("6", None, None, 0)]
    got = graph.tree_order(spark.createDataFrame(rows, "id string, parent_id string, name string, sort_order int")).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == ["6", "2", "1", "4", "5", "3"]
    papers = spark.createDataFrame([("p",)], "id string")
    members = spark.createDataFrame([("p", "c2", 1), ("p", "c1", 2), ("q", "c1", 1)], "paper_id string, collection_id string, assigned_at int")
    figures = spark.createDataFrame([("p", "f", None), ("p", "e", 3), ("p", "d", 3)], "paper_id string, figure_id string, page int")
    children = retrieval.listing_children(papers, members, figures)
    assert {tuple(r) for r in children.collect()} == {("p", "collection", 1, "c2"), ("p", "collection", 2, "c1"), ("p", "figure", 1, "f"), ("p", "figure", 2, "d"), ("p", "figure", 3, "e")}


def test_terms_do_not_carry_their_source(spark):
    """A term meets the text of its sentence only: with the source on every row a long text was shuffled once per term."""
    source = "Alpha model is here. " * 3 + "Beta method is there."
    answer = '{"segments": [{"id": "sentence-4", "translatedText": "B"}], "terms": [{"text": "Beta", "translation": "B", "segmentId": "sentence-4"}, {"text": "Alpha", "translation": "A", "sourceStart": 21, "sourceEnd": 26}]}'
    rows = spark.createDataFrame([("u", source, answer)], ["unit_id", "source", "response"])
    out = spans.align_terms(rows)
    got = {r["text"]: (r["source_start"], r["source_end"]) for r in out.collect()}
    assert got == {"Beta": (63, 67), "Alpha": (21, 26)}
    plan = out._jdf.queryExecution().optimizedPlan()
    todo, joined = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            joined.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert joined and not any("source" in names for names in joined)


def test_reprojection_works_by_slices(spark, monkeypatch):
    """More records than a slice, in one batch: only a slice becomes Python objects at a time, and none is lost."""
    monkeypatch.setattr(spans, "SLICE", 3)
    rows = [(k, f"one {k}. two {k}.", f"one {k}.  two {k}.", [("s1", 0, 5 + len(str(k))), ("s2", 6 + len(str(k)), 11 + 2 * len(str(k)))]) for k in range(10)]
    records = spark.createDataFrame(rows, "record_id long, old_text string, new_text string, segments array<struct<segment_id:string,start:int,end:int>>").coalesce(1)
    out = spans.reproject(records).collect()
    assert sorted((r["record_id"], r["segment_id"]) for r in out) == [(k, s) for k in range(10) for s in ("s1", "s2")]
    assert {r["status"] for r in out} == {"whitespace-remapped"}
