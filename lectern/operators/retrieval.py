"""Library listings, searches and the read tools, each over a whole table of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.jsontext import overriding, tolerant_list, tolerant_object
from lectern.session import checkpointed
from lectern.skew import contains_pairs, exploded, first_rows, number_children, number_rows

# States that count as done or as trouble in the status buckets.
ISSUE_STATES = ["FAILED", "MISSING", "CANCELLED"]
SETTLED_STATES = ["READY", "FAILED", "MISSING"]
# Evidence is sought in batches of sections: the size of the first, and how much larger each next one is.
BATCH, GROWTH = 256, 8


def status_flags(status: Column) -> dict[str, Column]:
    """Bucket membership: ready, issues, processing; a cancelled paper is in the last two."""
    return {"ready": status == "READY", "issues": status.isin(*ISSUE_STATES), "processing": ~status.isin(*SETTLED_STATES)}


def library_filter(papers: DataFrame, query: str = "", bucket: str = "all") -> DataFrame:
    found = papers
    if query.strip():
        hay = F.lower(F.concat_ws(" ", "title", F.coalesce("source_path", F.lit(""))))
        found = found.where(F.contains(hay, F.lower(F.lit(query.strip()))))
    return found if bucket == "all" else found.where(status_flags(F.col("status"))[bucket])


def scope(papers: DataFrame, name: str) -> DataFrame:
    """Favorites, reading or recent papers with their ``place``: newest first, unreadable times last."""
    def placed(rows: DataFrame, column: str) -> DataFrame:
        at = F.coalesce(F.try_to_timestamp(F.col(column).cast("string")), F.lit("1970-01-01").cast("timestamp"))
        return number_rows(rows.withColumn("_less", -F.unix_micros(at)), [], ["_less", "id"], "place").drop("_less")

    if name == "favorites":
        return placed(papers.where("is_favorite"), "favorited_at")
    if name == "reading":
        return placed(papers.where("last_read_at is not null"), "last_read_at")
    return placed(papers, "created_at")


def effective_metadata(papers: DataFrame, fields: tuple[str, ...] = ("year", "venue", "doi", "abstract")) -> DataFrame:
    """Metadata as shown: a manual value wins whenever its key exists, even as null."""
    meta = tolerant_object(F.col("metadata_json"))
    manual = tolerant_object(F.get_json_object(meta, "$.manualOverrides"))
    read = papers.withColumn("_meta", meta).withColumn("_manual", manual)
    m, o = F.col("_meta"), F.col("_manual")

    def listed(key: str) -> Column:
        return F.filter(tolerant_list(overriding(m, o, key)), lambda v: F.trim(v) != "").alias(key)

    return read.select(*papers.columns, *[overriding(m, o, f).alias(f) for f in fields], listed("authors"), listed("tags"))


def library_listing(papers: DataFrame, jobs: DataFrame, files: DataFrame, engagement: DataFrame) -> DataFrame:
    """One row per paper with its latest job, its first present file and its reading state.

    Nested lists of the listing (collections, figures) stay separate ordered tables:
    ``ordered_children``.
    """
    job = first_rows(jobs, ["paper_id"], [F.col("created_at").desc(), F.col("id").desc()]).select(
        "paper_id", F.col("progress").alias("job_progress"), "error")
    file = first_rows(files, ["paper_id"], [F.col("is_missing"), F.col("created_at"), F.col("id")]).select("paper_id", F.col("absolute_path").alias("source_path"))
    read = engagement.select("paper_id", "is_favorite", "favorited_at", "last_read_at", "last_section_id", "last_page", "reading_progress")
    key = papers["id"]
    joined = papers.join(job, key == job["paper_id"], "left").drop("paper_id")
    joined = joined.join(file, joined["id"] == file["paper_id"], "left").drop("paper_id")
    joined = joined.join(read, joined["id"] == read["paper_id"], "left").drop("paper_id")
    progress = F.coalesce("job_progress", F.when(F.col("status") == "READY", 1.0).otherwise(0.0))
    return (
        joined.withColumn("progress", progress).drop("job_progress")
        .withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))
        .withColumn("reading_progress", F.coalesce("reading_progress", F.lit(0.0)))
    )


def ordered_children(children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Children with their ``place`` under each parent, as rows (no nested list to overflow).

    ``order`` ends with a column that is unique under a parent.  A parent of very many children is numbered by blocks.
    """
    return number_children(children, [key], order, "place")


def listing_children(papers: DataFrame, collections: DataFrame, figures: DataFrame) -> DataFrame:
    """``paper_id, kind, place, child_id``: the collections of each listed paper by time of assignment and its figures by page.

    ``collections(paper_id, collection_id, assigned_at)``, ``figures(paper_id, figure_id, page)``; a null page comes first.
    """
    listed = papers.select(F.col("id").alias("paper_id"))
    parts = (("collection", collections, "collection_id", "assigned_at"), ("figure", figures, "figure_id", "page"))
    placed_parts = [
        ordered_children(rows, "paper_id", [by, child]).join(listed, "paper_id", "left_semi").select("paper_id", F.lit(kind).alias("kind"), "place", F.col(child).alias("child_id"))
        for kind, rows, child, by in parts]
    return placed_parts[0].unionByName(placed_parts[1])


# ------------------------------------------------------------------------------- tools

def search_titles(calls: DataFrame, papers: DataFrame) -> DataFrame:
    """``calls(call_id, query, limit)``: newest papers whose folded title holds the query.

    Titles are matched once per distinct query through an equi-join on substrings; limits are
    clamped to 1..20 and applied inside every map partition first.
    """
    asked = calls.select("call_id", T.fold(F.col("query")).alias("q"), F.least(F.greatest(F.coalesce("limit", F.lit(10)), F.lit(1)), F.lit(20)).alias("n"))
    titled = papers.select(F.col("id").alias("paper_id"), "title", "updated_at", T.fold(F.col("title")).alias("t"))
    hits = contains_pairs(asked.select("q").where("q <> ''").distinct(), titled.select("t").distinct(), "q", "t")
    # Twenty papers per title, then twenty per query, are all a call can return.
    newest = [F.col("updated_at").desc(), F.col("paper_id")]
    found = hits.join(first_rows(titled, ["t"], newest, 20), "t")
    best = first_rows(found, ["q"], newest, 20, rank="rank")
    return asked.join(best, "q").where("rank <= n").select("call_id", "rank", "paper_id", "title")


def read_document(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """``calls(call_id, paper_id, max_chars)``: the text cut to 1,000..100,000 characters."""
    cap = F.least(F.greatest(F.coalesce("max_chars", F.lit(60000)), F.lit(1000)), F.lit(100000))
    return calls.join(documents, "paper_id").select("call_id", "paper_id", F.left("markdown", cap).alias("markdown"), (F.length("markdown") > cap).alias("truncated"))


def read_section(calls: DataFrame, section_rows: DataFrame) -> DataFrame:
    """The first section whose id, or folded title, is the one asked for."""
    wanted = calls.select("call_id", "paper_id", F.col("section_id").alias("w"))
    by_id = wanted.join(section_rows, (section_rows["paper_id"] == wanted["paper_id"]) & (section_rows["section_id"] == wanted["w"])).drop(section_rows["paper_id"])
    by_title = wanted.join(section_rows, (section_rows["paper_id"] == wanted["paper_id"]) & (T.fold(section_rows["title"]) == T.fold(wanted["w"]))).drop(section_rows["paper_id"])
    both = by_id.unionByName(by_title)
    hit = first_rows(both, ["call_id"], [F.col("ord")])
    return hit.withColumn("markdown", F.left("markdown", F.lit(80000))).drop("w")


def section_anchors(hits: DataFrame, anchor_rows: DataFrame, limit: int = 100) -> DataFrame:
    """The first hundred anchors of each section read."""
    joined = hits.select("call_id", "paper_id", "section_id").join(anchor_rows, ["paper_id", "section_id"])
    return first_rows(joined, ["call_id"], [F.col("chunk_no")], limit, rank="anchor_no")


def read_figures(calls: DataFrame, figures: DataFrame, limit: int = 50) -> DataFrame:
    """Figures of a paper, one or all, without their path columns."""
    shown = figures.drop("relative_path", "thumbnail_path")
    joined = calls.select("call_id", "paper_id", F.col("figure_id").alias("w")).join(shown, "paper_id")
    wanted = joined.where((F.trim(F.coalesce("w", F.lit(""))) == "") | (F.col("w") == F.col("figure_id"))).drop("w")
    return first_rows(wanted, ["call_id"], [F.col("page"), F.col("figure_id")], limit, rank="figure_no")


def read_references(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """The first 1..200 references of a paper in document order.

    References are cut to 200 per paper before the join, so a paper asked for many times is
    not multiplied by its whole list.
    """
    n = F.least(F.greatest(F.coalesce("limit", F.lit(100)), F.lit(1)), F.lit(200))
    listed = first_rows(refs, ["paper_id"], [F.col("pos")], 200, rank="ref_no")
    return calls.select("call_id", "paper_id", n.alias("n")).join(listed, "paper_id").where("ref_no <= n").drop("n")


def section_batches(sections: DataFrame) -> list[Column]:
    """Conditions on ``ord`` that part the sections, in their order, into batches of about 256, 2,048, 16,384 and so on.

    Every section is in one batch.  Where a batch ends is told by every 8th, 64th, ... section as its hash has it, of which the
    first 256 are kept inside the map tasks; sections without an order come first.
    """
    n, steps = sections.count(), 0
    while BATCH * GROWTH**steps < n:
        steps += 1
    if not steps:
        return [F.lit(True)]
    marks = F.array(*[F.when(F.pmod(F.xxhash64("ord"), F.lit(GROWTH**k)) == 0, k) for k in range(steps)])
    ends = first_rows(exploded(sections.where("ord is not null"), marks, "_step", "ord"), ["_step"], [F.col("ord")], BATCH).groupBy("_step").agg(F.max("ord").alias("ord"))
    cuts = ends.agg(F.transform(F.array_sort(F.collect_set("ord")), lambda o: F.to_json(F.struct(o.alias("ord")))).alias("cuts")).first()["cuts"]
    shape = f"struct<ord:{sections.schema['ord'].dataType.simpleString()}>"
    beyond = [F.coalesce(F.col("ord") > F.from_json(F.lit(c), shape)["ord"], F.lit(False)) for c in cuts]
    return [low & ~high for low, high in zip([F.lit(True), *beyond], [*beyond, F.lit(False)], strict=True)]


def term_postings(sections: DataFrame, limit: int, scopes: DataFrame | None = None, everywhere: bool = True) -> DataFrame:
    """Stored lists ``(scope, token, section_key, ord)``: the first ``limit`` sections of each piece of text between spaces.

    Sections stand in the list of all papers (scope ``''``; not without ``everywhere``) and, for ``scopes(scope)``, in that of their own
    paper.  The lists are cut inside the map tasks and written once, so texts are split once however often the lists are read.
    """
    if scopes is not None and not everywhere:
        own = sections.withColumn("scope", F.col("paper_id").cast("string")).join(scopes, "scope", "left_semi")
        tokens = exploded(own, F.array_distinct(T.words(F.lower("text"))), "token", "section_key", "ord", "scope")
        return checkpointed(first_rows(tokens, ["token", "scope"], [F.col("ord")], limit).select("scope", "token", "section_key", "ord"))
    paper = [] if scopes is None else [F.col("paper_id").cast("string").alias("_paper")]
    tokens = exploded(sections, F.array_distinct(T.words(F.lower("text"))), "token", "section_key", "ord", *paper)
    lists = tokens.withColumn("scope", F.lit(""))
    if scopes is not None:
        asked = scopes.select(F.col("scope").alias("_paper"), F.lit(True).alias("_asked"))
        both = F.when(F.col("_asked"), F.array(F.lit(""), F.col("_paper"))).otherwise(F.array(F.lit("")))
        lists = tokens.join(asked, "_paper", "left").select("token", "section_key", "ord", F.explode(both).alias("scope"))
    # The token leads the sort: the scope is nearly always empty and would leave every comparison to whole rows.
    kept = first_rows(lists, ["token", "scope"], [F.col("ord")], limit)
    return checkpointed(kept.select("scope", "token", "section_key", "ord"))


def find_evidence(queries: DataFrame, sections: DataFrame, limit: int = 10, before: int = 180, after: int = 420, carry: tuple[str, ...] = ()) -> DataFrame:
    """The first sections, in order, that hold any of a query's terms, with a snippet.

    ``queries(query_id, query)`` with an optional ``limit`` (1..20) of each call, else the argument, and an optional ``paper_id`` that
    confines a call to the sections of one paper; ``carry`` names section columns of the result (titles, page).  ``sections(section_key, ord, text)`` with one total
    order.  A term is a piece of the query between spaces, so a hit lies inside one piece of
    the text.  Sections are met in their order, in batches that grow eightfold, and a query leaves once it has its sections:
    later ones cannot come before them.  Queries that do not fill their lists meet all sections.
    In a batch only the first ``limit`` sections of each text piece can matter for any term,
    and only the first ``limit`` of each term for any query, so both are cut inside the map
    tasks; terms meet the vocabulary (not the texts) through an equi-join on substrings.
    Texts are looked at again only for the sections that are returned.
    """
    own = F.least(F.greatest(F.coalesce(F.col("limit"), F.lit(limit)), F.lit(1)), F.lit(20)) if "limit" in queries.columns else F.lit(max(1, min(limit, 20)))
    limit = 20 if "limit" in queries.columns else max(1, min(limit, 20))
    pieces = F.filter(T.words(F.col("query")), lambda w: F.length(w) > 1)
    inside = F.coalesce(F.col("paper_id").cast("string"), F.lit("")) if "paper_id" in queries.columns else F.lit("")
    asked = queries.select("query_id", inside.alias("scope"), own.alias("_own"), F.transform(F.slice(pieces, 1, 8), lambda w: F.lower(w)).alias("terms")).where(F.size("terms") > 0)
    asked = checkpointed(asked)
    scoped, everywhere = "paper_id" in queries.columns, True
    waiting, found = asked, None
    batches = section_batches(sections)
    for at, batch in enumerate(batches):
        if scoped:
            everywhere = not waiting.where("scope = ''").isEmpty()
        terms = waiting.select("query_id", "scope", F.explode(F.array_distinct("terms")).alias("term"))
        scopes = waiting.select("scope").where("scope <> ''").distinct() if scoped else None
        postings = term_postings(sections.where(batch), limit, scopes, everywhere)
        matches = contains_pairs(terms.select("term").distinct(), postings.select("token").distinct(), "term", "token")
        per_term = matches.join(postings, "token").select("term", "scope", "section_key", "ord").distinct()
        per_term = first_rows(per_term, ["term", "scope"], [F.col("ord")], limit)
        per_query = terms.join(per_term, ["scope", "term"]).select("query_id", "section_key", "ord").distinct()
        here = checkpointed(first_rows(per_query, ["query_id"], [F.col("ord")], limit))
        found = here if found is None else found.unionByName(here)
        if at + 1 < len(batches):
            filled = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
            waiting = checkpointed(asked.join(filled, "query_id", "left").where("coalesce(_n, 0) < _own").select(*asked.columns))
            if waiting.isEmpty():
                break
    top = first_rows(found, ["query_id"], [F.col("ord")], limit, rank="rank")

    shown = top.join(asked, "query_id").where("rank <= _own").join(sections.select("section_key", "text", *carry), "section_key")
    low = F.lower("text")
    at = F.array_min(F.filter(F.transform("terms", lambda t: F.call_function("instr", low, t)), lambda p: p > 0)) - 1
    placed = shown.withColumn("position", at)
    start = F.greatest(F.lit(0), F.col("position") - before)
    snippet = F.substring(F.col("text"), start + 1, F.col("position") + after - start)
    return placed.select("query_id", "rank", "section_key", "position", T.strip(snippet).alias("snippet"), *carry)


def visible_tools(profiles: DataFrame, registry: DataFrame) -> DataFrame:
    """Declared tools of each profile, in the order its list allows them."""
    listed = profiles.select("profile_id", F.posexplode("allowed").alias("pos", "tool_name"))
    return listed.join(registry.select("tool_name"), "tool_name", "left_semi")


def judge_calls(calls: DataFrame, runs: DataFrame, profiles: DataFrame, registry: DataFrame) -> DataFrame:
    """Allowed when profile, run snapshot (if it names any tool) and registry all list it."""
    known = registry.select("tool_name", F.lit(True).alias("_known"))
    joined = calls.join(runs.select("run_id", "profile_id", "snapshot_tools"), "run_id", "left").join(profiles.select("profile_id", "allowed"), "profile_id", "left").join(known, "tool_name", "left")
    in_profile = F.coalesce(F.array_contains("allowed", F.col("tool_name")), F.lit(False))
    in_snapshot = (F.coalesce(F.size("snapshot_tools"), F.lit(0)) <= 0) | F.array_contains("snapshot_tools", F.col("tool_name"))
    allowed = in_profile & F.coalesce(in_snapshot, F.lit(True)) & F.coalesce("_known", F.lit(False))
    return joined.withColumn("decision", F.when(allowed, "allowed").otherwise("denied")).drop("_known", "allowed", "snapshot_tools")


def templates(rows: DataFrame, category: str | None = None, query: str = "") -> DataFrame:
    found = rows if category is None else rows.where(F.col("category") == category)
    if query.strip():
        found = found.where(F.contains(F.lower(F.concat("name", "content")), F.lower(F.lit(query.strip()))))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("sort_order", F.col("updated_at").desc(), "id")))


def recent_turns(turns: DataFrame, key: str, order: str, n: int = 6, retried: Column | None = None) -> DataFrame:
    """The last turns before the answer, without the one retried."""
    usable = turns if retried is None else turns.where(~retried)
    return first_rows(usable, [key], [F.col(order).desc()], n, rank="age")


def as_messages(turns: DataFrame) -> DataFrame:
    """A user and an assistant message per turn, in order."""
    pair = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("question").alias("text")),
                   F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return turns.select("conversation_id", "turn", F.explode(pair).alias("m")).select("conversation_id", "turn", "m.*").where("text is not null")


def newest(rows: DataFrame, by: str, n: int, low: int = 1, high: int = 200) -> DataFrame:
    """Newest n rows overall (n clamped): planned as a distributed top-k."""
    return rows.orderBy(F.col(by).desc(), F.col("id").desc()).limit(max(low, min(n, high)))
