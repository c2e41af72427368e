"""Library listing, scopes, files, sampling, export tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import context, files, metrics, retrieval, revisions, tools
from lectern.operators.enrichment import missing_keys
from lectern.queries import query
from lectern.queries.tables import PAPERS, papers, table

JOB_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || '-' || (l_extendedprice * 100)::BIGINT"


def _job_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))


def _listing_inputs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("id", _job_id())
    jobs = li.select("id", F.col("l_orderkey").alias("paper_id"), F.col("l_shipdate").alias("created_at"), F.col("l_discount").alias("progress"), F.when(F.col("l_returnflag") == "R", "refused").alias("error"))
    held = li.select("id", F.col("l_orderkey").alias("paper_id"), (F.col("l_linestatus") == "F").alias("is_missing"), F.col("l_shipdate").alias("created_at"), F.concat(F.lit("/files/"), F.col("l_partkey").cast("string")).alias("absolute_path"))
    p = papers(spark, sf_dir)
    read = p.where("id % 4 = 0").select(F.col("id").alias("paper_id"), "is_favorite", "favorited_at", "last_read_at", F.lit(None).cast("string").alias("last_section_id"), F.lit(1).alias("last_page"), (F.col("id") % 10 / 10).alias("reading_progress"))
    return p.select("id", "title", "status", "created_at"), jobs, held, read


@query("library_listing", f"""WITH p AS ({PAPERS}), l AS (SELECT *, {JOB_ID} AS id FROM lineitem),
j AS (SELECT l_orderkey AS paper_id, l_discount AS progress, CASE WHEN l_returnflag = 'R' THEN 'refused' END AS error, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, id DESC) AS r FROM l),
f AS (SELECT l_orderkey AS paper_id, '/files/' || l_partkey AS source_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'F', l_shipdate, id) AS r FROM l)
SELECT p.id, p.title, p.status, coalesce(j.progress, CASE WHEN p.status = 'READY' THEN 1.0 ELSE 0.0 END)::DOUBLE AS progress, j.error, f.source_path, CASE WHEN p.id % 4 = 0 THEN p.is_favorite ELSE false END AS is_favorite,
  CASE WHEN p.id % 4 = 0 THEN p.id % 10 / 10.0 ELSE 0 END::DOUBLE AS reading_progress FROM p LEFT JOIN j ON j.paper_id = p.id AND j.r = 1 LEFT JOIN f ON f.paper_id = p.id AND f.r = 1""")
def library_listing(spark, sf_dir):
    return retrieval.library_listing(*_listing_inputs(spark, sf_dir)).select("id", "title", "status", "progress", "error", "source_path", "is_favorite", "reading_progress")


@query("listing_children", f"""WITH l AS (SELECT *, {JOB_ID} AS id FROM lineitem), p AS ({PAPERS})
SELECT l_orderkey AS paper_id, 'collection' AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, id) AS place, id AS child_id FROM l WHERE l_orderkey IN (SELECT id FROM p)
UNION ALL SELECT l_orderkey, 'figure', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id), id FROM l WHERE l_orderkey IN (SELECT id FROM p)""")
def listing_children(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), _job_id().alias("id"), "l_shipdate", "l_linenumber")
    collections = li.select("paper_id", F.col("id").alias("collection_id"), F.col("l_shipdate").alias("assigned_at"))
    figures = li.select("paper_id", F.col("id").alias("figure_id"), F.col("l_linenumber").alias("page"))
    return retrieval.listing_children(papers(spark, sf_dir), collections, figures)


@query("nested_jobs", """WITH p AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)
SELECT p.o_orderkey AS paper_id, l_linenumber AS stage, l_partkey AS part FROM p LEFT JOIN lineitem ON l_orderkey = p.o_orderkey""")
def nested_jobs(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderdate")
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("stage"), F.col("l_partkey").alias("part"))
    return metrics.nested_in_order(parents, children, "paper_id", "o_orderdate", "stage", 200).select("paper_id", "stage", "part")


@query("newest_runs", f"WITH p AS ({PAPERS}) SELECT id, title FROM p ORDER BY created_at DESC, id DESC LIMIT 100")
def newest_runs(spark, sf_dir):
    return retrieval.newest(papers(spark, sf_dir), "created_at", 100, 1, 100).select("id", "title")


@query("library_filter", f"WITH p AS ({PAPERS}) SELECT id, title FROM p WHERE contains(lower(title || ' ' || source_path), 'urgent') AND status NOT IN ('READY', 'FAILED', 'MISSING')")
def library_filter(spark, sf_dir):
    return retrieval.library_filter(papers(spark, sf_dir), " Urgent ", "processing").select("id", "title")


@query("status_buckets", f"WITH p AS ({PAPERS}) SELECT collection_id, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status IN ('FAILED', 'MISSING', 'CANCELLED')) AS issues, count(*) FILTER (WHERE status NOT IN ('READY', 'FAILED', 'MISSING')) AS processing FROM p GROUP BY 1")
def status_buckets(spark, sf_dir):
    flags = retrieval.status_flags(F.col("status"))
    return papers(spark, sf_dir).groupBy("collection_id").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


@query("scope_lists", f"WITH p AS ({PAPERS}) SELECT 'favorites' AS scope, id, row_number() OVER (ORDER BY favorited_at DESC, id) AS place FROM p WHERE is_favorite UNION ALL SELECT 'reading', id, row_number() OVER (ORDER BY last_read_at DESC, id) FROM p WHERE last_read_at IS NOT NULL UNION ALL SELECT 'recent', id, row_number() OVER (ORDER BY created_at DESC, id) FROM p")
def scope_lists(spark, sf_dir):
    p = papers(spark, sf_dir)
    parts = [retrieval.scope(p, s).select(F.lit(s).alias("scope"), "id", "place") for s in ("favorites", "reading", "recent")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sidebar_counts", f"WITH p AS ({PAPERS}) SELECT count(*) AS papers, count(*) FILTER (WHERE id NOT IN (SELECT l_orderkey FROM lineitem)) AS uncategorized, count(*) FILTER (WHERE is_favorite) AS favorites, count(last_read_at) AS reading FROM p")
def sidebar_counts(spark, sf_dir):
    return metrics.sidebar_counts(papers(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id")))


@query("papers_per_collection", f"WITH p AS ({PAPERS}) SELECT collection_id, id AS paper_id, title, row_number() OVER (PARTITION BY collection_id ORDER BY title, id) AS place FROM p")
def papers_per_collection(spark, sf_dir):
    p = papers(spark, sf_dir)
    return metrics.papers_per_collection(p.select("collection_id", F.col("id").alias("paper_id")), p)


META = """(CASE WHEN id % 7 = 0 THEN 'broken {' WHEN id % 7 = 1 THEN '[1]' ELSE '{"year": 1999, "doi": "10.1/' || id || '", "authors": ["A ' || id || '", " "], "tags": ["x"]' ||
  (CASE WHEN id % 7 = 2 THEN ', "manualOverrides": {"year": null, "tags": ["m", ""]}' WHEN id % 7 = 3 THEN ', "manualOverrides": {"doi": "m' || id || '", "authors": []}' ELSE '' END) || '}' END)"""


@query("effective_metadata", f"""WITH p AS ({PAPERS}) SELECT id, CASE WHEN id % 7 <= 2 THEN NULL ELSE '1999' END AS year, CASE WHEN id % 7 <= 1 THEN NULL WHEN id % 7 = 3 THEN 'm' || id ELSE '10.1/' || id END AS doi,
  CASE WHEN id % 7 IN (0, 1, 3) THEN '' ELSE 'A ' || id END AS authors, CASE WHEN id % 7 <= 1 THEN '' WHEN id % 7 = 2 THEN 'm' ELSE 'x' END AS tags FROM p""")
def effective_metadata(spark, sf_dir):
    p = papers(spark, sf_dir).select("id")
    k, i = F.col("id") % 7, F.col("id").cast("string")
    manual = F.when(k == 2, F.lit(', "manualOverrides": {"year": null, "tags": ["m", ""]}')).when(k == 3, F.concat(F.lit(', "manualOverrides": {"doi": "m'), i, F.lit('", "authors": []}'))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"year": 1999, "doi": "10.1/'), i, F.lit('", "authors": ["A '), i, F.lit('", " "], "tags": ["x"]'), manual, F.lit("}"))
    rows = p.withColumn("metadata_json", F.when(k == 0, F.lit("broken {")).when(k == 1, F.lit("[1]")).otherwise(body))
    return retrieval.effective_metadata(rows).select("id", "year", "doi", F.array_join("authors", "|").alias("authors"), F.array_join("tags", "|").alias("tags"))


@query("paper_violations", r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'title_empty' WHEN c_custkey % 5 = 1 THEN 'title_long,year_range' WHEN c_custkey % 5 = 2 THEN 'doi_long' ELSE '' END AS violations, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Customer ' || c_custkey END AS head FROM customer""")
def paper_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey") % 5, F.concat(F.lit("Customer  "), F.col("c_custkey").cast("string"))
    rows = c.select(
        "c_custkey", F.when(k == 0, F.lit(" \n ")).when(k == 1, F.concat(name, F.repeat(F.lit(" x"), F.lit(300)))).otherwise(name).alias("title"), F.when(k == 1, 999).when(k == 3, 1000).alias("year"),
        F.when(k == 2, F.repeat(F.lit("d"), F.lit(301))).alias("doi"), F.lit("").alias("abstract"), F.lit("").alias("venue"), F.array(F.lit(" ")).alias("authors"), F.array(F.lit("a"), F.lit(" a ")).alias("tags"))
    out = revisions.validate_papers(rows)
    return out.select("c_custkey", F.array_join("violations", ",").alias("violations"), F.concat_ws(" ", F.slice(F.split("title", " "), 1, 2)).alias("head"))


@query("reject_rows", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'page_range' WHEN page_id % 4 = 1 THEN 'progress_range' ELSE '' END AS reading, CASE WHEN page_id % 3 = 0 THEN 'name_length,name_separator,color_format'[13:] ELSE '' END AS collection, page_id % 2 = 0 AS inside FROM pages""")
def reject_rows(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    reading = revisions.reading_violations(F.when(k % 4 == 1, F.lit(1.5)).otherwise(F.lit(0.5)), F.when(k % 4 == 0, 0).otherwise(1))
    collection = revisions.collection_violations(F.when(k % 3 == 0, F.lit("a/b")).otherwise(F.lit("good")), F.when(k % 3 == 0, F.lit("#12")).otherwise(F.lit(None).cast("string")))
    path = F.when(k % 2 == 0, F.concat(F.lit("/library/"), k.cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("/library/../"), k.cast("string"), F.lit(".pdf")))
    return p.select("page_id", F.array_join(reading, ",").alias("reading"), F.array_join(collection, ",").alias("collection"), revisions.inside_root(path, "/library").alias("inside"))


# ---------------------------------------------------------------------- reconciliation

STATE = """
WITH d AS (SELECT doc_id, printf('/library/%07d.pdf', doc_id) AS path, sha256(text) AS sha, n_chars, doc_id % 10 AS m FROM documents),
known AS (SELECT doc_id AS id, CASE WHEN m = 1 THEN '/old' || path WHEN m = 9 THEN '/library/copies' || path ELSE path END AS path, CASE WHEN m = 4 THEN sha256(sha) ELSE sha END AS sha, CASE WHEN m = 3 THEN n_chars + 1 ELSE n_chars END AS n, m FROM d WHERE m <> 2 AND m <> 8),
listing AS (SELECT path, sha, n_chars AS n FROM d WHERE m <> 7 UNION ALL SELECT '/library/copies' || path, sha, n_chars FROM d WHERE m = 9),
j AS (SELECT l.path AS path, l.sha AS sha, k.path AS kp, k.id, k.sha AS ks, CASE WHEN l.path IS NOT NULL AND k.id IS NOT NULL AND l.n = k.n AND l.sha = k.sha THEN 'unchanged' WHEN l.path IS NOT NULL AND k.id IS NOT NULL AND l.sha = k.sha THEN 'touched' WHEN l.path IS NOT NULL AND k.id IS NOT NULL THEN 'replaced' WHEN l.path IS NOT NULL THEN 'arrived' ELSE 'gone' END AS st FROM listing l FULL JOIN known k ON l.path = k.path)
"""


MATCHED = STATE + """, a AS (SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM j WHERE st IN ('arrived', 'replaced')),
m AS (SELECT id, kp, ks, st, row_number() OVER (PARTITION BY ks ORDER BY id) AS n FROM j WHERE st IN ('gone', 'replaced')),
mv AS (SELECT a.path, a.sha, m.id FROM a JOIN m ON a.sha = m.ks AND a.n = m.n),
own AS (SELECT sha, min(id) AS id FROM known GROUP BY 1),
rest AS (SELECT a.path, a.sha, own.id, min(a.path) OVER (PARTITION BY a.sha) AS lead FROM a LEFT JOIN own ON own.sha = a.sha WHERE a.path NOT IN (SELECT path FROM mv))"""


@query("file_reconcile", MATCHED + """
SELECT path, st AS action, id AS file_id, sha AS sha256 FROM j WHERE st IN ('unchanged', 'touched') UNION ALL SELECT path, 'moved', id, sha FROM mv
UNION ALL SELECT path, CASE WHEN id IS NOT NULL OR path <> lead THEN 'duplicate' ELSE 'new' END, NULL, sha FROM rest
UNION ALL SELECT kp, CASE WHEN st = 'gone' THEN 'missing' ELSE 'superseded' END, id, ks FROM m WHERE id NOT IN (SELECT id FROM mv)""")
def file_reconcile(spark, sf_dir):
    """Two states of a library made from the documents: moved, changed, deleted, copied files."""
    return files.reconcile(*_two_states(spark, sf_dir)).select("path", "action", "file_id", "sha256")


def _two_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.format_string("/library/%07d.pdf", "doc_id").alias("path"), F.sha2("text", 256).alias("sha"), "n_chars", (F.col("doc_id") % 10).alias("m"))
    m = F.col("m")
    known = d.where("m <> 2 and m <> 8").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("paper_id"), F.when(m == 1, F.concat(F.lit("/old"), "path")).when(m == 9, F.concat(F.lit("/library/copies"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(m == 4, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha256"), F.when(m == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size_bytes"), F.lit(0).cast("long").alias("modified_at_ns"), F.lit(False).alias("is_missing"), F.col("doc_id").alias("created_at"))
    now = d.where("m <> 7").unionByName(d.where("m = 9").withColumn("path", F.concat(F.lit("/library/copies"), "path")))
    listing = now.select("path", F.col("n_chars").alias("size_bytes"), F.when(m == 4, 1).otherwise(0).cast("long").alias("modified_at_ns"), F.col("sha").alias("sha256"))
    return listing, known


@query("changed_files", STATE + " SELECT l.path FROM listing l LEFT JOIN known k ON l.path = k.path WHERE k.id IS NULL OR l.n <> k.n OR k.m = 4")
def changed_files(spark, sf_dir):
    return files.changed_files(*_two_states(spark, sf_dir)).select("path")


@query("paper_states", MATCHED + """,
present AS (SELECT id FROM j WHERE st IN ('unchanged', 'touched') UNION SELECT id FROM mv UNION SELECT id FROM rest WHERE id IS NOT NULL), lost AS (SELECT id FROM m WHERE id NOT IN (SELECT id FROM mv))
SELECT id, CASE WHEN id NOT IN (SELECT id FROM present) AND id IN (SELECT id FROM lost) THEN 'MISSING' ELSE 'READY' END AS status FROM known""")
def paper_states(spark, sf_dir):
    listing, known = _two_states(spark, sf_dir)
    p = known.select(F.col("paper_id").alias("id"), F.lit("READY").alias("status"))
    return files.paper_states(p, known, files.reconcile(listing, known)).select("id", "status")


@query("link_imports", """SELECT d.doc_id::VARCHAR AS attachment_key, (SELECT min(e.doc_id) FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text) AS paper_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)""")
def link_imports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    linked, _ = files.link_imports(d.select(F.col("doc_id").cast("string").alias("attachment_key"), "sha256"), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "sha256"))
    return linked.select("attachment_key", "paper_id")


def _import_inputs(spark, sf_dir):
    """Documents as attachments, equal texts being one paper; labelled ones were imported before."""
    d = table(spark, sf_dir, "documents").withColumns({"sha256": F.sha2("text", 256), "key": F.concat(F.lit("A"), F.col("doc_id").cast("string"))})
    candidates = d.select(
        F.col("key").alias("attachment_key"), F.concat(F.lit("I"), F.col("doc_id").cast("string")).alias("item_key"), "sha256", F.concat(F.lit("T"), F.col("n_chars").cast("string")).alias("title"), F.array(F.col("source")).alias("authors"),
        F.lit(2020).alias("year"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("/papers/"), F.col("doc_id").cast("string")).alias("target_path"), F.lit(7).cast("long").alias("modified_at"), F.col("lang").alias("category"), F.ceil(F.col("n_chars") / 1000).alias("page_count"))
    names = d.select(F.col("key").alias("attachment_key"), F.posexplode(F.array("source", "lang")).alias("collection_order", "collection")).where("collection is not null")
    owners = d.groupBy("sha256").agg(F.min("doc_id").alias("id")).where("sha256 is not null")
    keys = table(spark, sf_dir, "labels").select("doc_id").distinct()
    held = keys.select(
        F.lit("zotero").alias("source_type"), F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("attachment_key"), F.lit("old").alias("item_key"), F.lit(-1).cast("long").alias("paper_id"), F.lit("before").alias("source_collection"),
        F.lit("/old").alias("source_path"), F.lit(1).cast("long").alias("source_modified_at"), F.lit("{}").alias("metadata_json"), F.lit("2020-01-01").alias("imported_at"))
    return candidates, names, owners, held


IMPORTED = """WITH d AS (SELECT 'A' || doc_id AS attachment_key, 'I' || doc_id AS item_key, text, coalesce(source, lang) AS source_collection, '/papers/' || doc_id AS source_path,
  '{"title":"T' || n_chars || '","authors":[' || coalesce('"' || source || '"', 'null') || '],"year":2020,"DOI":null}' AS metadata_json, min(doc_id) OVER (PARTITION BY text) AS paper_id FROM documents),
h AS (SELECT DISTINCT 'A' || doc_id AS attachment_key FROM labels),
s AS (SELECT 'zotero' AS source_type, attachment_key, CASE WHEN h.attachment_key IS NULL THEN item_key ELSE 'old' END AS item_key, paper_id, source_collection, source_path, 7::BIGINT AS source_modified_at, metadata_json,
  CASE WHEN h.attachment_key IS NULL THEN '2024-06-01' ELSE '2020-01-01' END AS imported_at FROM d LEFT JOIN h USING (attachment_key) WHERE text IS NOT NULL
  UNION ALL SELECT 'zotero', attachment_key, 'old', -1, 'before', '/old', 1, '{}', '2020-01-01' FROM h WHERE attachment_key NOT IN (SELECT attachment_key FROM d WHERE text IS NOT NULL)) """


@query("import_sources", IMPORTED + "SELECT * FROM s")
def import_sources(spark, sf_dir):
    return files.import_sources(*_import_inputs(spark, sf_dir), F.lit("2024-06-01"))


@query("import_collections", IMPORTED + "SELECT DISTINCT source_collection AS collection, paper_id FROM s WHERE source_collection <> ''")
def import_collections(spark, sf_dir):
    return files.collection_members(files.import_sources(*_import_inputs(spark, sf_dir), F.lit("2024-06-01")))


@query("import_manifest", """SELECT 1 AS schemaVersion, '/export' AS source, '2024-06-01' AS importedAt, row_number() OVER (ORDER BY 'A' || doc_id) AS place, 'A' || doc_id AS attachmentKey, 'I' || doc_id AS itemKey, sha256(text) AS sha256, 'T' || n_chars AS title, lang AS category,
  ceil(n_chars / 1000.0)::BIGINT AS pageCount, '/papers/' || doc_id AS targetPath FROM documents""")
def import_manifest(spark, sf_dir):
    return files.import_manifest(_import_inputs(spark, sf_dir)[0], "/export", F.lit("2024-06-01"))


@query("missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_key_rows(spark, sf_dir):
    return missing_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# ----------------------------------------------------------------------------- sampling

CAND = "SELECT doc_id AS item, sha256(text) AS sha256, CASE lang WHEN 'en' THEN 'finft' WHEN 'de' THEN 'multimodal' WHEN 'fr' THEN 'icassp' ELSE 'unfiled' END AS category, CASE WHEN n_chars <= 800 THEN 0 WHEN n_chars <= 1500 THEN 1 ELSE 2 END AS bucket FROM documents"


@query("stratified_sample", f"""WITH c AS ({CAND}), q AS (SELECT 'finft' AS category, 13 AS quota UNION ALL SELECT 'multimodal', 17),
t AS (SELECT c.*, row_number() OVER (PARTITION BY category, bucket ORDER BY sha256, item) AS turn FROM c),
p AS (SELECT t.*, row_number() OVER (PARTITION BY t.category ORDER BY turn, bucket) AS place, quota FROM t JOIN q USING (category)),
s AS (SELECT item FROM p WHERE place <= quota), r AS (SELECT item, row_number() OVER (ORDER BY bucket, sha256, item) AS n FROM c WHERE item NOT IN (SELECT item FROM s))
SELECT item, category, bucket, item IN (SELECT item FROM s) OR item IN (SELECT item FROM r WHERE n <= 30 - (SELECT count(*) FROM s)) AS selected FROM c""")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cat = F.when(F.col("lang") == "en", "finft").when(F.col("lang") == "de", "multimodal").when(F.col("lang") == "fr", "icassp").otherwise("unfiled")
    c = d.select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("sha256"), cat.alias("category"), metrics.page_bucket(F.ceil(F.col("n_chars") / 100)).alias("bucket"))
    return metrics.stratified_sample(c).select("item", "category", "bucket", "selected")


# ------------------------------------------------------------------------ export tables


@query("attachments", """SELECT l_partkey AS attachmentID, l_orderkey AS parentItemID, 'K' || o_custkey AS itemKey, 'A' || l_partkey AS attachmentKey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag <> 'N' AND p_size > 10""")
def attachments(spark, sf_dir):
    """Lines as attachments of orders; parts are the attached items, small ones deleted."""
    li, o, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    rows = li.select(F.col("l_partkey").alias("itemID"), F.col("l_orderkey").alias("parentItemID"), F.when(F.col("l_returnflag") == "N", "text/html").otherwise("Application/PDF").alias("contentType"))
    own = part.select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("key"))
    parents = o.select((F.col("o_orderkey")).alias("itemID"), F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"))
    # Items share one id space: parents take the negative numbers.
    items = own.unionByName(parents.select((-F.col("itemID") - 1).alias("itemID"), "key"))
    deleted = part.where("p_size <= 10").select(F.col("p_partkey").alias("itemID"))
    kept = metrics.attachments(rows.withColumn("parentItemID", -F.col("parentItemID") - 1), items, deleted)
    return kept.select("attachmentID", (-F.col("parentItemID") - 1).alias("parentItemID"), "itemKey", "attachmentKey")


@query("field_pivot", "SELECT o_orderkey AS itemID, o_orderpriority AS title, substr(o_orderdate::VARCHAR, 1, 10) AS date, CASE WHEN o_orderstatus = 'F' THEN '10.1/' || o_orderkey END AS DOI, year(o_orderdate)::INT AS year FROM orders")
def field_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pair = lambda n, v: F.struct(F.lit(n).alias("fieldName"), v.alias("value"))
    values = o.select(F.col("o_orderkey").alias("itemID"), F.explode(F.array(
        pair("title", F.col("o_orderpriority")), pair("date", F.date_format("o_orderdate", "yyyy-MM-dd")),
        pair("DOI", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("10.1/"), F.col("o_orderkey").cast("string")))))).alias("f")).select("itemID", "f.*").where("value is not null")
    return metrics.pivot_fields(values, ["title", "date", "DOI"]).withColumn("year", metrics.year_of(F.col("date")))


@query("creators", "SELECT l_orderkey AS itemID, l_linenumber AS orderIndex, 'S' || l_suppkey || ' ' || s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def creators(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("itemID"), F.col("l_linenumber").alias("orderIndex"), F.col("l_suppkey").alias("creatorID"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("creatorID"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("firstName"), F.col("s_name").alias("lastName"))
    return metrics.creator_names(links, people)


@query("inspection", "SELECT (SELECT count(*) FROM orders) AS items, count(*) AS attachments, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS missing FROM lineitem")
def inspection(spark, sf_dir):
    path = lambda c: F.concat(F.lit("/files/"), F.col(c).cast("string")).alias("path")
    return metrics.inspection(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(path("l_partkey")), table(spark, sf_dir, "part").where("p_size > 25").select(path("p_partkey")))


@query("candidate_features", "SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 20 <= 8 THEN 0 WHEN o_orderkey % 20 <= 15 THEN 1 ELSE 2 END AS bucket, CASE o_orderkey % 4 WHEN 0 THEN 'multimodal' WHEN 1 THEN 'finft' WHEN 2 THEN 'icassp' ELSE 'unfiled' END AS category FROM orders")
def candidate_features(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.when(k % 4 == 0, F.array(F.lit("FinFT"), F.lit("多模态与会话情绪识别"))).when(k % 4 == 1, F.array(F.lit("FinFT"), F.lit("ICASSP-2026"))).when(k % 4 == 2, F.array(F.lit("ICASSP-2026"))).otherwise(F.array(F.lit("Other")))
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.year_of(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"), metrics.page_bucket(k % 20).alias("bucket"), metrics.category(names).alias("category"))


@query("regression_report", """SELECT o_orderstatus AS status, count(*) AS papers, sum(pages)::BIGINT AS pages, sum(tables_)::BIGINT AS tables, sum(tokens)::BIGINT AS tokens FROM (SELECT o_orderkey, o_orderstatus FROM orders) o JOIN (SELECT l_orderkey, count(*) AS pages, count(*) FILTER (WHERE l_returnflag = 'R') AS tables_, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus)""")
def regression_report(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    docs = li.groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.count(F.lit(1)).alias("page_count"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("tables"), F.sum("l_quantity").cast("long").alias("tokens"))
    for name in ("figures", "failed_pages"):
        docs = docs.withColumn(name, F.array().cast("array<int>"))
    for name in ("ocr_calls", "cache_hits", "duration_ms"):
        docs = docs.withColumn(name, F.lit(0))
    p = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    _, total = metrics.regression_report(p, li.select(F.col("l_orderkey").alias("paper_id")), docs)
    return total.select("status", "papers", "pages", "tables", "tokens")


@query("usage_rollup", "SELECT l_returnflag AS model, l_linestatus AS stage, sum(l_quantity)::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens, sum(l_suppkey)::BIGINT AS duration_ms, count(*) AS calls, grouping(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("stage"), F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"), F.col("l_suppkey").alias("duration_ms"))
    return metrics.usage_rollup(rows, ["model", "stage"])


# ------------------------------------------------------------------------------ context


@query("scoped_items", """WITH i AS (SELECT l_orderkey AS scope_id, l_partkey AS pid, count(*) AS n, min(l_linenumber) AS so FROM lineitem GROUP BY 1, 2)
SELECT scope_id, pid AS context_item_id, CASE WHEN pid % 3 = 0 AND pid % 2 = 0 THEN 7::BIGINT WHEN n > 1 THEN greatest(1, ceil(strlen('custom ' || scope_id) / 4.0))::BIGINT ELSE greatest(1, ceil(strlen(p_name || ' ' || p_brand) / 4.0))::BIGINT END AS tokens,
  CASE WHEN pid % 3 = 0 AND pid % 2 = 0 THEN 'short' WHEN n > 1 THEN 'custom ' || scope_id ELSE p_name || ' ' || p_brand END AS text FROM i JOIN part ON pid = p_partkey""")
def scoped_items(spark, sf_dir):
    return _scoped(spark, sf_dir).select("scope_id", "context_item_id", "tokens", "text")


def _scoped(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = li.groupBy(F.col("l_orderkey").alias("scope_id"), F.col("l_partkey").alias("context_item_id")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("sort_order"))
    scope_items = g.select("scope_id", "context_item_id", "sort_order", F.when(F.col("n") > 1, "custom").otherwise("section").alias("item_type"), F.concat(F.lit("custom "), F.col("scope_id").cast("string")).alias("custom_text"))
    k = F.col("p_partkey")
    items = part.select(k.alias("id"), k.alias("paper_id"), F.lit("").alias("section_id"), F.when(k % 2 == 0, "compressed").otherwise("raw").alias("mode"), F.concat_ws(" ", "p_name", "p_brand").alias("source_text"), F.sha2("p_name", 256).alias("source_hash"), F.when(k % 3 == 0, k).alias("active_compression_id"))
    compressions = part.select(k.alias("id"), F.lit(7).alias("estimated_tokens"), F.lit("short").alias("compressed_text"))
    return context.scoped_items(scope_items, items, part.select(k.alias("id"), F.col("p_name").alias("title")), compressions)


@query("snapshot_drift", "SELECT p_partkey AS context_item_id FROM part WHERE p_partkey % 6 = 0")
def snapshot_drift(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("source_hash"))
    expected = part.select(F.col("p_partkey").alias("context_item_id"), F.when(F.col("p_partkey") % 6 == 0, F.lit("old")).otherwise(F.sha2("p_name", 256)).alias("source_hash"))
    return context.drifted(items, expected).select("context_item_id")


@query("format_violations", """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey AS paper_id, l_partkey::VARCHAR AS section_id, CASE l_partkey % 5 WHEN 0 THEN 'missing_section' WHEN 1 THEN 'blank_section' ELSE 'lost_anchor' END AS violation FROM s WHERE l_partkey % 5 <= 2
UNION ALL SELECT l_orderkey, l_partkey::VARCHAR, 'lost_anchor' FROM s WHERE l_partkey % 5 = 1
UNION ALL SELECT DISTINCT l_orderkey, NULL, 'stale_source' FROM s WHERE l_orderkey % 11 = 0 AND l_partkey % 5 <> 0""")
def format_violations(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").cast("string").alias("section_id"), (F.col("l_partkey") % 5).alias("m")).distinct()
    formatted = s.where("m <> 0").select("paper_id", "section_id", F.when(F.col("m") == 1, F.lit(" ")).when(F.col("m") == 2, F.lit("text")).otherwise(F.concat(F.lit("text b"), "section_id")).alias("markdown"), F.lit("h").alias("source_hash"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderkey") % 11 == 0, "new").otherwise("h").alias("source_hash"))
    anchors = s.select("paper_id", "section_id", F.concat(F.lit("b"), "section_id").alias("block_id"))
    return context.format_violations(s, formatted, docs, anchors)


@query("current_compression", "SELECT l_partkey AS context_item_id, l_returnflag AS model_id, max(l_orderkey) AS revision FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2")
def current_compression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_partkey").alias("context_item_id"), F.col("l_linestatus").alias("source_hash"), F.col("l_returnflag").alias("model_id"), F.lit("v1").alias("prompt_version"), F.col("l_orderkey").alias("revision"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("O").alias("source_hash"))
    return context.current_compression(items, c).select("context_item_id", "model_id", "revision")


@query("templates", "SELECT p_partkey AS id, p_type AS category, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice DESC, p_partkey) AS place FROM part WHERE p_type = 'SMALL' AND contains(lower(p_name || p_brand), 'ring')")
def templates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_size").alias("sort_order"), F.col("p_retailprice").alias("updated_at"), F.col("p_name").alias("name"), F.col("p_brand").alias("content"))
    return retrieval.templates(rows, "SMALL", "Ring").select("id", "category", "place")


@query("safe_names", r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'untitled' ELSE left(regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]+', '-', 'g'), ' .'), '\s+', ' ', 'g'), 120) END AS segment, '/docs/a/' || page_id || '.png' AS asset FROM pages""")
def safe_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 5 == 0, F.lit(" .. ")).otherwise(F.col("url"))
    return p.select("page_id", T.safe_segment(name, "untitled").alias("segment"), T.asset_path(F.lit("/docs/a/paper.md"), F.concat(F.col("page_id").cast("string"), F.lit(".png"))).alias("asset"))


# -------------------------------------------------------------------------------- tools


def _tool_library(spark, sf_dir):
    """Documents as papers of one section; their labels as figures, the lines of their order as references."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Document "), key)
    figures = table(spark, sf_dir, "labels").select(key.alias("paper_id"), F.concat(F.lit("fig-"), key).alias("figure_id"), F.lit(1).alias("page"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("caption"))
    order = F.col("l_orderkey").cast("string")
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    refs = refs.select(order.alias("paper_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("ref-"), F.col("p").cast("string")).alias("ref_id"), F.concat(F.lit("Part "), F.col("p").cast("string")).alias("title"))
    return tools.Library(
        papers=d.select(key.alias("id"), title.alias("title"), F.lit("READY").alias("status"), F.lit(1).alias("page_count"), F.col("doc_id").alias("updated_at")),
        documents=d.select(key.alias("paper_id"), F.col("text").alias("markdown")),
        sections=d.select(key.alias("paper_id"), F.lit("body").alias("section_id"), title.alias("title"), F.col("doc_id").alias("ord"), F.lit(1).alias("page"), F.col("text").alias("markdown")),
        figures=figures, references=refs)


TOOL_CALLS = """c AS (SELECT doc_id AS i, doc_id % 10 AS k, doc_id // 10 AS t, doc_id::VARCHAR AS id, split_part(replace(text, chr(10), ' '), ' ', 4) AS w FROM documents),
calls AS (SELECT *, CASE k WHEN 0 THEN '{"query": "CUMENT ' || t || '", "limit": ' || (1 + t % 25) || '}' WHEN 1 THEN '{"paperId": "' || id || '", "maxCharacters": ' || (1000 + t % 3 * 60000) || '}'
  WHEN 2 THEN '{"paperId": "' || id || '"' || CASE WHEN t % 4 = 0 THEN '' ELSE ', "sectionId": "DOCUMENT ' || (i - t % 2) || '"' END || '}' WHEN 3 THEN '{"paperId": "' || id || '", "figureId": "fig-' || id || CASE WHEN t % 3 = 0 THEN '", "size": 2}' ELSE '"}' END
  WHEN 4 THEN '{"query": " ' || regexp_replace(w, '[^A-Za-z]', '', 'g') || ' zq", "limit": 3}' WHEN 5 THEN '{"paperId": "' || id || '", "limit": 2}' WHEN 6 THEN 'no json' WHEN 8 THEN '{"query": "x", "limit": "5"}' WHEN 9 THEN '{"paperId": "x' || id || '"}' ELSE '{}' END AS arguments,
  CASE k WHEN 0 THEN 'search_library' WHEN 2 THEN 'read_section' WHEN 3 THEN 'read_figure' WHEN 4 THEN 'find_evidence' WHEN 5 THEN 'get_references' WHEN 7 THEN 'write_paper' WHEN 8 THEN 'search_library' ELSE 'read_paper' END AS tool FROM c)"""


def _tool_calls(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i, k, t, id_ = F.col("doc_id"), F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10).cast("long"), F.col("doc_id").cast("string")
    word = F.regexp_replace(F.split_part(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(4)), "[^A-Za-z]", "")
    s = lambda c: c.cast("string")
    arguments = (
        F.when(k == 0, F.concat(F.lit('{"query": "CUMENT '), s(t), F.lit('", "limit": '), s(1 + t % 25), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"paperId": "'), id_, F.lit('", "maxCharacters": '), s(1000 + t % 3 * 60000), F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"paperId": "'), id_, F.lit('"'), F.when(t % 4 == 0, "").otherwise(F.concat(F.lit(', "sectionId": "DOCUMENT '), s(i - t % 2), F.lit('"'))), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"paperId": "'), id_, F.lit('", "figureId": "fig-'), id_, F.when(t % 3 == 0, '", "size": 2}').otherwise('"}')))
        .when(k == 4, F.concat(F.lit('{"query": " '), word, F.lit(' zq", "limit": 3}'))).when(k == 5, F.concat(F.lit('{"paperId": "'), id_, F.lit('", "limit": 2}')))
        .when(k == 6, "no json").when(k == 8, '{"query": "x", "limit": "5"}').when(k == 9, F.concat(F.lit('{"paperId": "x'), id_, F.lit('"}'))).otherwise("{}"))
    tool = F.element_at(F.array(*map(F.lit, ["search_library", "read_paper", "read_section", "read_figure", "find_evidence", "get_references", "read_paper", "write_paper", "search_library", "read_paper"])), (k + 1).cast("int"))
    return d.select(i.alias("call_id"), tool.alias("tool_name"), arguments.alias("arguments"))


@query("tool_answers", f"""WITH {TOOL_CALLS},
e AS (SELECT *, CASE WHEN k = 0 AND 1 + t % 25 > 20 THEN 'limit must be between 1 and 20' WHEN k = 1 AND t % 3 = 2 THEN 'maxCharacters must be between 1000 and 100000' WHEN k = 2 AND t % 4 = 0 THEN 'sectionId is required'
    WHEN k = 3 AND t % 3 = 0 THEN 'unknown argument size' WHEN k = 6 THEN 'arguments must be an object' WHEN k = 7 THEN 'unknown tool' WHEN k = 8 THEN 'limit must be an integer' WHEN k = 9 THEN 'unknown paper x' || id
    WHEN k = 2 AND t % 2 = 1 THEN 'unknown section DOCUMENT ' || (i - 1) WHEN k = 3 AND i NOT IN (SELECT doc_id FROM labels) THEN 'unknown figure fig-' || id END AS error FROM calls),
f AS (SELECT e.i, row_number() OVER (PARTITION BY e.i ORDER BY d.doc_id DESC, d.doc_id::VARCHAR) AS place, d.doc_id::VARCHAR AS paper_id, 1 + t % 25 AS n FROM e JOIN documents d ON contains('document ' || d.doc_id, 'cument ' || t) WHERE k = 0 AND error IS NULL),
v AS (SELECT e.i, row_number() OVER (PARTITION BY e.i ORDER BY d.doc_id) AS place, d.doc_id::VARCHAR AS paper_id FROM (SELECT *, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS term FROM e WHERE k = 4) e JOIN documents d ON (length(term) > 1 AND contains(lower(d.text), term)) OR contains(lower(d.text), 'zq')),
l AS (SELECT l_orderkey AS o, l_linenumber AS pos, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pos) AS n FROM l)
SELECT i AS call_id, tool AS tool_name, error, 1 AS place, NULL AS paper_id, NULL AS part, NULL::BIGINT AS n_chars FROM e WHERE error IS NOT NULL
UNION ALL SELECT i, 'search_library', NULL, place, paper_id, NULL, NULL FROM f WHERE place <= n
UNION ALL SELECT i, tool, NULL, 1, id, NULL, least(length(text), 1000 + t % 3 * 60000) FROM e JOIN documents d ON d.doc_id = i WHERE k = 1 AND error IS NULL
UNION ALL SELECT i, tool, NULL, 1, id, 'body', least(length(text), 80000) FROM e JOIN documents d ON d.doc_id = i WHERE k = 2 AND error IS NULL
UNION ALL SELECT i, tool, NULL, 1, id, 'fig-' || id, NULL FROM e WHERE k = 3 AND error IS NULL
UNION ALL SELECT i, 'find_evidence', NULL, place, paper_id, 'body', NULL FROM v WHERE place <= 3
UNION ALL SELECT i, tool, NULL, n, id, 'ref-' || p, NULL FROM e JOIN r ON o = i WHERE k = 5 AND n <= 2""")
def tool_answers(spark, sf_dir):
    """Every document asks a tool, three tenths of them wrongly; refusals and answers in one table."""
    rows = tools.run_calls(_tool_calls(spark, sf_dir), _tool_library(spark, sf_dir))
    chars = F.when(F.col("tool_name").isin("read_paper", "read_section"), F.length("body").cast("long"))
    return rows.select("call_id", "tool_name", "error", F.col("place").cast("long").alias("place"), "paper_id", "part", chars.alias("n_chars"))


@query("tool_functions", r"""SELECT 'search_library' AS tool, NULL AS error, doc_id::VARCHAR AS part, count(*) OVER () AS n FROM (SELECT doc_id FROM documents WHERE contains('document ' || doc_id, 'ment 1') ORDER BY doc_id DESC LIMIT 5)
UNION ALL SELECT 'read_paper', NULL, '7', least(length(text), 1000) FROM documents WHERE doc_id = 7
UNION ALL SELECT 'read_section', NULL, 'body', length(text) FROM documents WHERE doc_id = 8
UNION ALL SELECT 'read_figure', NULL, 'fig-' || doc_id, 1 FROM (SELECT doc_id FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels))
UNION ALL SELECT 'find_evidence', NULL, doc_id::VARCHAR, position FROM (SELECT doc_id, least(CASE WHEN contains(lower(text), 'water') THEN instr(lower(text), 'water') ELSE 1000000000 END, CASE WHEN contains(lower(text), 'the') THEN instr(lower(text), 'the') ELSE 1000000000 END) - 1 AS position FROM documents WHERE contains(lower(text), 'water') OR contains(lower(text), 'the') ORDER BY doc_id LIMIT 10)
UNION ALL SELECT 'get_references', NULL, 'ref-' || max(l_partkey), row_number() OVER (ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = 1 GROUP BY l_linenumber
UNION ALL SELECT 'read_paper', 'unknown paper none', NULL, NULL UNION ALL SELECT 'find_evidence', 'query is required', NULL, NULL UNION ALL SELECT 'get_references', 'limit must be between 1 and 200', NULL, NULL""")
def tool_functions(spark, sf_dir):
    """The six functions as a user calls them from SQL, with three refused calls."""
    library = _tool_library(spark, sf_dir)
    tools.register_tools(spark, library)
    first = library.figures.agg(F.min(F.col("paper_id").cast("long")).cast("string").alias("p")).first()["p"]
    return spark.sql("""
      SELECT 'search_library' AS tool, error, paper_id AS part, count(*) OVER (PARTITION BY 1) AS n FROM search_library('{"query": "MENT 1", "limit": 5}')
      UNION ALL SELECT 'read_paper', error, paper_id, length(markdown) FROM read_paper('{"paperId": "7", "maxCharacters": 1000}')
      UNION ALL SELECT 'read_section', error, section_id, length(markdown) FROM read_section('{"paperId": "8", "sectionId": "document 8"}')
      UNION ALL SELECT 'read_figure', error, figure_id, page FROM read_figure(:figure)
      UNION ALL SELECT 'find_evidence', error, paper_id, position FROM find_evidence('{"query": "water the"}')
      UNION ALL SELECT 'get_references', error, ref_id, ref_no FROM get_references('{"paperId": "1"}')
      UNION ALL SELECT 'read_paper', error, paper_id, length(markdown) FROM read_paper('{"paperId": "none"}')
      UNION ALL SELECT 'find_evidence', error, paper_id, position FROM find_evidence('{"query": " "}')
      UNION ALL SELECT 'get_references', error, ref_id, ref_no FROM get_references('{"paperId": "1", "limit": 0}')""", args={"figure": f'{{"paperId": "{first}"}}'})
