"""Readers and sinks over files that Spark writes from the driver tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import context, enrichment
from lectern.queries import query
from lectern.queries.tables import table
from lectern.session import scratch_path
from lectern.sources import documents, sinks
from lectern.streaming import events as E


@query("stored_documents", r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ord, len(list_filter(parts, lambda x: regexp_matches(x, '[0-9]'))) AS figures FROM d)
SELECT doc_id::VARCHAR AS paper_id, 's' || ord AS section_id, ord::INT AS ord, length(part)::BIGINT AS n_chars, (ord + 1)::INT AS page, sha256(part) AS digest, figures::BIGINT AS figures FROM p""")
def stored_documents(spark, sf_dir):
    """Each document as a structured one with a section per line, a block in each, and a figure for each line with a digit; written as JSON lines and read."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    parts, key = F.split("text", "\n"), F.col("doc_id").cast("string")

    def section(part, i):
        anchor = F.struct(key.alias("paper_id"), F.concat(F.lit("s"), i).alias("section_id"), F.concat(F.lit("b"), i).alias("block_id"), (i + 1).alias("page"), part.alias("source_text"))
        return F.struct(F.concat(F.lit("s"), i).alias("id"), F.lit("Line").alias("title"), F.lit(1).alias("level"), i.alias("order"), (i + 1).alias("page_start"), (i + 1).alias("page_end"), part.alias("markdown"), F.array(anchor).alias("anchors"))

    figures = F.transform(F.filter(parts, lambda p: p.rlike("[0-9]")), lambda p, i: F.struct(F.concat(F.lit("f"), i).alias("id"), p.alias("caption"), (i + 1).alias("page")))
    path = scratch_path(spark)
    sinks.write_report(d.select(key.alias("id"), F.lit("Document").alias("title"), F.size(parts).alias("page_count"), F.transform(parts, section).alias("sections"), figures.alias("figures")), path)
    read = documents.read_documents(spark, path, lines=True)
    shown = documents.figures_of(read).groupBy("paper_id").agg(F.count(F.lit(1)).alias("figures"))
    anchors = documents.anchors_of(read).select("paper_id", "section_id", "page", F.sha2("source_text", 256).alias("digest"))
    sections = documents.sections_of(read).select("paper_id", "section_id", "ord", F.length("markdown").cast("long").alias("n_chars"))
    return sections.join(anchors, ["paper_id", "section_id"]).join(shown, "paper_id", "left").withColumn("figures", F.coalesce("figures", F.lit(0).cast("long")))


@query("export_items", """WITH c AS (SELECT l_orderkey, to_json(list('S' || l_suppkey || ' ' || s_name ORDER BY l_linenumber, 'S' || l_suppkey || ' ' || s_name))::VARCHAR AS authors FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['FinFT', n_name] WHEN o_orderkey % 3 = 1 THEN [n_name] ELSE [] END AS names FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 2 * o_orderkey + 1 AS "attachmentID", 'A' || o_orderkey AS "attachmentKey", 'K' || o_orderkey AS "itemKey", CASE o_orderkey % 3 WHEN 0 THEN '/export/storage/A' || o_orderkey || '/a b.pdf' WHEN 1 THEN '/elsewhere/' || o_orderkey || '.pdf' END AS path,
o_orderpriority AS title, o_orderdate::DATE::VARCHAR AS date, CASE WHEN o_orderstatus = 'F' THEN '10.1/' || o_orderkey END AS "DOI", year(o_orderdate)::INT AS year, coalesce(authors, '[]') AS authors, coalesce(to_json(names)::VARCHAR, '[]') AS collections,
CASE WHEN o_orderkey % 3 = 0 THEN 'finft' ELSE 'unfiled' END AS category
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey LEFT JOIN g USING (o_orderkey) WHERE o_orderstatus <> 'P'""")
def export_items(spark, sf_dir):
    """Orders as the items of an export: suppliers are their creators, nations their collections; the ten tables are written and read."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    text = lambda prefix, c=key: F.concat(F.lit(prefix), c.cast("string"))
    pair = lambda n, v: F.struct(F.lit(n).cast("long").alias("fieldID"), (key * 4 + n).alias("valueID"), v.alias("value"))
    data = o.select((key * 2).alias("itemID"), F.explode(F.array(pair(0, F.col("o_orderpriority")), pair(1, F.date_format("o_orderdate", "yyyy-MM-dd")), pair(2, F.when(F.col("o_orderstatus") == "F", text("10.1/"))))).alias("f")).select("itemID", "f.*").where("value is not null")
    nations = table(spark, sf_dir, "nation")
    filed = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(key % 3 != 2)
    member = F.when(key % 3 == 0, F.array(F.lit(0).cast("long"), F.col("c_nationkey").cast("long") + 1)).otherwise(F.array(F.col("c_nationkey").cast("long") + 1))
    path = F.when(key % 3 == 0, F.lit("storage:a b.pdf")).when(key % 3 == 1, F.concat(F.lit("/elsewhere/"), key.cast("string"), F.lit(".pdf"))).otherwise(F.lit("attachments:linked.pdf"))
    no = F.lit(None).cast("long")
    written = {
        "items": o.select((key * 2).alias("itemID"), text("K").alias("key")).unionByName(o.select((key * 2 + 1).alias("itemID"), text("A").alias("key"))),
        "itemAttachments": o.select((key * 2 + 1).alias("itemID"), (key * 2).alias("parentItemID"), path.alias("path"), F.lit("Application/PDF").alias("contentType"), no.alias("storageModTime")),
        "deletedItems": o.where("o_orderstatus = 'P'").select((key * 2 + 1).alias("itemID")),
        "itemData": data.select("itemID", "fieldID", "valueID"), "itemDataValues": data.select("valueID", "value"),
        "fields": nations.where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("fieldID"), F.element_at(F.array(*map(F.lit, ["title", "date", "DOI"])), F.col("n_nationkey").cast("int") + 1).alias("fieldName")),
        "itemCreators": li.select((F.col("l_orderkey") * 2).alias("itemID"), F.col("l_suppkey").cast("long").alias("creatorID"), F.col("l_linenumber").cast("int").alias("orderIndex")).distinct(),
        "creators": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("creatorID"), text("S", F.col("s_suppkey")).alias("firstName"), F.col("s_name").alias("lastName")),
        "collections": nations.select((F.col("n_nationkey").cast("long") + 1).alias("collectionID"), F.col("n_name").alias("collectionName"), no.alias("parentCollectionID")).unionByName(
            nations.where("n_nationkey = 0").select(F.lit(0).cast("long").alias("collectionID"), F.lit("FinFT").alias("collectionName"), no.alias("parentCollectionID"))),
        "collectionItems": filed.select(F.explode(member).alias("collectionID"), (key * 2).alias("itemID"), F.lit(0).alias("orderIndex")),
    }
    root = scratch_path(spark)
    for name, rows in written.items():
        rows.write.parquet(f"{root}/{name}")
    return documents.export_items(documents.read_export(spark, root), "/export")


@query("event_feed", """SELECT '/library/' || user_id || '.pdf' AS path, arg_max(event_type, (ts, event_id::VARCHAR)) AS event_type, max(ts) AS ts, count(*) AS n_events FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def event_feed(spark, sf_dir):
    """File events landed as JSON lines, taken up by a stream, checked against the root, stored, and coalesced."""
    e = table(spark, sf_dir, "events")
    end = F.when(F.col("user_id") % 3 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))
    landed, kept = scratch_path(spark), scratch_path(spark)
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.concat(F.lit("/library/"), F.col("user_id").cast("string"), end).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit("/library").alias("root"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(landed)
    good, _ = E.valid_events(documents.file_events(spark, landed), "/library")
    good.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start(kept).awaitTermination()
    stored = spark.read.parquet(kept)
    return E.coalesce_batch(stored).select("path", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")).join(stored.groupBy("path").agg(F.count(F.lit(1)).alias("n_events")), "path")


@query("artifacts", """SELECT doc_id AS paper_id, sha256(text) AS markdown_digest, length(text)::BIGINT AS n_chars, source AS title, len(string_split(text, chr(10)))::BIGINT AS n_references FROM documents WHERE text IS NOT NULL""")
def artifacts(spark, sf_dir):
    """The four artifact tables of every document, written in buckets and joined after they are read."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumnRenamed("doc_id", "paper_id")
    root = scratch_path(spark)
    refs = d.select("paper_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    sinks.write_artifacts(d.select("paper_id", F.col("text").alias("markdown")), d.select("paper_id", F.length("text").cast("long").alias("n_chars")), d.select("paper_id", F.col("source").alias("title")), refs, root)
    read = lambda name: spark.read.parquet(f"{root}/{name}").drop("bucket")
    counted = read("references").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_references"))
    body = read("markdown").select("paper_id", F.sha2("markdown", 256).alias("markdown_digest"))
    return body.join(read("documents"), "paper_id").join(read("metadata"), "paper_id").join(counted, "paper_id")


@query("footnotes", """WITH n AS (SELECT l_orderkey AS table_id, l_linenumber AS chunk, l_partkey AS pos, l_returnflag AS note FROM lineitem)
SELECT table_id, note, min(struct_pack(chunk := chunk, pos := pos)).chunk::INT AS chunk, min(struct_pack(chunk := chunk, pos := pos)).pos::BIGINT AS pos FROM n GROUP BY 1, 2""")
def footnotes(spark, sf_dir):
    """Notes of the chunks of a table, each text once where it stands first."""
    li = table(spark, sf_dir, "lineitem")
    notes = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("chunk"), F.col("l_partkey").cast("long").alias("pos"), F.col("l_returnflag").alias("note"))
    return enrichment.merge_footnotes(notes)


@query("stage_messages", """SELECT doc_id, sha256(lang || chr(10) || chr(10) || '# Context' || chr(10) || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '# Earlier stages' || chr(10) || chr(10) || source ELSE '' END) AS digest FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source <> ''""")
def stage_messages(spark, sf_dir):
    """The request of a stage: prompt, context, and what earlier stages gave."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source <> ''")
    earlier = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(""))
    return d.select("doc_id", F.sha2(context.stage_message(F.col("lang"), F.col("text"), earlier), 256).alias("digest"))
