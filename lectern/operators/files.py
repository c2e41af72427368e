"""File inventory and reconciliation of a listing with the known files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.skew import first_rows, number_rows, range_blocks, running


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files whose size or time differs from the known row: only these are hashed."""
    same = known.select("path", F.col("size_bytes").alias("_s"), F.col("modified_at_ns").alias("_m"))
    joined = listing.join(same, "path", "left")
    return joined.where(F.col("_s").isNull() | (F.col("_s") != F.col("size_bytes")) | (F.col("_m") != F.col("modified_at_ns"))).drop("_s", "_m")


def reconcile(listing: DataFrame, known: DataFrame) -> DataFrame:
    """What happened to each path: one row ``(path, action, file_id, paper_id, sha256)``.

    ``listing(path, size_bytes, modified_at_ns, sha256)``, ``known(id, paper_id, path, sha256,
    size_bytes, modified_at_ns, is_missing, created_at)``.  Actions: unchanged, touched (same
    bytes, new time), moved (known bytes whose file is gone), duplicate (known bytes
    elsewhere, or bytes seen earlier in this listing), new, and for known files superseded
    (other bytes at its path) and missing.

    New paths of a content take its gone files in path order.  Counting uses range partitions,
    so a content with very many copies is not ranked in one task.
    """
    k = known.select(F.col("id").alias("file_id"), "paper_id", F.col("path").alias("k_path"), F.col("sha256").alias("k_sha"), F.col("size_bytes").alias("k_size"),
                     F.col("modified_at_ns").alias("k_time"), "is_missing", "created_at")
    joined = listing.join(k, listing["path"] == k["k_path"], "full_outer")
    listed, had = F.col("path").isNotNull(), F.col("file_id").isNotNull()
    same_stat = (F.col("size_bytes") == F.col("k_size")) & (F.col("modified_at_ns") == F.col("k_time"))
    state = (
        F.when(listed & had & same_stat, "unchanged").when(listed & had & (F.col("sha256") == F.col("k_sha")), "touched")
        .when(listed & had, "replaced").when(listed, "arrived").otherwise("gone")
    )
    staged = joined.withColumn("state", state)
    stay = staged.where(F.col("state").isin("unchanged", "touched")).select("path", F.col("state").alias("action"), "file_id", "paper_id", "sha256")
    arrivals = staged.where(F.col("state").isin("arrived", "replaced")).select("path", "sha256")
    free_gone = staged.where(F.col("state") == "gone").select("file_id", "paper_id", F.col("k_path").alias("old_path"), F.col("k_sha").alias("sha256"), "created_at", F.lit("").alias("free_from"), "is_missing")
    freed = staged.where(F.col("state") == "replaced").select("file_id", "paper_id", F.col("k_path").alias("old_path"), F.col("k_sha").alias("sha256"), "created_at", F.col("k_path").alias("free_from"), "is_missing")
    movable = free_gone.unionByName(freed)

    matched = _match_moves(arrivals, movable)
    moves = matched.select("path", F.lit("moved").alias("action"), "file_id", "paper_id", "sha256")
    rest = arrivals.join(moves.select("path"), "path", "left_anti")
    owners = known.groupBy("sha256").agg(F.min_by("paper_id", F.struct("created_at", "id")).alias("paper_id"))
    owned = rest.join(owners, "sha256", "left")
    duplicate = owned.where("paper_id is not null").select("path", F.lit("duplicate").alias("action"), F.lit(None).cast(known.schema["id"].dataType).alias("file_id"), "paper_id", "sha256")
    unseen = owned.where("paper_id is null").select("path", "sha256")
    leaders = unseen.groupBy("sha256").agg(F.min("path").alias("_lead"))
    fresh = unseen.join(leaders, "sha256").select(
        "path", F.when(F.col("path") == F.col("_lead"), "new").otherwise("duplicate").alias("action"),
        F.lit(None).cast(known.schema["id"].dataType).alias("file_id"), F.lit(None).cast(known.schema["paper_id"].dataType).alias("paper_id"), "sha256")
    moved_files = matched.select("file_id")
    lost = movable.join(moved_files, "file_id", "left_anti").select(
        F.col("old_path").alias("path"), F.when(F.col("free_from") != "", "superseded").when(F.col("is_missing"), "still_missing").otherwise("missing").alias("action"), "file_id", "paper_id", "sha256")
    return stay.unionByName(moves).unionByName(duplicate).unionByName(fresh).unionByName(lost)


def _match_moves(arrivals: DataFrame, movable: DataFrame) -> DataFrame:
    """Pair new paths with gone files of the same bytes, in path order.

    A gone file is free from the start, a superseded one from its own path on.  Walking the
    paths, an arrival finds a free file unless arrivals outnumber free files more than ever
    before; so it is matched exactly when the running maximum of that excess does not grow.
    Matched arrivals take files in the order they became free, then by creation.
    """
    shared = arrivals.select("sha256").distinct().join(movable.select("sha256").distinct(), "sha256")
    a = arrivals.join(shared, "sha256", "left_semi").select("sha256", F.col("path").alias("at"), F.lit(1).alias("arrives"), "path")
    m = movable.join(shared, "sha256", "left_semi").select("sha256", F.col("free_from").alias("at"), F.lit(0).alias("arrives"), "created_at", "file_id", "paper_id")
    walk = range_blocks(a.unionByName(m, allowMissingColumns=True), ["sha256"], ["at", "arrives", "created_at", "file_id"])
    order, block = ["at", "arrives", "created_at", "file_id"], ["_range"]
    counted = running(walk, ["sha256"], order, block, {"_in": ("sum", F.col("arrives")), "_free": ("sum", 1 - F.col("arrives"))})
    excess = F.when(F.col("arrives") == 1, F.greatest(F.col("_in") - F.col("_free"), F.lit(0)))
    peaked = running(counted, ["sha256"], order, block, {"_peak": ("max", excess)})
    peaked = peaked.withColumn("_peak", F.coalesce("_peak", F.lit(0)))
    # An arrival that raises the peak is unmatched; the k-th matched one takes the k-th file.
    taking = peaked.where("arrives = 1").withColumn("_rank", F.col("_in") - F.col("_peak"))
    lead = taking.groupBy("sha256", "_rank").agg(F.min("path").alias("path")).where("_rank > 0")
    files = peaked.where("arrives = 0").select("sha256", F.col("_free").alias("_rank"), "file_id", "paper_id")
    return lead.join(files, ["sha256", "_rank"]).select("path", "sha256", "file_id", "paper_id")


def paper_states(papers: DataFrame, known: DataFrame, changes: DataFrame) -> DataFrame:
    """Paper status after a reconciliation: MISSING without a present file, back to READY on
    reattachment."""
    present = changes.where(F.col("action").isin("unchanged", "touched", "moved", "duplicate") & F.col("paper_id").isNotNull()).select("paper_id").distinct().withColumn("_present", F.lit(True))
    lost = changes.where(F.col("action").isin("missing", "superseded")).select("paper_id").distinct().withColumn("_lost", F.lit(True))
    joined = papers.join(present, papers["id"] == present["paper_id"], "left").drop("paper_id")
    joined = joined.join(lost, joined["id"] == lost["paper_id"], "left").drop("paper_id")
    back = changes.where(F.col("action").isin("moved", "duplicate")).select(F.col("paper_id").alias("_b")).distinct()
    joined = joined.join(back, joined["id"] == F.col("_b"), "left")
    status = F.when(F.col("_present").isNull() & F.col("_lost"), "MISSING").when(F.col("_b").isNotNull() & (F.col("status") == "MISSING"), "READY").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_present", "_lost", "_b")


def link_imports(candidates: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported items matched to papers by content, and those without one."""
    owner = papers.select("sha256", F.col("id").alias("paper_id"))
    linked = candidates.join(owner, "sha256")
    first = first_rows(linked, ["attachment_key"], [F.col("paper_id")])
    return first, candidates.join(owner, "sha256", "left_anti")


SOURCE_ROW = ["source_type", "attachment_key", "item_key", "paper_id", "source_collection", "source_path", "source_modified_at", "metadata_json", "imported_at"]


def import_sources(candidates: DataFrame, collections: DataFrame, papers: DataFrame, known: DataFrame, now: Column, source_type: str = "zotero") -> DataFrame:
    """The table of source rows after an import: one row per (source type, attachment).

    ``candidates(attachment_key, item_key, sha256, title, authors, year, doi, target_path, modified_at)`` are linked to
    papers by content; those without a paper leave no row.  A row that is ``known`` keeps its item key and the time of
    its first import and takes the rest from the candidate; other known rows stay.
    ``collections(attachment_key, collection_order, collection)`` of a candidate: the first counts.
    """
    linked, _ = link_imports(candidates, papers)
    lead = first_rows(collections, ["attachment_key"], [F.col("collection_order"), F.col("collection")]).select("attachment_key", F.col("collection").alias("source_collection"))
    told = F.to_json(F.struct("title", "authors", "year", F.col("doi").alias("DOI")), {"ignoreNullFields": "false"})
    fresh = linked.join(lead, "attachment_key", "left").select(
        F.lit(source_type).alias("source_type"), "attachment_key", F.col("item_key").alias("_item"), "paper_id", "source_collection", F.col("target_path").alias("source_path"), F.col("modified_at").alias("source_modified_at"), told.alias("metadata_json"))
    key = ["source_type", "attachment_key"]
    before = known.select(*key, F.col("item_key").alias("_held_item"), F.col("imported_at").alias("_held_at"))
    merged = fresh.join(before, key, "left").withColumns({
        "item_key": F.when(F.col("_held_at").isNotNull(), F.col("_held_item")).otherwise(F.col("_item")), "imported_at": F.coalesce("_held_at", now)})
    return merged.select(*SOURCE_ROW).unionByName(known.join(fresh.select(*key), key, "left_anti").select(*SOURCE_ROW))


def collection_members(sources: DataFrame) -> DataFrame:
    """``collection, paper_id``: each imported paper once in the first collection of each of its sources."""
    return sources.where("source_collection <> ''").select(F.col("source_collection").alias("collection"), "paper_id").distinct()


def import_manifest(copied: DataFrame, source: str, now: Column) -> DataFrame:
    """What an import copied, in order of the attachments: one row per paper with the head of the manifest on it.

    A manifest of any length stays a table (``sinks.write_report`` writes it as JSON lines); ``place`` is its order.
    """
    head = [F.lit(1).alias("schemaVersion"), F.lit(source).alias("source"), now.alias("importedAt")]
    rows = number_rows(copied, [], ["attachment_key"], "place")
    return rows.select(*head, "place", F.col("attachment_key").alias("attachmentKey"), F.col("item_key").alias("itemKey"), "sha256", "title", "category", F.col("page_count").alias("pageCount"), F.col("target_path").alias("targetPath"))
