"""Rollups, reports, sampling, stage gates and activity summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.skew import first_rows, number_rows, running

# Sample quotas, sample size, and the collections that name a category.
QUOTAS = {"finft": 13, "multimodal": 17}
SAMPLE_SIZE = 30
CATEGORY_OF = {"多模态与会话情绪识别": "multimodal", "FinFT": "finft", "ICASSP-2026": "icassp"}


def page_bucket(pages: Column) -> Column:
    return F.when(pages <= 8, 0).when(pages <= 15, 1).otherwise(2)


def category(collections: Column) -> Column:
    rule = F.lit("unfiled")
    for name, label in reversed(CATEGORY_OF.items()):
        rule = F.when(F.array_contains(collections, name), label).otherwise(rule)
    return rule


def year_of(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def stratified_sample(candidates: DataFrame, quotas: dict[str, int] = QUOTAS, size: int = SAMPLE_SIZE) -> DataFrame:
    """Candidates with ``selected``: quotas filled in turn from the page-count buckets of each
    quota category, then up to ``size`` by bucket and digest.

    ``candidates(item, sha256, category, bucket)``.  Only rows that can be taken survive the
    map side: the first quota rows of each (category, bucket), the first ``size`` of the rest.
    """
    most = max(quotas.values())
    quota = F.create_map(*[F.lit(v) for pair in quotas.items() for v in pair])[F.col("category")]
    by_digest = [F.col("sha256"), F.col("item")]
    heads = first_rows(candidates.where(F.col("category").isin(*quotas)), ["category", "bucket"], by_digest, most, rank="_turn")
    turned = first_rows(heads, ["category"], [F.col("_turn"), F.col("bucket")], most, rank="_place")
    order = F.create_map(*[F.lit(v) for i, name in enumerate(quotas) for v in (name, i)])[F.col("category")]
    first = turned.where(F.col("_place") <= quota).select("item", F.struct(F.lit(0).alias("late"), order.alias("a"), F.col("_place").alias("b"), F.lit("").alias("sha256"), "item").alias("_o"))
    # Quota rows come first, in order of category and place; the rest by bucket and digest.  One order over
    # both, of which the first ``size`` are taken.
    left = candidates.join(first.select("item"), "item", "left_anti").select("item", F.struct(F.lit(1).alias("late"), F.col("bucket").cast("int").alias("a"), F.lit(0).alias("b"), "sha256", "item").alias("_o"))
    chosen = first.unionByName(left).orderBy("_o").limit(size).select("item", F.lit(True).alias("selected"))
    return candidates.join(chosen, "item", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def attachments(attachment_rows: DataFrame, items: DataFrame, deleted: DataFrame, keys: DataFrame | None = None, content_type: str = "application/pdf") -> DataFrame:
    """Attachments with their parent item, deleted ones and other types left out."""
    own = items.select(F.col("itemID").alias("attachmentID"), F.col("key").alias("attachmentKey"))
    parent = items.select(F.col("itemID").alias("parentItemID"), F.col("key").alias("itemKey"))
    kept = attachment_rows.where(F.lower("contentType") == content_type).withColumnRenamed("itemID", "attachmentID")
    kept = kept.join(deleted.select(F.col("itemID").alias("attachmentID")), "attachmentID", "left_anti")
    joined = kept.join(own, "attachmentID").join(parent, "parentItemID")
    return joined if keys is None else joined.join(keys.select("attachmentKey"), "attachmentKey", "left_semi")


def pivot_fields(values: DataFrame, fields: list[str]) -> DataFrame:
    """Field rows to one row per item; the wanted fields are known, so no extra pass runs."""
    return values.groupBy("itemID").pivot("fieldName", fields).agg(F.first("value"))


def creator_names(item_creators: DataFrame, creators: DataFrame) -> DataFrame:
    """Names of an item's creators in order, as ranked rows."""
    name = F.trim(F.concat_ws(" ", F.nullif("firstName", F.lit("")), F.nullif("lastName", F.lit(""))))
    return item_creators.join(creators, "creatorID").select("itemID", "orderIndex", name.alias("author"))


def inspection(items: DataFrame, attachment_rows: DataFrame, present: DataFrame) -> DataFrame:
    """Items, attachments and attachments whose file is missing, as one row."""
    there = present.select("path").distinct().withColumn("_there", F.lit(1))
    one, none = F.lit(1), F.lit(0)
    looked = attachment_rows.join(there, "path", "left").select(none.alias("i"), one.alias("a"), F.col("_there").isNull().cast("int").alias("m"))
    both = looked.unionByName(items.select(one.alias("i"), none.alias("a"), none.alias("m")))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("i", "items"), ("a", "attachments"), ("m", "missing"))])


def usage_rollup(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Tokens and time by all dimensions, with subtotals."""
    return rows.rollup(*dims).agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("duration_ms").cast("long").alias("duration_ms"), F.count(F.lit(1)).alias("calls"), F.grouping_id().cast("int").alias("level"))


def regression_report(papers: DataFrame, sources: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per imported paper and in total: pages, figures, tables, calls, cache hits, tokens."""
    joined = papers.join(sources.select("paper_id").distinct(), papers["id"] == F.col("paper_id"), "left_semi").join(
        documents, papers["id"] == documents["paper_id"], "left")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    per_paper = joined.select(
        "id", "status", F.coalesce("page_count", F.lit(0)).alias("pages"), size("figures").alias("figures"), size("tables").alias("tables"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ocr_calls", "cache_hits", "tokens", "duration_ms")], size("failed_pages").alias("failed_pages"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("pages", "figures", "tables", "ocr_calls", "cache_hits", "tokens", "duration_ms", "failed_pages")]
    total = per_paper.rollup("status").agg(F.count(F.lit(1)).alias("papers"), *sums)
    return per_paper, total


def group_activity(activities: DataFrame) -> DataFrame:
    """Requests of a group as one activity: label of the latest, phase of an active member,
    else error, else completed once all declared items are."""
    finished = F.col("phase").isin("completed", "cancelled", "error")
    position = F.struct("started_at", "request_id")
    g = activities.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("members"), F.max_by("label", position).alias("label"), F.max_by("phase", position).alias("only_phase"),
        F.min_by("phase", F.when(~finished, position)).alias("active_phase"), F.bool_or(F.col("phase") == "error").alias("failed"),
        F.count_if(finished).alias("completed_items"), F.max(F.coalesce("total_items", F.lit(0))).alias("_declared"),
        F.min("started_at").alias("started_at"), F.max(F.coalesce("completed_at", "started_at")).alias("_completed"),
        F.sum("received_characters").alias("received_characters"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    total = F.greatest("members", F.col("_declared").cast("long"))
    phase = (
        F.when(F.col("members") == 1, F.col("only_phase")).when(F.col("active_phase").isNotNull(), F.col("active_phase")).when(F.col("failed"), "error")
        .when(F.col("completed_items") < total, "sending").otherwise("completed"))
    out = g.withColumn("total_items", total).withColumn("phase", phase)
    out = out.withColumn("completed_at", F.when(F.col("active_phase").isNull(), F.col("_completed")))
    return out.drop("only_phase", "active_phase", "failed", "_declared", "_completed")


def stage_gate(stages: DataFrame) -> DataFrame:
    """Whether each stage may run, and where its run resumes: the first stage not completed.

    ``stages(run_id, position, status)``; a run has few stages.
    """
    before = stages.select("run_id", (F.col("position") + 1).alias("position"), F.col("status").alias("_before"))
    resume = stages.groupBy("run_id").agg(F.min(F.when(F.col("status") != "completed", F.col("position"))).alias("resume_at"))
    first = stages.groupBy("run_id").agg(F.min("position").alias("_first"))
    joined = stages.join(before, ["run_id", "position"], "left").join(resume, "run_id").join(first, "run_id")
    may = (F.col("position") == F.col("_first")) | (F.coalesce("_before", F.lit("")) == "completed")
    reset = F.coalesce(F.col("position") >= F.col("resume_at"), F.lit(False))
    return joined.select("run_id", "position", "status", may.alias("may_run"), "resume_at", F.when(reset, "pending").otherwise(F.col("status")).alias("status_on_retry"))


def last_region_artifact(artifacts: DataFrame) -> DataFrame:
    """The last stage artifact of a job that counts any regions."""
    return first_rows(artifacts.where("total_regions > 0"), ["job_id"], [F.col("position").desc()])


def sidebar_counts(papers: DataFrame, members: DataFrame) -> DataFrame:
    """Whole-library counts in one pass over the papers."""
    filed = members.select("paper_id").distinct().withColumn("_filed", F.lit(True))
    joined = papers.join(filed, papers["id"] == filed["paper_id"], "left")
    return joined.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("_filed").isNull()).alias("uncategorized"), F.count_if("is_favorite").alias("favorites"), F.count_if(F.col("last_read_at").isNotNull()).alias("reading"))


def papers_per_collection(members: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers of each collection with their ``place`` by title and id."""
    titled = members.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    return number_rows(titled, ["collection_id"], ["title", "paper_id"], "place")


def nested_in_order(parents: DataFrame, children: DataFrame, key: str, parent_order: str, child_order: str, limit: int) -> DataFrame:
    """Newest parents, at most ``limit``, with their children as ordered rows."""
    top = parents.orderBy(F.col(parent_order).desc(), F.col(key).desc()).limit(limit)
    return top.join(children, key, "left")


def replay_safe(calls: DataFrame, order: list[str], per_iteration: int = 8, iterations: int = 6) -> DataFrame:
    """First of each (run, call id); at most eight per iteration, iterations 1 to 6."""
    once = first_rows(calls, ["run_id", "tool_call_id"], [F.col(c) for c in order])
    usable = once.where(F.col("iteration").between(1, iterations))
    return first_rows(usable, ["run_id", "iteration"], [F.col(c) for c in order], per_iteration, rank="call_no")


def call_answers(calls: DataFrame, order: list[str], per_iteration: int = 8, iterations: int = 6) -> DataFrame:
    """Every answered call with the ``stored`` call that ``replay_safe`` keeps, its ``call_no`` and a ``replayed`` mark.

    A repeat of a (run, call id) has the stored call, whatever it asks itself; a call outside the iterations
    has no answer.  ``order`` tells the calls apart.
    """
    keys = ["run_id", "tool_call_id"]
    kept = replay_safe(calls, order, per_iteration, iterations)
    stored = kept.select(*keys, "call_no", F.struct(*calls.columns).alias("stored"))
    joined = calls.where(F.col("iteration").between(1, iterations)).join(stored, keys)
    return joined.withColumn("replayed", F.struct(*order) > F.struct(*[F.col(f"stored.{c}") for c in order]))


def changed_positions(history: DataFrame, keys: list[str], order: list[str], blocks: list[str], value: str) -> DataFrame:
    return running(history, keys, order, blocks, {"previous": ("last", F.col(value))}, inclusive=False)
