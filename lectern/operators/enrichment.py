"""Cached enrichment of many units by a callable of the user, and judging the results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions import markup as M
from lectern.functions.text import SPACE, collapse, error_kind, fold, strip
from lectern.session import checkpointed
from lectern.skew import first_rows


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def split_by_cache(units: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Units still to do and units with a stored response; the cache side carries keys only."""
    known = cache.select(key).distinct()
    return units.join(known, key, "left_anti"), units.join(known, key, "left_semi")


def pending_counts(units: DataFrame, cache: DataFrame, group: list[str], key: str = "cache_key") -> DataFrame:
    """Total, cached and uncached units per group."""
    known = cache.select(key).distinct().withColumn("_known", F.lit(1))
    counted = units.join(known, key, "left").groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count("_known").alias("cached"))
    return counted.withColumn("uncached", F.col("total") - F.col("cached"))


def estimate(papers: DataFrame, units: DataFrame, cache: DataFrame) -> DataFrame:
    """Cost of enriching a selection, per paper; without units a paper counts its pages."""
    counts = pending_counts(units, cache, ["paper_id"])
    joined = papers.select("paper_id", "page_count").join(counts, "paper_id", "left")
    return joined.select("paper_id", "page_count", F.coalesce("uncached", F.col("page_count").cast("long")).alias("uncached"), F.coalesce("cached", F.lit(0).cast("long")).alias("cached"))


def estimate_total(estimates: DataFrame) -> DataFrame:
    return estimates.agg(F.count(F.lit(1)).alias("papers"), F.sum("page_count").cast("long").alias("pages"), F.sum("uncached").cast("long").alias("uncached"), F.sum("cached").cast("long").alias("cached"))


RESULT = "response string, status string, error string, input_tokens long, output_tokens long, duration_ms long, invalid boolean"
ANSWER = f"cache_key string, {RESULT}"


def _answers(units: DataFrame, call: Callable[[dict], dict], keys: Sequence[str], per_second: float | None = None) -> DataFrame:
    """``call(unit)`` for every row, ``per_second`` at most in each task; a failed call is a row with its error."""
    columns = units.columns
    shape = StructType([*[units.schema[k] for k in keys], *StructType.fromDDL(RESULT)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic()
        for batch in batches:
            rows = []
            for unit in batch[columns].to_dict("records"):
                if per_second:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + 1 / per_second
                try:
                    answer = call(unit)
                    rows.append((*[unit[k] for k in keys], str(answer.get("response", "")), "completed", None, int(answer.get("input_tokens", 0)), int(answer.get("output_tokens", 0)), int(answer.get("duration_ms", 0)), False))
                except Exception as error:  # noqa: BLE001 - a failed unit is a row, not a crash
                    rows.append((*[unit[k] for k in keys], None, "failed", str(error), 0, 0, 0, isinstance(error, ValueError)))
            yield pd.DataFrame(rows, columns=shape.names)

    return units.mapInPandas(run, shape)


def enrich(units: DataFrame, cache: DataFrame, call: Callable[[dict], dict], concurrency: int, key: str | Sequence[str] = "cache_key") -> DataFrame:
    """Responses for all units: stored ones, and ``call(unit)`` for the others.

    ``concurrency`` tasks make the calls.  A failed call becomes a row with its error class,
    so one bad unit never fails the job; append the ``completed`` fresh rows to the cache.  For a backlog
    that takes longer than a job should, see ``enrich_backlog``.  ``key`` may be the columns that a digest is made of: units,
    cache and answers then meet by these, and the digest follows where it is shown.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # A unit that occurs twice is called once.
    once = units.join(cache.select(*keys).distinct(), keys, "left_anti").dropna(subset=keys).dropDuplicates(keys).repartition(concurrency)
    # Answers are paid for, so they are written once and read back by whatever uses the result.
    fresh = checkpointed(_answers(once, call, keys))
    fresh = fresh.select(*keys, F.struct(*[c for c in fresh.columns if c not in keys]).alias("_fresh"))
    known = first_rows(cache, keys, [F.col("response")]).select(*keys, F.col("response").alias("_stored"), F.lit(True).alias("_hit"))
    # Every unit meets the cache and the answers where it lies; each has one or the other.
    met = units.join(known, keys, "left").join(fresh, keys, "left").where("_hit or _fresh is not null")
    hit, now = F.coalesce("_hit", F.lit(False)), F.col("_fresh")
    counts = [F.coalesce(now[c], F.lit(0).cast("long")).alias(c) for c in ("input_tokens", "output_tokens", "duration_ms")]
    return met.select(
        *keys, *[c for c in units.columns if c not in keys], F.when(hit, F.col("_stored")).otherwise(now["response"]).alias("response"), F.when(hit, "completed").otherwise(now["status"]).alias("status"),
        now["error"].alias("error"), *counts, F.when(now["status"] == "failed", error_kind(now["error"], now["invalid"])).alias("error_kind"), hit.alias("cache_hit"))


def stored_answers(spark: SparkSession, store: str, key: str = "cache_key") -> DataFrame:
    """The last answer of every unit in an answer store, completed ones before failed ones."""
    shape = f"{ANSWER}, answered_at timestamp"
    try:
        rows = spark.read.schema(shape).parquet(store)
    except AnalysisException:  # no round was committed yet
        return spark.createDataFrame([], shape).withColumnRenamed("cache_key", key)
    return first_rows(rows, ["cache_key"], [F.col("status"), F.col("answered_at").desc()]).withColumnRenamed("cache_key", key)


def enrich_backlog(units: DataFrame, store: str, call: Callable[[dict], dict], concurrency: int, round_size: int = 10_000, per_second: float | None = None, key: str = "cache_key") -> DataFrame:
    """Answer a backlog of any size in rounds of about ``round_size`` units; gives the answers of ``units``.

    Units are dealt into rounds by their key.  A round's answers are appended to ``store`` before the next begins, so a
    lost executor repeats calls of one round at most, and a run that was stopped goes on with what no round has answered.
    ``concurrency`` tasks make at most ``per_second`` calls each.  Units that failed in an earlier run are tried again,
    once a run.
    """
    spark = units.sparkSession
    answered = stored_answers(spark, store, key).where("status = 'completed'").select(key)
    pending = checkpointed(units.dropDuplicates([key]).join(answered, key, "left_anti"))
    rounds = -(-pending.count() // round_size)
    for turn in range(rounds):
        now = pending.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == turn).repartition(concurrency)
        _answers(now, call, [key], per_second).withColumnRenamed(key, "cache_key").withColumn("answered_at", F.current_timestamp()).write.mode("append").parquet(store)
    return units.join(stored_answers(spark, store, key), key)


def best_pass(passes: DataFrame) -> DataFrame:
    """The pass that counts per page: the second replaces a doubtful first when it is not
    empty and at least as confident; without regions it keeps those of the first.

    ``passes(paper_id, page, pass, markdown, confidence, n_uncertain, n_issues, regions)``.
    """
    keyed = ["paper_id", "page"]
    capped = passes.withColumn("confidence", F.when(F.col("n_issues") > 0, F.least("confidence", F.lit(0.78))).otherwise(F.col("confidence")))
    raw = passes.where("pass = 2").select(*keyed, F.struct("markdown", "confidence", "n_uncertain", "n_issues", "regions").alias("b"))
    first = capped.where("pass = 1").select(*keyed, F.struct("markdown", "confidence", "n_uncertain", "n_issues", "regions").alias("a"))
    joined = first.join(raw, keyed, "left")
    doubtful = (F.col("a.confidence") < 0.85) | (F.col("a.n_uncertain") + F.col("a.n_issues") > 0)
    take = doubtful & F.col("b").isNotNull() & (F.col("b.markdown") != "") & (F.col("b.confidence") >= F.col("a.confidence"))
    second_conf = F.when(F.col("b.n_issues") > 0, F.least("b.confidence", F.lit(0.78))).otherwise(F.col("b.confidence"))
    return joined.select(
        *keyed, F.coalesce(take, F.lit(False)).alias("verified"),
        F.when(take, F.col("b.markdown")).otherwise(F.col("a.markdown")).alias("markdown"),
        F.when(take, second_conf).otherwise(F.col("a.confidence")).alias("confidence"),
        F.when(take & (F.size("b.regions") > 0), F.col("b.regions")).otherwise(F.col("a.regions")).alias("regions"),
    )


def match_issues(issues: DataFrame, regions: DataFrame, lone_issue: bool = True) -> DataFrame:
    """The region of each issue on its page: equal text, else the page's only candidate, else none.

    With ``lone_issue`` (when pages are read) the only candidate counts if it is also the page's only
    issue; without it (when a paper is looked at again) for any number of issues.
    """
    page = ["paper_id", "page"]
    texted = regions.select(*page, "region_id", F.trim("text").alias("region_text"))
    same = first_rows(issues.join(texted, page).where(F.trim("text") == F.col("region_text")), ["issue_id"], [F.col("region_id")]).select("issue_id", F.col("region_id").alias("by_text"))
    only = regions.groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("only")).where("n = 1")
    alone = issues.groupBy(*page).agg(F.count(F.lit(1)).alias("m")).where("m = 1")
    joined = issues.join(same, "issue_id", "left").join(only.select(*page, "only"), page, "left").join(alone, page, "left")
    single = F.when(F.col("m").isNotNull(), F.col("only")) if lone_issue else F.col("only")
    return joined.select("issue_id", *page, F.coalesce("by_text", single).alias("region_id"))


def page_map(pages: DataFrame, responses: DataFrame, failed: DataFrame) -> DataFrame:
    """Where the text of each page came from, with the confidence of its first response."""
    first = first_rows(responses, ["sha256", "page"], [F.col("created_at"), F.col("cache_key")]).select("sha256", "page", "confidence")
    lost = failed.select("sha256", "page", F.lit(True).alias("_failed")).distinct()
    joined = pages.join(first, ["sha256", "page"], "left").join(lost, ["sha256", "page"], "left")
    source = F.when(F.col("_failed"), "fallback").when(F.col("confidence").isNotNull(), "recognized").otherwise("text_layer")
    return joined.select("paper_id", "page", source.alias("text_source"), F.when(F.col("_failed"), F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"))


def merge_table_chunks(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tables read in several chunks, and why a table cannot be merged.

    ``cells(table_id, chunk, row_no, cells array<string>, n_cols, caption)``; all chunks need
    equal widths, and of equal rows (whitespace and case aside) the first is kept.
    """
    widths = cells.groupBy("table_id").agg(F.min("n_cols").alias("lo"), F.max("n_cols").alias("hi"),
                                           F.min_by("caption", F.when(F.col("caption") != "", F.struct("chunk", "row_no"))).alias("merged_caption"))
    key = F.transform("cells", lambda c: fold(collapse(c)))
    rows = first_rows(cells.withColumn("_k", key), ["table_id", "_k"], [F.col("chunk"), F.col("row_no")]).drop("_k")
    good = rows.join(widths.where("lo = hi"), "table_id").select("table_id", "chunk", "row_no", "cells", F.coalesce("merged_caption", F.lit("")).alias("caption"))
    return good, widths.where("lo <> hi").select("table_id", F.lit("unequal_columns").alias("problem"))


def merge_footnotes(notes: DataFrame) -> DataFrame:
    return first_rows(notes, ["table_id", "note"], [F.col("chunk"), F.col("pos")])


def merge_numbered(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered entries from several regions: ``(paper_id, page, number, text)``.

    One number with two texts is a conflict, and the numbers must leave no gap.
    """
    each = entries.groupBy("paper_id", "number").agg(F.min("text").alias("text"), F.max("text").alias("_other"), F.min("page").alias("page"))
    conflict = each.where(F.col("text") != F.col("_other")).select("paper_id", "number", F.lit("conflicting_text").alias("problem"))
    span = each.groupBy("paper_id").agg((F.max("number") - F.min("number") + 1).alias("want"), F.count(F.lit(1)).alias("got"))
    gaps = span.where("want <> got").select("paper_id", F.lit(None).cast("int").alias("number"), F.lit("not_contiguous").alias("problem"))
    problems = conflict.unionByName(gaps)
    good = each.drop("_other").join(problems.select("paper_id").distinct(), "paper_id", "left_anti")
    return good, problems


def publish_gate(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page: did every required region succeed; per paper: may it be published.

    ``regions(paper_id, page, required, status)``.
    """
    ok = F.col("status") == "completed"
    pages = regions.groupBy("paper_id", "page").agg(
        F.bool_or("required").alias("has_required"), F.bool_and(ok | ~F.col("required")).alias("page_ok"), F.count_if(~ok & ~F.col("required")).alias("optional_failures"))
    papers = pages.groupBy("paper_id").agg(
        F.bool_and("page_ok").alias("publishable"), F.count_if(F.col("has_required") & F.col("page_ok")).alias("successful_pages"),
        F.count_if(F.col("has_required") & ~F.col("page_ok")).alias("failed_pages"), (F.sum("optional_failures") > 0).alias("partial"))
    return pages, papers


def result_status(pages: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """PARTIAL when a page failed or an uncertainty is open, else READY."""
    failed = pages.groupBy("paper_id").agg(F.bool_or("failed").alias("any_failed"))
    open_ = uncertainties.where("not resolved").select("paper_id").distinct().withColumn("_open", F.lit(True))
    joined = failed.join(open_, "paper_id", "left")
    return joined.select("paper_id", F.when(F.col("any_failed") | F.coalesce("_open", F.lit(False)), "PARTIAL").otherwise("READY").alias("status"))


def region_status(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result of a reading by regions: status per paper, and its uncertainties.

    A paper is PARTIAL when any region, required or not, is not completed.  Each such region is an
    uncertainty (required ones first), of kind table, formula or else text; pages with a
    required failure are listed, and the optional failures counted.
    """
    failed, needed = F.col("status") != "completed", F.coalesce(F.col("required"), F.lit(False))
    papers = regions.groupBy("paper_id").agg(
        F.when(F.bool_or(failed), "PARTIAL").otherwise("READY").alias("status"),
        F.array_sort(F.collect_set(F.when(failed & needed, F.col("page")))).alias("failed_pages"), F.count_if(failed & ~needed).alias("downgraded"))
    kind = F.when(F.col("kind").isin("table", "formula"), F.col("kind")).otherwise("text")
    open_ = regions.where(failed).select("paper_id", "page", (~needed).cast("int").alias("later"), kind.alias("kind"), "region_id", F.lit(False).alias("resolved"))
    return papers, open_


def quality_rollup(pages: DataFrame, regions: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """One row per paper: page, region, token, time and open-issue counts."""
    p = pages.groupBy("paper_id").agg(F.count_if(~F.col("failed")).alias("recognized_pages"), F.count_if("cache_hit").alias("cached_pages"), F.count_if("failed").alias("failed_pages"))
    r = regions.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total_regions"), F.count_if(F.col("status") == "completed").alias("completed_regions"), F.count_if(F.col("status") == "failed").alias("failed_regions"),
        F.count_if(F.col("error_kind") == "timeout_unknown").alias("unknown_regions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("duration_ms").alias("duration_ms"))
    u = uncertainties.where("not resolved").groupBy("paper_id").agg(F.count(F.lit(1)).alias("unresolved"))
    return p.join(r, "paper_id", "left").join(u, "paper_id", "left").na.fill(0)


def ocr_usage(requests: DataFrame) -> DataFrame:
    """Requests, cache hits, tokens, time and failures per paper."""
    failed = F.col("status") == "failed"
    g = requests.groupBy("paper_id").agg(
        F.count_if(~F.col("cache_hit")).alias("requests"), F.count_if("cache_hit").alias("cache_hits"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("duration_ms").alias("duration_ms"), F.count_if(failed).alias("failed_pages"))
    return g.withColumn("partial", F.col("failed_pages") > 0)


def open_uncertainties(revisions: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """Unresolved uncertainties of each paper's latest usable revision."""
    usable = first_rows(revisions.where(F.col("status").isin("completed", "partial")), ["paper_id"], [F.col("revision").desc()]).select(F.col("id").alias("revision_id"))
    return uncertainties.where("not resolved").join(usable, "revision_id", "left_semi")


def suspicious_formulas(sections: DataFrame) -> DataFrame:
    """Formulas with broken glyphs, one row each."""
    return sections.select("paper_id", "section_id", F.greatest(F.lit(1), F.coalesce("page_start", F.lit(1))).alias("page"), F.explode(M.formula_spans(F.col("markdown"))).alias("formula"))


def formula_balance(sections: DataFrame) -> DataFrame:
    return sections.groupBy("paper_id").agg(F.sum(M.structural_issues(F.col("markdown"))).cast("long").alias("structural_issues"))


def complete_enough(source: Column, rendered: Column) -> Column:
    """A rendering of a long source keeps at least 45 % of its length, marks aside."""
    want = F.length(F.regexp_replace(source, rf"{SPACE}+", ""))
    got = F.length(F.regexp_replace(rendered, r"[#>*`$\s]+", ""))
    return (want < 120) | (got >= want * 0.45)


def missing_numbers(expected: Column, found: Column) -> Column:
    return F.array_except(expected, found)


def missing_keys(selected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return selected.select(key).distinct().join(found.select(key), key, "left_anti")


def merge_uncertainties(required: DataFrame, optional: DataFrame, pages: DataFrame) -> DataFrame:
    """All open points: failed required regions, failed optional ones, issues of each page.

    ``pages(paper_id, page, uncertainties array<struct(kind, source_text)>)``.
    """
    listed = pages.select("paper_id", "page", F.explode("uncertainties").alias("u")).select("paper_id", "page", "u.kind", "u.source_text", F.lit("page").alias("origin"))
    of = lambda df, name: df.select("paper_id", "page", "kind", "source_text", F.lit(name).alias("origin"))
    return of(required, "required").unionByName(of(optional, "optional")).unionByName(listed)


def newest_valid_cache(entries: DataFrame, valid: Column) -> DataFrame:
    """The newest stored answer of each table, by name, that still passes its check."""
    return first_rows(entries.where(valid), ["table_id"], [F.col("name").desc()])


def render_blocks(blocks: Column) -> Column:
    """``struct(markdown, confidence)`` of ``array<struct(kind, text, level, number, confidence)>``."""
    def one(b: Column) -> Column:
        text = F.trim(F.regexp_replace(b["text"], r"[ \t]+", " "))
        lines = F.filter(F.split(text, "\n"), lambda t: F.trim(t) != "")
        latex = F.btrim(strip(text), F.lit("$"))
        tag = F.when(b["number"].isNotNull() & ~F.contains(latex, F.lit("\\tag")), F.concat(F.lit(" \\tag{"), b["number"].cast("string"), F.lit("}"))).otherwise(F.lit(""))
        level = F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(b["level"], F.lit(2))))
        return (
            F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(F.ltrim(text, F.lit("#")))))
            .when(b["kind"] == "list", F.array_join(F.transform(lines, lambda t: F.concat(F.lit("- "), F.trim(F.ltrim(F.trim(t), F.lit("-•"))))), "\n\n"))
            .when(b["kind"] == "quote", F.array_join(F.transform(F.split(text, "\n"), lambda t: F.concat(F.lit("> "), t)), "\n"))
            .when(b["kind"] == "formula", F.concat(F.lit("$$\n"), latex, tag, F.lit("\n$$")))
            .otherwise(F.regexp_replace(text, r"\s*\n\s*", " "))
        )

    kept = F.filter(blocks, lambda b: (F.trim(F.coalesce(b["text"], F.lit(""))) != "") | (b["kind"] == "formula"))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, b: acc + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(b["confidence"], F.lit(0.0)))))
    return F.struct(F.array_join(F.transform(kept, one), "\n\n").alias("markdown"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("confidence"))
