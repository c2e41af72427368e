"""Context assembly: items of a scope, token budgets, drift and format checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import token_estimate
from lectern.operators.revisions import latest

# Tokens set aside besides the papers of a scope.
RESERVES = {"system_prompt": 4200, "tools": 7800, "conversation": 0, "figures": 0, "output_reserve": 16000, "safety_buffer": 8000}


def scoped_items(scope_items: DataFrame, items: DataFrame, papers: DataFrame, compressions: DataFrame) -> DataFrame:
    """Items of every scope with their paper, text and tokens.

    A custom item uses its own text; an item in compressed mode counts its active
    compression's tokens.
    """
    active = compressions.select(F.col("id").alias("active_compression_id"), F.col("estimated_tokens").alias("compressed_tokens"), "compressed_text")
    joined = scope_items.join(items, scope_items["context_item_id"] == items["id"]).join(
        papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id")
    joined = joined.join(active, "active_compression_id", "left")
    source = F.when(F.col("item_type") == "custom", F.col("custom_text")).otherwise(F.col("source_text"))
    packed = (F.col("mode") == "compressed") & F.col("compressed_tokens").isNotNull()
    return joined.select(
        "scope_id", "context_item_id", "paper_id", "paper_title", "section_id", "item_type", "mode", "sort_order", "source_hash",
        F.when(packed, F.col("compressed_text")).otherwise(source).alias("text"),
        F.when(packed, F.col("compressed_tokens").cast("long")).otherwise(token_estimate(source)).alias("tokens"),
    )


def token_budget(items: DataFrame, scope: str = "scope_id", tokens: str = "tokens", max_context: int = 128000) -> DataFrame:
    """Tokens of each scope: its items plus the fixed reserves, and the share of the model's
    context, capped at 100 percent."""
    fixed = sum(RESERVES.values())
    sums = items.groupBy(scope).agg(F.sum(tokens).cast("long").alias("papers"), F.count(F.lit(1)).alias("n_items"))
    total = F.col("papers") + fixed
    return sums.select(scope, "n_items", "papers", *[F.lit(v).alias(k) for k, v in RESERVES.items()], total.alias("total_tokens"),
                       F.least(F.lit(100.0), F.round(total * 100.0 / max_context, 2)).alias("percent"))


def source_fits(tokens: Column, max_context: int, max_output: int) -> Column:
    return tokens <= max(0, max_context - max_output - 12000)


def chat_budget(items: DataFrame, max_context: int, max_output: int, scope: str = "scope_id") -> DataFrame:
    """Scopes over the chat budget and how many whole-paper items they must compress."""
    budget = max(16000, max_context - max_output - 20000)
    whole = F.coalesce(F.col("section_id"), F.lit("")) == ""
    sums = items.groupBy(scope).agg(F.sum("tokens").cast("long").alias("tokens"), F.count_if(whole & (F.col("mode") != "compressed")).alias("whole_items"))
    over = F.col("tokens") > budget
    return sums.select(scope, "tokens", F.lit(budget).alias("budget"), over.alias("over_budget"), F.when(over, F.col("whole_items")).otherwise(F.lit(0)).alias("must_compress"))


def current_compression(items: DataFrame, compressions: DataFrame) -> DataFrame:
    """Newest compression for each item's current text, by model and prompt version."""
    joined = compressions.join(items.select(F.col("id").alias("context_item_id"), "source_hash"), ["context_item_id", "source_hash"], "left_semi")
    return latest(joined, ["context_item_id", "model_id", "prompt_version"], ["revision"])


def drifted(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Items whose text is no longer the one a snapshot was made from."""
    now = items.select(F.col("id").alias("context_item_id"), F.col("source_hash").alias("current_hash"))
    return expected.join(now, "context_item_id").where("source_hash <> current_hash")


def format_violations(sections: DataFrame, formatted: DataFrame, documents: DataFrame, anchor_rows: DataFrame, max_chars: int = 20_000_000) -> DataFrame:
    """Why a formatted document may not replace its source, one row per violation.

    Sections must match exactly and not be blank, every anchor id must still be there, the
    whole stays under the size cap, and the source hash is the current one.
    """
    want = sections.select("paper_id", "section_id", F.lit(True).alias("_w"))
    got = formatted.select("paper_id", "section_id", "markdown")
    both = want.join(got, ["paper_id", "section_id"], "full_outer")
    issue = F.when(F.col("_w").isNull(), "unknown_section").when(F.col("markdown").isNull(), "missing_section").when(F.trim("markdown") == "", "blank_section")
    by_section = both.select("paper_id", "section_id", issue.alias("violation")).where("violation is not null")
    kept = anchor_rows.select("paper_id", "section_id", "block_id").join(got, ["paper_id", "section_id"])
    lost = kept.where(~F.contains(F.col("markdown"), F.col("block_id"))).select("paper_id", "section_id", F.lit("lost_anchor").alias("violation"))
    size = got.groupBy("paper_id").agg(F.sum(F.length("markdown")).alias("n")).where(F.col("n") > max_chars).select("paper_id", F.lit(None).cast("string").alias("section_id"), F.lit("too_long").alias("violation"))
    stale = formatted.select("paper_id", F.col("source_hash").alias("h")).distinct().join(documents.select("paper_id", "source_hash"), "paper_id").where("h <> source_hash")
    stale = stale.select("paper_id", F.lit(None).cast("string").alias("section_id"), F.lit("stale_source").alias("violation"))
    return by_section.unionByName(lost).unionByName(size).unionByName(stale)


def context_heading(title: Column, section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.format_string("## %s / %s", title, section)).otherwise(F.format_string("## %s", title))


def stage_message(prompt: Column, context: Column, outputs: Column) -> Column:
    """One request: the prompt, the context under its heading, earlier outputs when present."""
    return F.concat_ws("\n\n", prompt, F.concat(F.lit("# Context\n\n"), context), F.when(outputs != "", F.concat(F.lit("# Earlier stages\n\n"), outputs)))
