"""From page texts to clean pages, sections, blocks and assembled documents.

``pages(paper_id, page, text)``: one row per page.  A page is one bounded value; a paper may
have any number of pages, so nothing here gathers a paper in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.segments import blocks as block_texts
from lectern.functions.segments import compact_blocks
from lectern.session import checkpointed
from lectern.skew import exploded, first_rows, placed_text, running

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLOCK = 8192


def coarse(position: str) -> list[Column]:
    """Blocks over an integer position: 8192 positions each, so the summary of even ten
    billion rows of one key is about a million rows."""
    return [F.floor(F.col(position) / BLOCK).alias("_block")]


def running_by(df: DataFrame, keys: list[str], order: list[str], values: dict, inclusive: bool = True) -> DataFrame:
    """``running`` with blocks over the first order column, an integer."""
    blocked = df.select("*", *coarse(order[0]))
    return running(blocked, keys, order, ["_block"], values, inclusive).drop("_block")


def exact_duplicates(files: DataFrame, digest: str = "sha256", item: str = "id", order: str = "created_at") -> DataFrame:
    """One row per content: the first item by creation and the number of copies.

    Map-side partial aggregates keep a content with very many copies out of one task.
    """
    return files.groupBy(digest).agg(
        F.min_by(F.col(item), F.struct(F.col(order), F.col(item))).alias("canonical_id"), F.count(F.lit(1)).alias("n_files")
    )


# ---------------------------------------------------------------- repeated page margins

def line_key(line: Column) -> Column:
    bare = T.fold(F.regexp_replace(T.strip(line), r"^#{1,6}\s+", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"\d+", "#"), r"\s+", " ")


def margin_candidate(line: Column) -> Column:
    text = T.strip(line)
    return (
        (text != "") & (F.length(text) <= 160) & ~F.contains(text, F.lit("$"))
        & ~text.rlike(r"^(?:\||!\[|>|```|<)") & ~text.rlike(r"\[[^\]]+\]\([^)]+\)")
    )


def remove_margins(pages: DataFrame, paper: str = "paper_id", page: str = "page", text: str = "text") -> DataFrame:
    """Drop repeated header and footer lines and bare page numbers; ``removed`` counts them.

    The key of a line counts once per page among its first two and last two nonblank lines; it
    is repeated on max(2, ceil(0.4 x pages)) pages or more.  Only keys are shuffled, four per
    page at most; texts move once, for the final join.
    """
    lines = F.split(F.col(text), LINE_BREAK)
    prepared = pages.select(paper, page, text).withColumn("_lines", lines)
    filled = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: T.strip(F.get(F.col("_lines"), i)) != "")
    prepared = prepared.withColumn("_filled", filled)
    prepared = prepared.withColumn(
        "_edge", F.array_union(F.slice("_filled", 1, 2), F.slice("_filled", F.greatest(F.size("_filled") - 1, F.lit(1)), F.lit(2)))
    )
    edge_lines = F.filter(F.transform("_edge", lambda i: F.get(F.col("_lines"), i)), margin_candidate)
    keys = exploded(prepared, F.array_distinct(F.transform(edge_lines, line_key)), "_key", paper, page).where("_key <> ''")

    sizes = pages.groupBy(paper).agg(F.count(F.lit(1)).alias("_pages"))
    counts = keys.groupBy(paper, "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    repeated = counts.join(sizes, paper).where(F.col("_n") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * 0.4 + 0.999))).select(paper, "_key")
    per_page = keys.join(repeated, [paper, "_key"]).groupBy(paper, page).agg(F.collect_set("_key").alias("_repeated"))

    joined = prepared.join(per_page, [paper, page], "left").join(sizes, paper, "left")
    repeated_keys = F.coalesce(F.col("_repeated"), F.array().cast("array<string>"))

    def bare(line: Column) -> Column:
        return F.regexp_replace(T.strip(line), r"^#{1,6}\s+", "")

    def dropped(line: Column, i: Column) -> Column:
        number = bare(line).rlike(r"(?i)^(?:page\s*)?\d{1,4}$")
        return F.array_contains(F.col("_edge"), i) & margin_candidate(line) & (F.array_contains(repeated_keys, line_key(line)) | number)

    marked = F.transform("_lines", lambda line, i: F.when(dropped(line, i), F.lit(None)).otherwise(
        F.when(T.strip(line).rlike(r"^#{1,6}\s+\d{1,4}\s*$"), bare(line)).otherwise(line)))
    done = joined.withColumn("_marked", marked)
    several = F.col("_pages") >= 2
    return done.select(
        paper,
        page,
        F.when(several, T.strip(F.array_join("_marked", "\n"))).otherwise(F.col(text)).alias(text),
        F.when(several, F.size(F.filter("_marked", lambda m: m.isNull()))).otherwise(F.lit(0)).alias("removed"),
    )


# ---------------------------------------------------------------------------- sections

def heading_rows(pages: DataFrame, reader: bool = False) -> DataFrame:
    """Heading lines ``(paper_id, page, line_no, title, level, strong)`` with their section.

    ``section_no`` and ``piece`` count openings and headings up to the line; a weak heading
    seen on several pages is ``suppressed``.  ``reader`` knows strong headings only.
    Headings are few, so they are checkpointed: texts are classified once.
    """
    plain = F.regexp_replace("text", T.ANCHOR, "")
    lines = exploded(pages, F.split(plain, LINE_BREAK), "line", "paper_id", "page", pos="line_no")
    found = lines.withColumn("h", T.heading(F.col("line"))).where("h is not null").select("paper_id", "page", "line_no", "h.title", "h.level", "h.strong")
    if reader:
        found = found.where("strong")
    found = checkpointed(found)
    weak = found.where("not strong").withColumn("_key", T.fold(F.col("title")))
    repeated = weak.groupBy("paper_id", "_key").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b")
    dropped = weak.join(repeated, ["paper_id", "_key"], "left_semi").drop("_key").withColumn("suppressed", F.lit(True))
    kept = found.join(dropped.select("paper_id", "page", "line_no"), ["paper_id", "page", "line_no"], "left_anti")
    seen = checkpointed(running_by(kept, ["paper_id"], ["page", "line_no"], {"_previous": ("last", F.col("title"))}, inclusive=False))
    same = T.fold(F.col("title")) == T.fold(F.coalesce(F.col("_previous"), F.lit("Overview")))
    # A repeated title continues its section; when re-reading page sections it opens a new one.
    opened = seen.withColumn("opens", F.lit(1) if reader else F.when(same, 0).otherwise(1)).drop("_previous")
    counted = running_by(opened, ["paper_id"], ["page", "line_no"], {"section_no": ("sum", F.col("opens")), "piece": ("sum", F.lit(1))})
    return checkpointed(counted.withColumn("suppressed", F.lit(False)).unionByName(dropped, allowMissingColumns=True))


def section_chunks(pages: DataFrame, reader: bool = False) -> DataFrame:
    """``(paper_id, section_no, page, title, level, body)``: the text of a section per page.

    Texts meet the headings of their page once, by (paper, page), and are cut in place.
    """
    heads = heading_rows(pages, reader)
    key = ["paper_id", "page"]
    marks = F.array_sort(F.collect_list(F.struct("line_no", "suppressed", "section_no", "piece")))
    per_page = heads.groupBy(*key).agg(marks.alias("_marks"), F.max("section_no").alias("_s"), F.max("piece").alias("_p"))
    reached = pages.select(*key).join(per_page.select(*key, "_s", "_p"), key, "left")
    carried = running_by(reached, ["paper_id"], ["page"], {"_s0": ("max", F.col("_s")), "_p0": ("max", F.col("_p"))}, inclusive=False)
    carried = carried.select(*key, F.coalesce("_s0", F.lit(0)).alias("_s0"), F.coalesce("_p0", F.lit(0)).alias("_p0"))
    joined = pages.select(*key, "text").join(per_page.select(*key, "_marks"), key, "left").join(carried, key)
    joined = joined.withColumn("_lines", F.split(F.regexp_replace("text", T.ANCHOR, ""), LINE_BREAK))
    marks_or_none = F.coalesce(F.col("_marks"), F.array().cast(heads_type()))
    joined = joined.withColumn("_hidden", F.transform(F.filter(marks_or_none, lambda m: m["suppressed"]), lambda m: m["line_no"]))
    first = F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(False).alias("suppressed"), F.col("_s0").cast("long").alias("section_no"), F.col("_p0").cast("long").alias("piece")))
    joined = joined.withColumn("_starts", F.concat(first, F.filter(marks_or_none, lambda m: ~m["suppressed"])))
    ends = F.concat(F.transform(F.slice("_starts", F.lit(2), F.size("_starts")), lambda m: m["line_no"]), F.array(F.size("_lines")))

    def cut(start: Column, end: Column) -> Column:
        inside = F.slice(F.col("_lines"), start["line_no"] + 2, end - start["line_no"] - 1)
        shown = F.filter(inside, lambda _, i: ~F.array_contains(F.col("_hidden"), i + start["line_no"] + 1))
        return F.struct(start["section_no"].alias("section_no"), start["piece"].alias("piece"), T.strip(F.array_join(shown, "\n")).alias("body"))

    pieces = exploded(joined, F.zip_with("_starts", ends, cut), "c", *key).select(*key, "c.*").where("body <> ''")
    bodies = F.array_sort(F.collect_list(F.struct("piece", "body")))
    chunks = pieces.groupBy("paper_id", "section_no", "page").agg(F.array_join(F.transform(bodies, lambda r: r["body"]), "\n").alias("body"))
    starts = heads.where("opens = 1").select("paper_id", "section_no", "title", "level")
    headed = starts.select("paper_id").distinct().withColumn("_headed", F.lit(True))
    named = chunks.join(starts, ["paper_id", "section_no"], "left").join(headed, "paper_id", "left")
    fallback = F.when(F.col("_headed"), F.lit("Overview")).otherwise(F.lit("Document"))
    return named.select(
        "paper_id", "section_no", "page", F.coalesce("title", fallback).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "body"
    )


def heads_type() -> str:
    return "array<struct<line_no:int,suppressed:boolean,section_no:bigint,piece:bigint>>"


def sections(chunks: DataFrame) -> DataFrame:
    """One row per section in document order with a unique slug."""
    rows = chunks.groupBy("paper_id", "section_no").agg(
        F.first("title").alias("title"), F.first("level").alias("level"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_chunks"),
    )
    rows = checkpointed(running_by(rows, ["paper_id"], ["section_no"], {"ord": ("sum", F.lit(1))}, inclusive=False))
    return with_unique_slugs(rows, "title", "ord")


def with_unique_slugs(rows: DataFrame, title: str, order: str) -> DataFrame:
    """``section_id``: the slug, with ``-2``, ``-3`` on later equal slugs of the paper."""
    based = rows.withColumn("_base", T.slug(F.col(title)))
    counted = running_by(based, ["paper_id", "_base"], [order], {"_nth": ("sum", F.lit(1))})
    section_id = F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_nth").cast("string")))
    return counted.withColumn("section_id", section_id).drop("_base", "_nth")


def anchors(chunks: DataFrame, section_rows: DataFrame) -> DataFrame:
    """One evidence anchor per (section, page): block id and the first 500 characters."""
    keyed = chunks.join(section_rows.select("paper_id", "section_no", "section_id", "ord"), ["paper_id", "section_no"])
    numbered = running_by(keyed, ["paper_id", "section_no"], ["page"], {"chunk_no": ("sum", F.lit(1))})
    block_id = F.concat(F.col("section_id"), F.lit("-page-"), F.col("page").cast("string"), F.lit("-"), F.col("chunk_no").cast("string"))
    return numbered.select(
        "paper_id", "section_id", "ord", "chunk_no", "page", block_id.alias("block_id"), F.left("body", F.lit(500)).alias("source_text"), "body"
    )


def anchored_markdown(anchor_rows: DataFrame) -> Column:
    """The stored form of a chunk: its anchor element, a blank line, its text."""
    return F.format_string('<a data-paper-id="%s" data-page="%s" data-block-id="%s"></a>\n\n%s',
                           F.col("paper_id").cast("string"), F.col("page").cast("string"), F.col("block_id"), F.col("body"))


def document_text(anchor_rows: DataFrame) -> DataFrame:
    """Whole text of every paper as its chunks in section order, each with its place (``start``)."""
    rows = anchor_rows.where(T.strip(F.col("body")) != "").select("*", *coarse("ord"))
    return placed_text(rows, ["paper_id"], ["ord", "page"], ["_block"], "body")


# ------------------------------------------------------------------------------ blocks

def reader_blocks(section_texts: DataFrame, compact: bool = False) -> DataFrame:
    """Paragraph blocks of each section text, optionally with short fragments joined."""
    texts = section_texts.withColumn("_blocks", block_texts(F.col("markdown")))
    if not compact:
        out = exploded(texts, "_blocks", "text", "paper_id", "section_id", pos="_i")
        return out.select("paper_id", "section_id", F.concat(F.col("section_id"), F.lit(":block-"), (F.col("_i") + 1).cast("string")).alias("block_id"), F.col("_i").alias("ord"), "text")
    out = exploded(texts, compact_blocks(F.col("_blocks")), "b", "paper_id", "section_id", pos="ord")
    return out.select(
        "paper_id", "section_id",
        F.concat(F.col("section_id"), F.lit(":block-"), (F.col("b.first") + 1).cast("string")).alias("block_id"),
        "ord", F.col("b.text").alias("text"), F.col("b.compacted").alias("compacted"), F.col("b.n").alias("n_blocks"),
    )


def neighbours(blocks: DataFrame, keys: list[str], order: str, text: str, before: int = 1, after: int = 1, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """Each block with the blocks around it, joined by a blank line.

    Positions are integers.  Rows are dealt by runs of ``block`` positions of a key, and only those at the edge of a run
    are sent to the next run as well, so a text moves once and a document of any length is spread over all tasks.
    """
    at = F.col(order)
    runs = F.sequence(F.floor((at - after) / block), F.floor((at + before) / block))
    dealt = blocks.select(*blocks.columns, F.floor(at / block).alias("_home"), F.explode(runs).alias("_run"))
    near = Window.partitionBy(*keys, "_run").orderBy(order).rangeBetween(-before, after)
    joined = F.array_join(F.collect_list(text).over(near), "\n\n")
    context = joined if limit is None else F.left(joined, F.lit(limit))
    return dealt.select("*", context.alias("context")).where("_run = _home").drop("_home", "_run")


def first_per_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Order-preserving distinct: the first row of every value."""
    return first_rows(rows, [*keys, value], [F.col(order)])
