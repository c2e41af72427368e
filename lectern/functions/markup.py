"""Markdown structure: tables, formulas, anchors, figures, quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import ANCHOR, SPACE, collapse, lstrip, rstrip, strip

# Patterns of captions, page anchors, tables and formulas.
FIGURE_CAPTION = r"(?is)^\s*(?:fig(?:ure)?\.?)\s*(\d+[A-Za-z]?)\s*[:.]\s*(.+)"
TABLE_CAPTION = r"(?is)^\s*(?:table|tab\.)\s*(\d+[A-Za-z]?)\s*[:.]\s*(.+)"
PAGE_ANCHOR = r"(?i)<a\b[^>]*\bdata-page=[\"'](\d+)[\"'][^>]*>\s*</a>"
GFM_TABLE = r"(?m)^\s*\|.+\|\s*$\n\s*\|?\s*:?-{3,}:?(?:\s*\|\s*:?-{3,}:?)+\s*\|?\s*$"
BARE_FORMULA = r"(?i)\{[^{}\n]{0,90}(?:=|\\(?:sum|frac|mathcal)|[ℓl](?:task|cons|rec)|[_^])[^{}\n]{1,160}\}"
TABLE_LINE = r"(?im)^\s*(?:table|tab\.)\s*\d+[A-Za-z]?\s*[:.]?.*$"
CELL_NUMBER = r"(?<!\w)[+-]?\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
ANCHOR_TOKEN = "EVIDENCE_ANCHOR_"
_CUT, _END = "\ufdd0", "\ufdd1"


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def table_lines(markdown: Column) -> Column:
    return F.filter(F.transform(F.split(markdown, r"\r\n|[\n\r\x0b\x0c]"), strip), lambda line: line.startswith("|"))


def cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), strip)


def table_rows(markdown: Column) -> Column:
    """Rows of cells, header first, separator dropped; null when it is not a table."""
    return rows_of_lines(table_lines(markdown))


def rows_of_lines(lines: Column) -> Column:
    separator = F.forall(cells(F.get(lines, F.lit(1))), lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(r"^:?-{3,}:?$"))
    body = F.transform(F.concat(F.slice(lines, 1, 1), F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))), cells)
    return F.when((F.size(lines) >= 3) & separator, body)


def render_table(caption: Column, headers: Column, rows: Column, notes: Column) -> Column:
    def line(values: Column) -> Column:
        safe = F.transform(values, lambda v: F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
        return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))

    head = F.when(F.coalesce(caption, F.lit("")) != "", F.array(caption, F.lit(""))).otherwise(F.array().cast("array<string>"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    tail = F.when(F.size(notes) > 0, F.concat(F.array(F.lit("")), F.transform(notes, lambda n: F.concat(F.lit("> "), n)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.array(line(headers), rule), F.transform(rows, line), tail), "\n")


def table_valid(headers: Column, rows: Column, confidence: Column, expected: Column | None = None) -> Column:
    """Two columns or more, rectangular, confident, and as wide as expected."""
    good = (F.size(headers) >= 2) & (F.size(rows) > 0) & (confidence >= 0.8) & F.forall(rows, lambda r: F.size(r) == F.size(headers))
    return good if expected is None else good & (expected.isNull() | (F.size(headers) == expected))


def expected_columns(text: Column) -> Column:
    """Width announced by a metric header, if it has at least two metric pairs."""
    pairs = F.regexp_count(text, F.lit(r"(?i)A\s*\(%\)\s*/\s*F\s*\(%\)"))
    return F.when((pairs >= 2) & text.rlike(r"(?i)\bDataset\b") & text.rlike(r"(?i)\bModels?\b"), pairs + 2)


def formula_valid(latex: Column) -> Column:
    text = F.btrim(strip(latex), F.lit("$"))
    good = (text != "") & ~text.rlike("[�□\\x00]")
    for left, right in (("{", "}"), ("(", ")"), ("[", "]")):
        good = good & (count_of(text, left) == count_of(text, right))
    return good


def formula_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\(\s*(\d{1,3})\s*\)"), F.lit(1)), F.lit(-1)).cast("int")


def formula_spans(markdown: Column) -> Column:
    """Display formulas that hold a replacement or missing glyph."""
    spans = F.regexp_extract_all(markdown, F.lit(r"\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]"), F.lit(0))
    return F.filter(spans, lambda s: s.rlike("[�□\\x00]"))


def structural_issues(markdown: Column) -> Column:
    """Count of unbalanced formula delimiters, 0..3."""
    odd = (count_of(markdown, "$$") % 2 == 1).cast("int")
    brackets = (count_of(markdown, "\\[") != count_of(markdown, "\\]")).cast("int")
    equations = (count_of(markdown, "\\begin{equation") != count_of(markdown, "\\end{equation")).cast("int")
    return odd + brackets + equations


def caption_regions(markdown: Column) -> Column:
    """Text of each table caption up to the next heading, else 1800 characters further."""
    n = F.regexp_count(markdown, F.lit(TABLE_LINE))
    marked = F.regexp_replace(markdown, f"(?im)({TABLE_LINE[5:]})", f"{_CUT}$1{_END}")
    # The region may run over later captions, so each one is cut from the whole tail.
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", marked, F.lit(_CUT), i - n - 1))

    def region(tail: Column) -> Column:
        caption = F.substring_index(tail, _END, 1)
        rest = F.translate(F.substring(tail, F.length(caption) + 2, F.lit(2_000_000_000)), _CUT + _END, "")
        at = F.regexp_instr(rest, F.lit(r"(?m)^#{1,6}\s+|^\d+(?:\.\d+)*[.)]?\s+[A-Z]"))
        return F.concat(caption, F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(F.left(rest, F.lit(1800))))

    return F.when(n > 0, F.transform(tails, region)).otherwise(F.array().cast("array<string>"))


def quality_issues(markdown: Column) -> Column:
    """``struct(kind, source_text, confidence)`` for bare formulas, flattened tables and a
    reference line that holds several entries."""

    def issue(kind: str, text: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("source_text"), F.lit(confidence).alias("confidence"))

    none = F.array().cast("array<struct<kind:string,source_text:string,confidence:double>>")
    formula = F.regexp_extract(markdown, BARE_FORMULA, 0)
    tables = F.filter(
        caption_regions(markdown),
        lambda r: ~r.rlike(r"(?m)^\s*\|.+\|\s*$\n\s*\|?\s*:?-{3,}") & (F.regexp_count(r, F.lit(CELL_NUMBER)) >= 6),
    )
    at = F.regexp_instr(markdown, F.lit(r"(?im)^\s*#{0,6}\s*(?:references|bibliography)\s*$"))
    lines = F.split(F.substring(markdown, at, F.lit(2_000_000_000)), r"\r\n|[\n\r]")
    crowded = F.get(F.filter(lines, lambda line: F.regexp_count(line, F.lit(r"\[\d{1,3}\]")) >= 2), F.lit(0))
    return F.concat(
        F.when(formula != "", F.array(issue("formula", formula, 0.45))).otherwise(none),
        F.transform(tables, lambda t: issue("table", F.left(t, F.lit(1200)), 0.35)),
        F.when((at > 0) & crowded.isNotNull(), F.array(issue("reading_order", F.left(crowded, F.lit(1200)), 0.45))).otherwise(none),
    )


def mask_anchors(markdown: Column) -> Column:
    """``struct(text, anchors)`` with the i-th anchor replaced by a numbered token."""
    anchors = F.regexp_extract_all(markdown, F.lit(ANCHOR), F.lit(0))
    parts = F.split(F.regexp_replace(markdown, ANCHOR, _CUT), _CUT)
    text = F.array_join(
        F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.lit(f"[[{ANCHOR_TOKEN}"), (i - 1).cast("string"), F.lit("]]"), p)).otherwise(p)), ""
    )
    return F.struct(text.alias("text"), anchors.alias("anchors"))


def restore_anchors(output: Column, anchors: Column) -> Column:
    """``struct(markdown, problem)``: a lost or unknown token is a problem, not a guess."""
    body = strip(output)
    fenced = F.regexp_extract(body, r"(?is)^```(?:markdown|md)?\s*\n(.*?)\n```$", 1)
    body = F.when(body.rlike(r"(?is)^```(?:markdown|md)?\s*\n(.*?)\n```$"), strip(fenced)).otherwise(body)
    numbered = F.transform(anchors, lambda a, i: F.struct(F.concat(F.lit(f"[[{ANCHOR_TOKEN}"), i.cast("string"), F.lit("]]")).alias("token"), a.alias("anchor")))
    lost = F.size(F.filter(numbered, lambda n: ~F.contains(body, n["token"])))
    restored = strip(F.aggregate(numbered, body, lambda acc, n: F.replace(acc, n["token"], n["anchor"])))
    problem = (
        F.when(lost > 0, "lost_anchor")
        .when(F.contains(restored, F.lit(f"[[{ANCHOR_TOKEN}")), "unknown_anchor")
        .when(restored == "", "empty")
    )
    return F.struct(F.when(problem.isNull(), restored).alias("markdown"), problem.alias("problem"))


_FENCED = r"(?m)^ {0,3}(`{3,}|~{3,})[^\n]*(?:\r?\n|$)[\s\S]*?^ {0,3}\1[ \t]*(?=\r?$)"
_INLINE = r"(`+)([^`\n]*?)\1"


def _outside(text: Column, pattern: str, change) -> Column:
    """Apply ``change`` to what lies outside the matches of ``pattern``."""
    inside = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(F.regexp_replace(text, pattern, _CUT), _CUT)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.element_at(inside, F.greatest(i, F.lit(1)))).otherwise(F.lit("")), change(p))), "")


def normalize_math(markdown: Column) -> Column:
    """``\\[..\\]`` to ``$$..$$`` and ``\\(..\\)`` to ``$ .. $`` outside code, same length."""

    def math(text: Column) -> Column:
        display = F.regexp_replace(text, r"\\\[([\s\S]*?)\\\]", r"\$\$$1\$\$")
        return F.regexp_replace(display, r"\\\(([\s\S]*?)\\\)", r"\$ $1 \$")

    return _outside(markdown, _FENCED, lambda outer: _outside(outer, _INLINE, math))


def figure_image(caption: Column, page: Column, path: Column) -> Column:
    text = F.regexp_replace(F.coalesce(F.when(caption != "", caption), F.concat(F.lit("Figure on page "), page.cast("string"))), r"[\[\]\r\n]+", " ")
    number = F.regexp_extract(text, FIGURE_CAPTION, 1)
    alt = collapse(F.when(number != "", F.concat(F.lit("Figure "), number, F.lit(": "), F.regexp_extract(text, FIGURE_CAPTION, 2))).otherwise(text))
    short = F.when(F.length(alt) > 180, F.concat(rstrip(F.left(alt, F.lit(177))), F.lit("..."))).otherwise(alt)
    return F.concat(F.lit("!["), short, F.lit("]("), path, F.lit(")"))


def embed_figures(markdown: Column, figures: Column) -> Column:
    """Put each image before the first line of its caption, else at the end.

    ``figures`` is an ordered array of ``struct(caption, page, path)`` of one page text.
    """

    def put(acc: Column, figure: Column) -> Column:
        image = figure_image(figure["caption"], figure["page"], figure["path"])
        number = F.regexp_extract(figure["caption"], FIGURE_CAPTION, 1)
        pattern = F.concat(F.lit(r"(?im)^(?=\s*(?:fig(?:ure)?\.?)\s*"), number, F.lit(r"\s*[:.])"))
        at = F.when(number != "", F.regexp_instr(acc, pattern)).otherwise(F.lit(0))
        # A zero-width hit is found through the text that follows the line start.
        placed = F.concat(F.substring(acc, F.lit(1), at - 1), image, F.lit("\n\n"), F.substring(acc, at, F.lit(2_000_000_000)))
        appended = F.concat(rstrip(acc), F.lit("\n\n"), image)
        return F.when(F.contains(acc, image), acc).when(at > 0, placed).otherwise(appended)

    return F.aggregate(figures, markdown, put)


def insert_table(markdown: Column, caption: Column, table: Column) -> Column:
    """Put a rebuilt table after its caption line and drop its flattened text: what lies
    before the next heading, when that holds eight numbers or more."""
    number = F.regexp_extract(caption, TABLE_CAPTION, 1)
    line = F.concat(F.lit(r"(?im)^.*(?:table|tab\.)\s*"), number, F.lit(r"\s*[:.]?.*$"))
    at = F.when(number != "", F.regexp_instr(markdown, line)).otherwise(F.lit(0))
    end = at + F.length(F.regexp_substr(markdown, line))
    tail = F.substring(markdown, end, F.lit(2_000_000_000))
    stop = F.regexp_instr(tail, F.lit(r"(?m)^\s*(?:#{1,6}\s+|\d+(?:\.\d+)*[.)]?\s+[A-Z][A-Za-z])"))
    flat = F.regexp_count(F.substring(tail, F.lit(1), stop - 1), F.lit(r"\d+(?:\.\d+)?"))
    rest = F.when((stop > 0) & (flat >= 8), F.substring(tail, stop, F.lit(2_000_000_000))).otherwise(tail)
    appended = F.concat(rstrip(markdown), F.lit("\n\n"), strip(table))
    placed = F.concat(
        rstrip(F.substring(markdown, F.lit(1), end - 1)), F.lit("\n\n"), strip(table), F.lit("\n\n"),
        lstrip(rest),
    )
    return F.when(markdown.rlike(GFM_TABLE), markdown).when(at > 0, placed).otherwise(appended)


def page_parts(markdown: Column, first_page: Column) -> Column:
    """A section back into ``struct(page, body)`` at its page anchors; text before the first
    anchor is dropped, a section without anchors is its first page."""
    marked = F.split(F.regexp_replace(markdown, PAGE_ANCHOR, f"{_CUT}$1{_END}"), _CUT)
    parts = F.transform(
        F.slice(marked, F.lit(2), F.greatest(F.size(marked), F.lit(1))),
        lambda p: F.struct(F.substring_index(p, _END, 1).cast("int").alias("page"), strip(F.substring_index(p, _END, -1)).alias("body")),
    )
    whole = F.array(F.struct(F.coalesce(first_page, F.lit(1)).cast("int").alias("page"), markdown.alias("body")))
    return F.when(F.size(marked) > 1, F.filter(parts, lambda p: p["body"] != "")).otherwise(whole)


def replace_unique(markdown: Column, source: Column, replacement: Column) -> Column:
    """``struct(markdown, replaced)``: replace when the source, whitespace aside, occurs once."""
    hits = F.when(source != "", ((F.length(markdown) - F.length(F.replace(markdown, source, F.lit("")))) / F.length(source)).cast("int")).otherwise(F.lit(0))
    compact = F.regexp_replace(source, rf"{SPACE}+", "")
    quoted = F.transform(F.split(compact, ""), lambda c: F.when(c.rlike(r"[A-Za-z0-9]"), c).when(c == "\\", F.lit("\\\\")).otherwise(F.concat(F.lit("["), F.when(c.isin("[", "]", "^", "&"), F.concat(F.lit("\\"), c)).otherwise(c), F.lit("]"))))
    pattern = F.array_join(F.filter(quoted, lambda q: q != "[]"), r"\s*")
    loose = F.when(compact != "", F.regexp_count(markdown, pattern)).otherwise(F.lit(0))
    at = F.regexp_instr(markdown, pattern)
    found = F.regexp_substr(markdown, pattern)
    swapped = F.concat(F.substring(markdown, F.lit(1), at - 1), replacement, F.substring(markdown, at + F.length(found), F.lit(2_000_000_000)))
    return F.struct(
        F.when(hits == 1, F.replace(markdown, source, replacement)).when(loose == 1, swapped).otherwise(markdown).alias("markdown"),
        ((hits == 1) | (loose == 1)).alias("replaced"),
    )
