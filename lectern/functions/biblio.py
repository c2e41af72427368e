"""Bibliography entries: splitting a reference list and reading the fields of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, fold, normalize_title, strip

EDGE = " ,;."
# Patterns of a reference list and of its entries.
LIST_HEADING = r"(?i)\bREFERENCES\b"
LAYOUT_HEADING = r"(?im)^\s*#{0,6}\s*(?:references|bibliography)\s*$"
MARKER = r"(?:^|\s)\[(\d{1,3})\]\s+"
QUOTED = r"[\"“]([^\"”]{8,300})[\"”]"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
ARXIV = r"(?i)\barXiv\s*:?\s*(\d{4}\.\d{4,5}(?:v\d+)?)"
YEAR = r"\b(?:19|20)\d{2}\b"

_ENTRY, _BODY = "\ufdd0", "\ufdd1"  # noncharacters, never in interchanged text


def edge(value: Column) -> Column:
    return F.btrim(value, F.lit(EDGE))


def list_tail(markdown: Column) -> Column:
    """Text after the first references heading; null when there is none."""
    at = F.regexp_instr(markdown, F.lit(LIST_HEADING))
    return F.when(at > 0, F.substring(markdown, at + 10, 2_000_000_000))


def list_pieces(tail: Column) -> Column:
    """Text before the first marker (number null), then one piece per marker."""
    marked = F.regexp_replace(tail, MARKER, f"{_ENTRY}$1{_BODY}")
    return F.transform(
        F.split(marked, _ENTRY),
        lambda piece, i: F.struct(
            F.when(i > 0, F.substring_index(piece, _BODY, 1).cast("int")).alias("index"),
            F.when(i > 0, F.substring_index(piece, _BODY, -1)).otherwise(piece).alias("body"),
        ),
    )


def raw_entry(body: Column) -> Column:
    return edge(collapse(body))


def title(raw: Column) -> Column:
    """Quoted title, else the longest comma part of 12..240 characters, else the opening."""
    quoted = edge(F.regexp_extract(raw, QUOTED, 1))
    parts = F.filter(F.transform(F.split(raw, ","), edge), lambda p: F.length(p).between(12, 240))
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("part"))))
    return F.when(quoted != "", quoted).otherwise(F.coalesce(longest["part"], F.left(raw, F.lit(240))))


def doi(raw: Column) -> Column:
    found = F.rtrim(F.regexp_extract(raw, DOI, 0), F.lit(".,;"))
    return F.when(found != "", found)


def arxiv(raw: Column) -> Column:
    found = F.regexp_extract(raw, ARXIV, 1)
    return F.when(found != "", found)


def year(raw: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(raw, F.lit(YEAR), F.lit(0)), F.lit(-1)).cast("int")


def authors(raw: Column) -> Column:
    """At most twelve names before the quoted title, else before the first comma."""
    at = F.regexp_instr(raw, F.lit(QUOTED))
    prefix = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(F.substring_index(raw, ",", 1))
    names = F.transform(F.split(prefix, r"\s+(?:and|&)\s+|;"), edge)
    return F.slice(F.filter(names, lambda n: n != ""), 1, 12)


def dedup_key(doi_value: Column, title_value: Column) -> Column:
    return F.coalesce(fold(doi_value), normalize_title(title_value))


def spread_entries(markdown: Column) -> Column:
    """Put every entry after a references heading on its own paragraph; the body is kept."""
    at = F.regexp_instr(markdown, F.lit(LAYOUT_HEADING))
    end = at + F.length(F.regexp_extract(markdown, LAYOUT_HEADING, 0))
    tail = F.substring(markdown, end, F.lit(2_000_000_000))
    tail = F.regexp_replace(tail, r"[ \t]+(?=\[\d{1,3}\]\s+)", "\n\n")
    tail = F.regexp_replace(tail, r"\n(?=\[\d{1,3}\]\s+)", "\n\n")
    tail = F.regexp_replace(tail, r"\n{3,}", "\n\n")
    return F.when(at > 0, F.concat(F.substring(markdown, F.lit(1), end - 1), tail)).otherwise(markdown)


def clean_transcript(markdown: Column) -> Column:
    """Drop lone image lines, lay out references, squeeze blank lines."""
    cleaned = F.regexp_replace(markdown, r"(?m)^\s*!\[[^\]]*\]\([^)]+\)\s*$", "")
    return strip(F.regexp_replace(spread_entries(cleaned), r"\n{3,}", "\n\n"))
