"""From page texts to clean pages, sections, anchors and references, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_extracted
from lectern.operators import biblio, corpus
from lectern.session import checkpointed
from lectern.skew import number_rows
from lectern.sources.sinks import write_bucketed


def read_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """``pages(paper_id, page, text)`` to the tables of the library.

    Glyphs are repaired, repeated margins removed, sections built, and references extracted
    from the section texts (one row per section and page, in order).
    """
    cleaned = corpus.remove_margins(pages.withColumn("text", clean_extracted(F.col("text"))))
    cleaned = checkpointed(cleaned)
    chunks = checkpointed(corpus.section_chunks(cleaned))
    sections = corpus.sections(chunks)
    anchors = checkpointed(corpus.anchors(chunks, sections))
    # The heading is no part of a section's text, so it is put back for the list extraction.
    listed = anchors.where(F.col("section_id").rlike("^(references|bibliography)(-[0-9]+)?$"))
    listed = number_rows(listed, ["paper_id"], ["ord", "chunk_no"]).select("paper_id", F.col("rn").alias("ord"), F.concat(F.lit("References\n"), "body").alias("markdown"), "section_id")
    return {"pages": cleaned, "sections": sections, "anchors": anchors, "references": biblio.extract_references(listed)}


def write_library(pages: DataFrame, root: str) -> None:
    """Write the tables of ``read_pages``, bucketed by paper."""
    for name, table in read_pages(pages).items():
        write_bucketed(table, f"{root}/{name}", "paper_id")
