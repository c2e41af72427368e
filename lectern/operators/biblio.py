"""Bibliography extraction and resolution of references to papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import biblio as B
from lectern.functions.text import normalize_title, reference_id
from lectern.operators.corpus import running_by
from lectern.session import checkpointed
from lectern.skew import GRAM, contains_pairs, exploded, first_rows


def reference_entries(sections: DataFrame) -> DataFrame:
    """``(paper_id, ord, piece, index, raw)`` of every marked entry, before dedup.

    A reference list may run over several sections: text before the first marker of a later
    section belongs to the last entry of the list before it.
    """
    tails = sections.select("paper_id", "ord", B.list_tail(F.col("markdown")).alias("tail")).where("tail is not null")
    # A list is cut once and stored with its section; what runs on from one section to the next is numbers and openings.
    cut = checkpointed(exploded(tails, F.array(B.list_pieces(F.col("tail"))), "pieces", "paper_id", "ord").select(
        "paper_id", "ord", (F.size("pieces") - 1).alias("last_piece"), F.col("pieces")[0]["body"].alias("opening"), F.slice("pieces", F.lit(2), F.size("pieces")).alias("entries")))
    lists = cut.select("paper_id", "ord", "last_piece")
    lists = running_by(lists, ["paper_id"], ["ord"], {"owner": ("last", F.when(F.col("last_piece") > 0, F.col("ord")))}, inclusive=False)
    heads = cut.select("paper_id", "ord", "opening").where(B.raw_entry(F.col("opening")) != "")
    runs = heads.join(lists.where("owner is not null").select("paper_id", "ord", "owner"), ["paper_id", "ord"])
    extra = runs.groupBy("paper_id", F.col("owner").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), F.col("opening").alias("body")))), lambda r: r["body"]), "\n").alias("more")
    )
    full = cut.where("last_piece > 0").drop("opening").join(extra, ["paper_id", "ord"], "left")
    each = full.select("paper_id", "ord", "last_piece", "more", F.posexplode("entries").alias("at", "e")).withColumn("piece", F.col("at") + 1)
    body = F.concat_ws("\n", "e.body", F.when(F.col("piece") == F.col("last_piece"), F.col("more")))
    return exploded(each, F.array(B.raw_entry(body)), "raw", "paper_id", "ord", "piece", "e.index")


def extract_references(sections: DataFrame) -> DataFrame:
    """Bibliography rows of each paper, one per DOI or normalized title, first kept.

    A field is read once for each entry, and what the key does not need is read of kept entries only.
    """
    raw = reference_entries(sections).where(F.length("raw") >= 12)
    fields = exploded(raw, F.array(F.struct(B.title(F.col("raw")).alias("title"), B.doi(F.col("raw")).alias("doi"))), "f", *raw.columns).select(*raw.columns, "f.title", "f.doi")
    keyed = exploded(fields, F.array(B.dedup_key(F.col("doi"), F.col("title"))), "_key", *fields.columns).where("_key <> ''")
    kept = first_rows(keyed, ["paper_id", "_key"], [F.col("ord"), F.col("piece")])
    return kept.select("paper_id", "ord", "piece", "index", reference_id(F.col("raw")).alias("ref_id"), "title", B.authors(F.col("raw")).alias("authors"), B.year(F.col("raw")).alias("year"),
                       "doi", B.arxiv(F.col("raw")).alias("arxiv"), "raw")


def resolve_titles(titles: DataFrame, papers: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(norm, resolved_id)`` for distinct normalized titles that name exactly one paper.

    Exact: one paper has that title.  Else, for 24 characters or more, containment either way
    by exactly one paper.  ``titles(norm)`` is distinct; ``papers(id, title)``.
    """
    index = papers.select("id", normalize_title(F.col("title")).alias("norm")).where("norm <> ''")
    # Distinct titles on both sides feed several joins below; each is computed once.
    named = checkpointed(index.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    looked = checkpointed(titles.where("norm <> ''").join(named, "norm", "left"))
    exact = looked.where("n = 1").select("norm", F.col("lo").alias("resolved_id"))
    rest = looked.where((F.coalesce(F.col("n"), F.lit(0)) != 1) & (F.length("norm") >= 24)).select(F.col("norm").alias("ref"))
    hays = named.select(F.col("norm").alias("name"))
    inside = contains_pairs(rest, hays, "ref", "name", gram)
    around = contains_pairs(hays, rest, "name", "ref", gram).select("ref", "name")
    pairs = inside.unionByName(around)
    hits = pairs.join(named.select(F.col("norm").alias("name"), "lo", "hi"), "name")
    loose = hits.groupBy("ref").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi")
    return exact.unionByName(loose.select(F.col("ref").alias("norm"), F.col("lo").alias("resolved_id")))


def resolve_references(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """References with ``resolved_id``; every distinct title is resolved once."""
    normed = refs.withColumn("norm", normalize_title(F.coalesce(F.col("title"), F.lit(""))))
    resolved = resolve_titles(normed.select("norm").distinct(), papers)
    return normed.join(resolved, "norm", "left").drop("norm")
