"""Structured documents, layout tables and reference-manager exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import metrics


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Structured documents with a fixed schema (no inference pass): a JSON document per file, or per line of larger files."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", not lines).json(path)


def sections_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.explode("sections").alias("s")).select(
        "paper_id", F.col("s.id").alias("section_id"), "s.title", "s.level", F.col("s.order").alias("ord"), "s.page_start", "s.page_end", "s.markdown")


def anchors_of(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("id").alias("paper_id"), F.explode("sections").alias("s"))
    return rows.select("paper_id", F.col("s.id").alias("section_id"), F.posexplode("s.anchors").alias("chunk_no", "a")).select("paper_id", "section_id", "chunk_no", "a.block_id", "a.page", "a.source_text")


def figures_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.explode("figures").alias("f")).select("paper_id", F.col("f.id").alias("figure_id"), "f.caption", "f.page", "f.relative_path", "f.thumbnail_path")


def read_export(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Tables of a reference manager landed as files under one folder."""
    names = ["items", "itemAttachments", "deletedItems", "itemData", "fields", "itemDataValues", "itemCreators", "creators", "collections", "collectionItems"]
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return {n: (reader.schema(schemas.EXPORT[n]) if fmt == "csv" else reader).load(f"{root}/{n}") for n in names}


def field_values(export: dict[str, DataFrame]) -> DataFrame:
    """Entity-attribute-value rows with names: ``(itemID, fieldName, value)``."""
    return export["itemData"].join(export["fields"], "fieldID").join(export["itemDataValues"], "valueID").select("itemID", "fieldName", "value")


def attachment_path(path: Column, key: Column, data_dir: str) -> Column:
    """Where an attachment lies: a stored one in the folder of its key; null for linked base folders, which are not supported."""
    stored = F.concat(F.lit(f"{data_dir}/storage/"), key, F.lit("/"), F.substring(path, F.lit(len("storage:") + 1), F.length(path)))
    return F.when(F.startswith(path, F.lit("storage:")), stored).when(~F.startswith(path, F.lit("attachments:")), path)


def export_items(export: dict[str, DataFrame], data_dir: str, fields: tuple[str, ...] = ("title", "date", "DOI")) -> DataFrame:
    """One row per PDF attachment that is not deleted, with the metadata of its parent item.

    ``authors`` is the JSON list of the creators' names in order and ``collections`` that of the collections' names by id,
    both ``[]`` where an item has none; ``category`` follows from the collections.
    """
    kept = metrics.attachments(export["itemAttachments"], export["items"], export["deletedItems"])
    fields_of = metrics.pivot_fields(field_values(export), list(fields))
    authors = metrics.creator_names(export["itemCreators"], export["creators"]).groupBy("itemID").agg(_in_order("orderIndex", "author").alias("authors"))
    named = export["collectionItems"].select("collectionID", "itemID").join(export["collections"], "collectionID")
    collections = named.groupBy("itemID").agg(_in_order("collectionID", "collectionName").alias("collections"))
    told = fields_of.join(authors, "itemID", "full_outer").join(collections, "itemID", "full_outer").withColumnRenamed("itemID", "parentItemID")
    joined = kept.join(told, "parentItemID", "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return joined.select(
        "attachmentID", "attachmentKey", "itemKey", attachment_path(F.col("path"), F.col("attachmentKey"), data_dir).alias("path"), *fields, metrics.year_of(F.col("date")).alias("year"),
        F.to_json(listed(F.col("authors"))).alias("authors"), F.to_json(listed(F.col("collections"))).alias("collections"), metrics.category(listed(F.col("collections"))).alias("category"))


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value])


def file_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of file events landed as JSON lines."""
    return spark.readStream.schema(schemas.FILE_EVENTS).json(path)


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LAYOUT).parquet(path)
