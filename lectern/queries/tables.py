"""The driver tables, and library tables that Spark derives from them.

The library model (papers, files, jobs, sections, layout, ...) is laid over the star schema:
every derived row comes from driver rows, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_blocks(df: DataFrame) -> DataFrame:
    """Blocks for running aggregates over event time: hours."""
    return df.withColumn("_hour", F.date_trunc("hour", "ts"))


EVENT_BLOCKS = ["_hour"]

# Oracle building blocks.  WS is the regex class of whitespace used by the library.
WS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
STRIP = rf"^{WS}+|{WS}+$"


def sql_strip(value: str) -> str:
    return f"regexp_replace({value}, '{STRIP}', '', 'g')"


def sql_norm(value: str) -> str:
    """Title normal form in SQL."""
    return f"trim(regexp_replace(replace(lower({value}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def line_key() -> list[str]:
    """A total order over the lines of an order (line numbers repeat)."""
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of one paper, with a running header and page number."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# Library of "), "source", F.lit(" vol "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nPage "), F.col("doc_id").cast("string"))
    return d.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page"), text.alias("text"))


SOURCE_PAGES = "SELECT source AS paper_id, doc_id AS page, '# Library of ' || source || ' vol ' || doc_id || chr(10) || text || chr(10) || 'Page ' || doc_id AS text FROM documents"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section whose lines are paragraphs."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("section_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))


def status_of(state: Column, key: Column) -> Column:
    return (
        F.when(state == "F", "READY").when(state == "O", F.when(key % 2 == 0, "QUEUED").otherwise("CANCELLED"))
        .when(key % 3 == 0, "MISSING").when(key % 3 == 1, "PARTIAL").otherwise("FAILED"))


STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderstatus = 'O' THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'QUEUED' ELSE 'CANCELLED' END) WHEN o_orderkey % 3 = 0 THEN 'MISSING' WHEN o_orderkey % 3 = 1 THEN 'PARTIAL' ELSE 'FAILED' END"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("title"),
        status_of(F.col("o_orderstatus"), F.col("o_orderkey")).alias("status"), F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("/library/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("source_path"),
        (price > 300000).alias("is_favorite"), F.when(price > 300000, F.col("o_orderdate")).alias("favorited_at"),
        F.when(price > 200000, F.col("o_orderdate")).alias("last_read_at"), F.col("o_custkey").alias("collection_id"), price.alias("price"),
    )


PAPERS = f"""SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title, {STATUS} AS status, o_orderdate AS created_at,
  '/library/' || o_custkey || '/' || o_orderkey || '.pdf' AS source_path, o_totalprice > 300000 AS is_favorite,
  CASE WHEN o_totalprice > 300000 THEN o_orderdate END AS favorited_at, CASE WHEN o_totalprice > 200000 THEN o_orderdate END AS last_read_at,
  o_custkey AS collection_id, o_totalprice AS price FROM orders"""
