"""Table sinks.  Writes are idempotent: a retried or speculated task rewrites its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from lectern.functions.markup import rows_of_lines, table_lines
from lectern.skew import exploded

BUCKETS = 1024


def with_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _dealt(df: DataFrame, key: str, buckets: int, files: int) -> DataFrame:
    """Rows dealt by (bucket, salt): a bucket lies in ``files`` tasks at most, whatever its size,
    and the salt is of the whole row, so one large paper is spread as well."""
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    salted = with_bucket(df, key, buckets).withColumn("_salt", F.pmod(F.xxhash64(*simple), F.lit(files)))
    return salted.repartition("bucket", "_salt").sortWithinPartitions("bucket", key).drop("_salt")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, fmt: str = "parquet", files: int = 4) -> None:
    """A paper-keyed table in hash buckets of at most ``files`` files each; raise both with the table."""
    _dealt(df, key, buckets, files).write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def bucketed_overwrite(changed: DataFrame, path: str, key: str, buckets: int = BUCKETS, files: int = 4) -> None:
    """Replace only the buckets present in ``changed`` (which holds them whole)."""
    _dealt(changed, key, buckets, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def touched_buckets(table: DataFrame, changes: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the buckets a change feed touches; the rest is neither read further nor rewritten."""
    hit = with_bucket(changes.select(key), key, buckets).select("bucket").distinct()
    return table.join(hit, "bucket", "left_semi")


def write_artifacts(markdown: DataFrame, documents: DataFrame, metadata: DataFrame, references: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Per-paper artifacts as four tables; text is a column, not a file per paper."""
    for name, df in (("markdown", markdown), ("documents", documents), ("metadata", metadata), ("references", references)):
        write_bucketed(df, f"{root}/{name}", "paper_id", min(16, buckets) if name == "metadata" else buckets)


def _rows(tables: DataFrame) -> DataFrame:
    """``table_id, row_no, row``; the lines of a table are cut once."""
    lines = exploded(tables, F.array(table_lines(F.col("markdown"))), "_lines", "table_id")
    return exploded(lines.select("table_id", rows_of_lines(F.col("_lines")).alias("_rows")), "_rows", "row", "table_id", pos="row_no")


def table_cells(tables: DataFrame) -> DataFrame:
    """Markdown tables as ``(table_id, row_no, col_no, value)``."""
    return exploded(_rows(tables), "row", "value", "table_id", "row_no", pos="col_no")


def write_table_csv(tables: DataFrame, path: str) -> None:
    """Rows of all tables as one CSV table: table id, row number, then the cells of the row."""
    rows = _rows(tables)
    line = F.to_csv(F.struct(*[F.coalesce(F.get("row", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(1)]))
    wide = rows.select("table_id", "row_no", F.when(F.size("row") > 1, F.array_join(F.transform("row", quote), ",")).otherwise(line).alias("value"))
    named = F.concat_ws(",", quote(F.col("table_id").cast("string")), F.col("row_no").cast("string"), "value")
    wide.sortWithinPartitions("table_id", "row_no").select(named.alias("value")).write.mode("overwrite").text(path)


def quote(cell):
    """A CSV cell, quoted only when it needs to be."""
    doubled = F.replace(cell, F.lit('"'), F.lit('""'))
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(cell)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
