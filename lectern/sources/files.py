"""File listings: metadata first, content only for files that need it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mark of a page object (any byte but s follows) and of encryption.
PAGE_MARK, ENCRYPTED = b"/Type /Page", b"/Encrypt"
PAGE = re.compile(PAGE_MARK + rb"[^s]", re.DOTALL)
#: Bytes of a file held at a time.
CHUNK = 8 << 20


def list_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """All files below a folder with the suffix (any case); contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").endswith(suffix)).select("path", F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("modified_at_ns"))


def read_changed(changed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Digest and page inventory of the changed files: ``path, size_bytes, sha256, page_count, encrypted``.

    The tasks that hold the paths open the files themselves and read them a chunk at a time, so neither paths nor
    contents pass the driver, a file of any size takes one chunk of memory, and a lost task repeats its own files only.
    A file that is gone by then has nulls.  Paths are dealt into ``tasks`` (else four per core), as their few bytes
    tell nothing of the work.
    """
    spark = changed.sparkSession
    dealt = changed.select("path").distinct().repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame([(path, *inspect(path))], columns=["path", "size_bytes", "sha256", "page_count", "encrypted"]).astype({"size_bytes": "Int64", "page_count": "Int32", "encrypted": "boolean"})

    return dealt.mapInPandas(read, "path string, size_bytes long, sha256 string, page_count int, encrypted boolean")


def inspect(path: str, chunk: int = CHUNK) -> tuple[int | None, str | None, int | None, bool | None]:
    """``inventory`` of one file, from its chunks: what a mark may reach over a chunk's end is looked at with the next."""
    system, at = (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)) if re.match(r"file:|/", path) else fs.FileSystem.from_uri(quote(path, safe=":/@"))
    digest, size, pages, encrypted, rest = hashlib.sha256(), 0, 0, False, b""
    try:
        with system.open_input_stream(at) as stream:
            while piece := stream.read(chunk):
                digest.update(piece)
                size += len(piece)
                body, end = rest + piece, 0
                for found in PAGE.finditer(body):
                    pages, end = pages + 1, found.end()
                encrypted = encrypted or ENCRYPTED in body
                rest = body[max(end, len(body) - len(PAGE_MARK)):]
    except FileNotFoundError:
        return None, None, None, None
    return size, digest.hexdigest(), max(1, pages), encrypted


def inventory(files: DataFrame) -> DataFrame:
    """``sha256``, page count (page objects, at least one) and encryption of each file."""
    body = F.decode("content", "ISO-8859-1")
    pages = F.greatest(F.lit(1), F.regexp_count(body, F.lit(r"(?s)/Type /Page[^s]")))
    return files.select("path", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), pages.alias("page_count"), F.contains(body, F.lit("/Encrypt")).alias("encrypted"))


def inventory_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("page_count").cast("long").alias("pages"), F.sum("size_bytes").cast("long").alias("bytes"), F.count_if("encrypted").alias("encrypted"))
