"""Token ids in compressed binary blocks, written in ascending doc_id order and read back.

The table is range-partitioned by doc_id.  A part is a run of documents; its ids are cut into
blocks of ``BLOCK`` (the last one of a part takes what is left) that are coded independently (``coder``), with a
checksum over the ids.  A block's row
also says which documents lie in it and with how many ids, so any block can be read alone.
The rows are stored by Spark's Parquet writer, which commits whole tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import coder
from lectern.llm.memory import settled
from lectern.llm.tokens import encoder
from lectern.session import checkpointed

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 2048
#: Blocks coded at a time; it bounds the memory and has no part in the format.
LANES = 4096


def blocks(docs: DataFrame, file: str = VOCABULARY, end: int = 0) -> DataFrame:
    """``part, block, n_ids, crc32, payload, docs``: ``docs`` lists ``(ordinal, doc_id, n)`` of the
    documents in the block, ``ordinal`` being the document's place in its part.

    Each text (null counts as empty) is closed by ``end``.  Rows of one doc_id are documents of their own; a
    null doc_id comes first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def coded(part: int, block: int, ids: np.ndarray, ordinals: np.ndarray, names: list, sizes: np.ndarray) -> pd.DataFrame:
        """Rows of the blocks of ``ids``, in which the documents have ``sizes`` ids one after the other."""
        cuts = np.append(np.arange(BLOCK, len(ids), BLOCK), len(ids))
        ends = np.cumsum(sizes)
        points = np.union1d(ends, cuts)
        begin = np.append(0, points[:-1])
        owner, home = np.searchsorted(ends, begin, side="right"), np.searchsorted(cuts, begin, side="right")
        inside = [{"ordinal": o, "doc_id": names[i], "n": n} for i, o, n in zip(owner.tolist(), ordinals[owner].tolist(), (points - begin).tolist(), strict=True)]
        listed = np.cumsum(np.bincount(home, minlength=len(cuts)))
        parts = np.split(ids, cuts[:-1])
        return pd.DataFrame({
            "part": part, "block": np.arange(block, block + len(cuts)), "n_ids": [len(x) for x in parts], "crc32": [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in parts],
            "payload": coder.encode(parts), "docs": [inside[lo:hi] for lo, hi in zip(np.append(0, listed[:-1]).tolist(), listed.tolist(), strict=True)],
        })

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, ordinal, most = 0, 0, 0, BLOCK * LANES
        held, total = [], 0  # ids, ordinals, names, sizes of slices

        def joined() -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
            ids, ordinals, names, sizes = zip(*held, strict=True)
            return np.concatenate(ids), np.concatenate(ordinals), [n for some in names for n in some], np.concatenate(sizes)

        for batch in batches:
            if len(batch):
                part = int(batch["part"].iloc[0])
            for first, more, counts in encoder(file).flat_batches(batch["text"].tolist(), end):
                names = [None if pd.isna(d) else d for d in batch["doc_id"].iloc[first : first + len(counts)].tolist()]
                held.append((more, np.arange(ordinal, ordinal + len(counts)), names, counts))
                ordinal, total = ordinal + len(counts), total + len(more)
                if total < most:
                    continue
                ids, ordinals, names, sizes = joined()
                while len(ids) >= most:
                    ends = np.cumsum(sizes)
                    last = int(np.searchsorted(ends, most))  # the document in which the cut lies, or that ends at it
                    over = int(ends[last]) - most
                    here = np.append(sizes[:last], sizes[last] - over)
                    done = coded(part, block, ids[:most], ordinals[: last + 1], names[: last + 1], here)
                    block += len(done)
                    yield done
                    rest = last if over else last + 1
                    ids, ordinals, names, sizes = ids[most:], ordinals[rest:], names[rest:], sizes[rest:].copy()
                    if over:
                        sizes[0] = over
                held, total = [(ids, ordinals, names, sizes)], len(ids)
        if total:
            yield coded(part, block, *joined())

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    numbered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return numbered.mapInPandas(lambda batches: settled(write(batches)), f"part int, block long, n_ids int, crc32 long, payload binary, docs array<struct<ordinal:long,doc_id:{kind},n:long>>")


def write_ids(docs: DataFrame, path: str, **options) -> None:
    """Write ``blocks`` to a folder that all executors reach."""
    blocks(docs, **options).write.parquet(path)


def pieces(stored: DataFrame) -> DataFrame:
    """``part, block, ordinal, doc_id, ids``: the ids of each document in each block, decoded and checked."""
    kind = stored.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, ids, docs in _decoded(batches):
            sizes = [d["n"] for d in docs]
            yield pd.DataFrame({"part": row.part, "block": row.block, "ordinal": [d["ordinal"] for d in docs], "doc_id": pd.Series([d["doc_id"] for d in docs], dtype=object), "ids": np.split(ids.astype(np.int64), np.cumsum(sizes)[:-1])})

    return stored.mapInPandas(read, f"part int, block long, ordinal long, doc_id {kind}, ids array<bigint>")


def _decoded(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        for first in range(0, len(batch), LANES):
            some = batch.iloc[first : first + LANES]
            for row, ids in zip(some.itertuples(index=False), coder.decode(some["payload"].tolist(), some["n_ids"].tolist()), strict=True):
                if zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) != row.crc32:
                    raise ValueError(f"checksum of block {row.block} in part {row.part} is wrong")
                yield row, ids, row.docs


@lru_cache(maxsize=256)
def _zeros(power: int) -> tuple[int, ...]:
    """The matrix over GF(2) that advances a crc32 by ``2**power`` zero bytes, as 32 columns."""
    if power == 0:
        step = tuple([0xEDB88320] + [1 << n for n in range(31)])  # one bit
        for _ in range(3):
            step = tuple(_times(step, c) for c in step)
        return step
    half = _zeros(power - 1)
    return tuple(_times(half, c) for c in half)


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, n = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[n]
        vector >>= 1
        n += 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other; ``length`` is that of the second."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zeros(power), first)
        length >>= 1
        power += 1
    return first ^ second


def document_digests(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the blocks.

    A document's blocks are decoded wherever they lie; their checksums are joined in order.
    """
    kind = stored.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, ids, docs in _decoded(iter([batch])):
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                for d in docs:
                    rows.append((row.part, row.block, d["ordinal"], d["doc_id"], d["n"], zlib.crc32(raw[4 * at : 4 * (at + d["n"])])))
                    at += d["n"]
            yield pd.DataFrame(rows, columns=["part", "block", "ordinal", "doc_id", "n", "crc"])

    def join(parts: pd.Series) -> pd.Series:
        def one(found) -> int:
            out = 0
            if found is None:  # a document of one piece, whose checksum needs no joining
                return out
            for p in found:
                out = joined_crc(out, p["crc"], 4 * p["n"])
            return out

        return pd.Series([one(p) for p in parts])

    found = stored.mapInPandas(lambda batches: settled(digest(batches)), f"part int, block long, ordinal long, doc_id {kind}, n long, crc long")
    whole = found.groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("_p"))
    crc = F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["crc"]).otherwise(F.pandas_udf(join, "long")(F.when(F.size("_p") > 1, F.col("_p"))))
    docs = checkpointed(whole.select("part", "ordinal", "doc_id", "n_tokens", crc.alias("ids_crc32")))
    # One row per part, in order of doc_id; and a part is a bounded run of documents.
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.withColumn("_inside", inside).join(before, "part").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def round_trip(docs: DataFrame) -> DataFrame:
    """``document_digests`` of the files that ``docs`` has been written to; an empty table gives no row."""
    return document_digests(checkpointed(blocks(docs)))
