"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents become pieces of at most ``part`` ids (whole windows where a document fills them).
Pieces are dealt at random into groups of bounded size; in a group the two partial partitions
with the largest imbalance are merged with opposing order until one is left, which gives
near-equal windows.  If a window exceeds the capacity, the group is packed again with more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.memory import settled
from lectern.llm.tokens import encoder
from lectern.session import checkpointed

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Ids that one group holds, about: bounds the memory and time of a packing task.
GROUP_TOKENS = 1_000_000


def token_pieces(docs: DataFrame, file: str = VOCABULARY, end: int = 1, capacity: int = CAPACITY, part: int | None = None, drops_space: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: every id of a document, closed by
    ``end``, lies in one piece.

    A null or empty text is one piece with the end id only.  Each row is a document of its own, so repeated
    rows give repeated pieces; a null ``doc_id`` stays null.  An empty table gives no piece.
    """
    width = part or capacity // 4
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(file, drops_space)
        for batch in batches:
            keys = batch["doc_id"]
            for first, ids, counts in enc.flat_batches(batch["text"].tolist(), end):
                whole = counts // capacity
                rest = counts - whole * capacity
                pieces = whole + -(-rest // width)
                row = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(nth < whole[row], nth * capacity, whole[row] * capacity + (nth - whole[row]) * width)
                length = np.minimum(np.where(nth < whole[row], capacity, width), counts[row] - start)
                at = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": keys.iloc[first + row].array, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": counts[row]})

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInPandas(lambda batches: settled(cut(batches)), schema)


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """Window (0 .. k-1) of each item by largest differencing over ``k``-way partial partitions.

    A partial partition keeps its non-empty windows only, as sums less its smallest window.
    """
    n = len(lengths)
    left, right = [np.full(n, -1, np.int64)], [np.full(n, -1, np.int64)]
    made = n
    heap = [(-int(v), i, np.array([v], np.int64), np.array([i], np.int64)) for i, v in enumerate(lengths)]
    if k == 1:
        return np.zeros(n, np.int64)
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        b, b_nodes = b[::-1], b_nodes[::-1]
        over = max(0, len(a) + len(b) - k)
        alone = len(a) - over
        joined = np.arange(made, made + over)
        made += over
        left.append(a_nodes[alone:])
        right.append(b_nodes[:over])
        sums = np.concatenate([a[:alone], a[alone:] + b[:over], b[over:]])
        nodes = np.concatenate([a_nodes[:alone], joined, b_nodes[over:]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), tie, sums, nodes))
        tie += 1
    lefts, rights = np.concatenate(left), np.concatenate(right)
    window = np.full(made, -1, np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(made - 1, n - 1, -1):
        window[lefts[node]] = window[rights[node]] = window[node]
    return window[:n]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(window, offset)`` of each item; windows hold at most ``capacity``."""
    window = np.empty(len(lengths), np.int64)
    full = lengths >= capacity
    rest = np.flatnonzero(~full)
    k = 0
    if len(rest):
        items = lengths[rest]
        k = -(-int(items.sum()) // capacity)
        while True:
            found = differencing(items, k)
            if np.bincount(found, weights=items, minlength=k).max() <= capacity:
                break
            k += max(1, k // 400)
        window[rest] = found
    window[full] = k + np.arange(int(full.sum()))
    order = np.argsort(window, kind="stable")
    sizes, offset = lengths[order], np.empty(len(lengths), np.int64)
    run = np.cumsum(sizes) - sizes
    new = np.concatenate([[True], np.diff(window[order]) > 0])
    offset[order] = run - np.repeat(run[new], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])))
    return window, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and a gapless ``offset`` in it; ``pieces`` has to be a stored table.

    Pieces go to a group by a hash of (doc_id, start), so a long document is spread as well.
    The order within a group is by content, so a repeated or recovered run gives equal windows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    names = [*pieces.columns, "sequence_id", "offset"]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        window, offset = pack_group(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.assign(sequence_id=pdf["_group"].iloc[0] * 2**32 + window, offset=offset)[names]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place; ids themselves come from ``sequences``."""
    return pack(checkpointed(token_pieces(docs, capacity=capacity)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, file: str = VOCABULARY, end: int = 1, drops_space: bool = True) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: the packed windows themselves, for unique doc_ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, ids, counts in encoder(file, drops_space).flat_batches(batch["text"].tolist(), end):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[first : first + len(counts)].array, "_ids": np.split(ids.astype(np.int64), np.cumsum(counts)[:-1])})

    ids = docs.select("doc_id", "text").mapInPandas(encode, f"doc_id {kind}, _ids array<bigint>")
    part = F.slice("_ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    cut = placed.join(ids, "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    rows = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
