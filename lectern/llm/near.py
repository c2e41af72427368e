"""Near-duplicate groups by BagMinHash over multisets of five-word shingles.

A shingle of multiplicity w takes part in one Poisson process per level up to w; the levels lie in dyadic
intervals, and a point of an interval's process is handed down to one of its levels.  The
least point of each register makes an unbiased signature for weighted Jaccard similarity.
Documents that agree in a band of the signature are candidates; each candidate link is
verified on the whole multisets.  Equal multisets are one node.

A bucket's members are first linked to the one in their middle (linear in its size).  Members that are not in
one group afterwards meet a further hub, and at last all members of other groups: block by block on larger sketches,
of which only pairs near the threshold are verified.  So no candidate pair of different groups is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.memory import settled
from lectern.llm.tokens import mix, span_hashes
from lectern.session import checkpointed, numbered

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Rounds with one hub per bucket before members meet pair by pair.
HUB_ROUNDS = 1
#: Registers of the second sketch, and members compared at a time, of that last step.
SKETCH, BLOCK = 512, 3_000
#: Text bytes handled at a time.
SLICE = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts per text)``: the shingles of each text, one after the other.

    Words are runs of anything but ASCII white space.  A text of fewer than five words is one
    shingle of all its words; one without a word has none.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    last = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    doc = np.searchsorted(last, starts, side="right")
    words = span_hashes(data, starts, ends)
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    count = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    take = np.repeat(np.minimum(n_words, WORDS), count)
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        has = take > k
        h[has] = mix(h[has] * _STEP + words[at[has] + k] + np.uint64(k + 1))
    return h, count


def counted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, shingle, multiplicity)``, sorted by text and shingle."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """The registers of each text: least points of the processes, inf for a text without shingles."""
    registers = np.full(texts * size, np.inf)
    # The processes: interval j holds the levels 2**(j - 1) + 1 .. 2**j, interval 0 the level 1.
    depth = np.ceil(np.log2(weight.astype(np.float64))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(doc)), depth)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
    width = np.maximum(1, 2 ** np.maximum(j - 1, 0)).astype(np.int64)
    below = np.where(j == 0, 0, width)
    own, seed, most = doc[owner], mix(shingle[owner] + j.astype(np.uint64) * _STEP), weight[owner]
    point = np.zeros(len(own))
    limit = np.full(texts, np.inf)
    turn = 0
    while len(own):
        turn += 1
        h = mix(seed + np.uint64(turn * int(_STEP) % 2**64))
        point = point - np.log(_uniform(h)) / width
        live = point < limit[own]
        if not live.all():
            own, seed, most, point, width, below, h = (x[live] for x in (own, seed, most, point, width, below, h))
        g = mix(h ^ _STEP)
        level = below + 1 + ((g >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        inside = level <= most
        at = own * size + ((g & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(registers, at[inside], point[inside])
        limit = registers.reshape(texts, size).max(axis=1)
    return registers.reshape(texts, size)


def bands(registers: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One key per band, different from band to band."""
    bits = registers.view(np.uint64).reshape(len(registers), n, -1)
    key = np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.zeros((len(registers), 1), np.uint64)
    for k in range(bits.shape[2]):
        key = mix(key * _STEP + bits[:, :, k])
    return key.view(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < SLICE):
            size += len(texts[to] or "")
            to += 1
        yield at, [t or "" for t in texts[at:to]]
        at = to


def signed(rows: DataFrame) -> DataFrame:
    """``doc_id, row, n, key_a, key_b, bands`` of ``rows(row, doc_id, text)``: size and 128-bit hash of the multiset, band keys."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in _slices(batch["text"].tolist()):
                h, counts = shingles(texts)
                doc, shingle, weight = counted(h, counts)
                keys = bands(signatures(doc, shingle, weight, len(texts)))
                sums = [np.zeros(len(texts), np.uint64) for _ in range(2)]
                for k, total in enumerate(sums):
                    np.add.at(total, doc, mix(mix(shingle + np.uint64(k)) + weight.astype(np.uint64) * _STEP))
                has = counts > 0
                part = batch.iloc[first : first + len(texts)]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "row": part["row"].array, "n": counts, "key_a": sums[0].view(np.int64), "key_b": sums[1].view(np.int64), "bands": [k if ok else [] for k, ok in zip(keys, has, strict=True)]})

    return rows.select("doc_id", "text", "row").mapInPandas(lambda batches: settled(sign(batches)), f"doc_id {kind}, row long, n long, key_a long, key_b long, bands array<long>")


def multisets(rows: DataFrame) -> DataFrame:
    """``row, items``: each shingle with its occurrence number as one hash, so that the multiset
    overlap of two texts is the overlap of two sets."""
    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in _slices(batch["text"].tolist()):
                doc, shingle, weight = counted(*shingles(texts))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                flat = mix(np.repeat(shingle, weight) + nth.astype(np.uint64) * _STEP).view(np.int64)
                sizes = np.bincount(doc, weights=weight, minlength=len(texts)).astype(np.int64)
                yield pd.DataFrame({"row": batch["row"].iloc[first : first + len(texts)].array, "items": np.split(flat, np.cumsum(sizes)[:-1])})

    return rows.select("row", "text").mapInPandas(lambda batches: settled(items(batches)), "row long, items array<long>")


def verified(edges: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The ``edges(a, b)`` whose multisets overlap by ``least`` or more: sum of minima over sum of maxima."""
    left = edges.join(sets.select(F.col("row").alias("b"), F.col("items").alias("_b")), "b")
    both = left.join(sets.select(F.col("row").alias("a"), F.col("items").alias("_a")), "a")
    common = F.size(F.array_intersect("_a", "_b"))
    total = F.size("_a") + F.size("_b")
    fits = F.least(F.size("_a"), F.size("_b")) >= least * F.greatest(F.size("_a"), F.size("_b"))
    return both.where(fits).where(common >= least * (total - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of the component, by large-star and small-star steps
    on stored tables until nothing changes."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    state, seen = checkpointed(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        state = checkpointed(star(star(state, True), False))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    labels = state.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _hubs(members: DataFrame, turn: int) -> DataFrame:
    """Edges from a hub of each bucket to its members of other groups.

    First the member that meets most others over all buckets, which is the middle of its group; then any other.
    Sizes that rule the similarity out make no edge.
    """
    order = F.struct((-F.col("met") if turn == 0 else F.xxhash64("row", F.lit(turn))).alias("o"), "row", "label", "n")
    hubs = members.groupBy("bucket").agg(F.min(order).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", F.col("h.row").alias("a"), F.col("h.label").alias("_l"), F.col("h.n").alias("_n"))
    return members.join(hubs, "bucket").where((F.col("label") != F.col("_l")) & (F.least("n", "_n") >= SIMILARITY * F.greatest("n", "_n"))).select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")).distinct()


#: How many of the four two-bit fields are alike, by the exclusive or of two bytes.
_EQUAL = np.array([sum((x >> k) & 3 == 0 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def sketches(sets: DataFrame) -> DataFrame:
    """``row, sketch``: two bits of each of ``SKETCH`` registers over the row's multiset, four to a byte."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.iloc[first : first + 200]
                sizes = part["items"].map(len).to_numpy(np.int64)
                flat = np.concatenate([np.asarray(x, np.int64) for x in part["items"]]).view(np.uint64)
                doc = np.repeat(np.arange(len(part)), sizes)
                found = mix(signatures(doc, flat, np.ones(len(flat), np.int64), len(part), SKETCH).view(np.uint64))
                bits = (found & np.uint64(3)).astype(np.uint8).reshape(len(part), -1, 4)
                packed = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
                yield pd.DataFrame({"row": part["row"].array, "sketch": [r.tobytes() for r in packed]})

    return sets.select("row", "items").mapInPandas(lambda batches: settled(sign(batches)), "row long, sketch binary")


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of bucket members in different groups that may be similar enough.

    All members of a bucket are compared, in blocks of bounded size, by sketches of ``SKETCH`` registers; a
    pair whose agreement is over four standard deviations below that of the similarity is no candidate.
    Each pair comes from the first bucket that its members share.
    """
    sizes = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).where("lo <> hi").select("bucket", "_blocks")
    m = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
    mine = m.groupBy("row").agg(F.array_sort(F.collect_list(F.pmod(F.xxhash64("bucket"), F.lit(2147483647)).cast("int"))).alias("marks"))
    signs = checkpointed(sketches(sets.join(mine.select("row"), "row", "left_semi")).join(mine, "row"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = m.select("bucket", "row", "label", "n", "block", other.alias("_o")).select("bucket", F.pmod(F.xxhash64("bucket"), F.lit(2147483647)).cast("int").alias("mark"), F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"), "row", "label", "n", "block")
    agree = 0.25 + 0.75 * SIMILARITY  # two bits agree by chance in a quarter of cases
    least = int(SKETCH * agree - 4 * (SKETCH * agree * (1 - agree)) ** 0.5)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        signs = np.frombuffer(b"".join(right["sketch"]), np.uint8).reshape(len(right), -1)
        rows, labels, n, marks = (right[c].to_numpy() for c in ("row", "label", "n", "marks"))
        found = []
        for r in left.itertuples(index=False):
            near = (labels != r.label) & (np.minimum(n, r.n) >= SIMILARITY * np.maximum(n, r.n))
            if lo == hi:
                near &= rows > r.row
            at = np.flatnonzero(near)
            at = at[_EQUAL[signs[at] ^ np.frombuffer(r.sketch, np.uint8)].sum(axis=1, dtype=np.int64) >= least]
            own = set(r.marks)
            at = at[[next(x for x in marks[i] if x in own) == r.mark for i in at]] if len(at) else at
            found.append(np.stack([np.minimum(rows[at], r.row), np.maximum(rows[at], r.row)], axis=1))
        return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return dealt.join(signs, "row").groupBy("bucket", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, row, class_row, class_id, group_size, kept`` of every row.

    The class is the connected component of verified links; its largest doc_id (then the last row)
    is ``class_id`` and stays.  Texts with equal shingle multisets, texts without words among them, are one
    class in any case.  Nulls count as empty texts, a null doc_id as the least; an empty table gives no row.
    """
    return _groups(numbered(docs.select("doc_id", "text")).select("row", "_doc.doc_id", "_doc.text"))


def _groups(stored: DataFrame) -> DataFrame:
    """``groups`` of the stored ``(row, doc_id, text)``."""
    signs = checkpointed(signed(stored))
    keys = ["key_a", "key_b", "n"]
    nodes = checkpointed(signs.groupBy(*keys).agg(F.max("row").alias("row")))
    members = signs.join(nodes.select("row"), "row").select("row", "n", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    with_sizes = checkpointed(members.join(full, "bucket"))
    shared = checkpointed(with_sizes.drop("c").join(with_sizes.groupBy("row").agg(F.sum("c").alias("met")), "row"))
    wanted = shared.select("row").distinct()
    # Dealt by row at every size: the list of wanted rows grows with the table.
    texts = stored.select("text", "row").join(wanted.hint("merge"), "row")
    sets = checkpointed(multisets(texts))

    tested, links, labels = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        if labels is None:
            grouped = shared.withColumn("label", F.col("row"))
        else:
            grouped = shared.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        pairs = _hubs(grouped, turn) if turn < HUB_ROUNDS else _rest(grouped, sets)
        pairs = checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if turn < HUB_ROUNDS:
                continue
            break
        found = checkpointed(verified(pairs, sets))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)

    named = nodes.withColumnRenamed("row", "class_row")
    if labels is not None:
        named = named.join(labels.select(F.col("node").alias("class_row"), "label"), "class_row", "left").withColumn("class_row", F.coalesce("label", "class_row")).drop("label")
    rows = signs.select("doc_id", "row", *keys).join(named, keys)
    best = rows.groupBy("class_row").agg(F.max(F.struct("doc_id", "row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, "class_row").select("doc_id", "row", "class_row", F.col("_best.doc_id").alias("class_id"), "group_size", (F.col("row") == F.col("_best.row")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns."""
    stored = numbered(docs)
    dropped = checkpointed(_groups(stored.select("row", "_doc.doc_id", "_doc.text")).where(~F.col("kept")).select("row"))
    return stored.join(dropped, "row", "left_anti").select("_doc.*")
