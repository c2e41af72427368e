"""Filter interaction audit over a table-driven byte transducer.

``measure`` reads every text once, as UTF-8 bytes, through a finite-state machine given by three tables (class of
a byte, next state, what a step emits) and puts the word spans it opens and closes into a hash table whose hits are
checked byte by byte.  Filters are judgements on these figures; ``audit`` counts what each removes in every order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

SPACE, PLAIN, CAPITAL, SYMBOL, REST, END = range(6)
GAP, WORD = range(2)
OPENS, CLOSES, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16


def byte_classes() -> np.ndarray:
    """Class of each byte: white space, word, A-Z, symbol, second and later bytes of a character, end of a text."""
    table = np.full(256, PLAIN, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[[ord(c) for c in "#$%&*|"]] = SYMBOL
    table[0x80:0xC0] = REST
    table[0xFF] = END  # never in UTF-8: stands after every text
    return table


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state of a class (the same from either state), and what a step from state s on class k emits, at s * 6 + k."""
    after = np.array([GAP, WORD, WORD, WORD, WORD, GAP], np.uint8)
    emits = np.zeros((2, 6), np.uint8)
    for state, kind in itertools.product((GAP, WORD), range(6)):
        emits[state, kind] = (
            (OPENS if state == GAP and after[kind] == WORD else 0) | (CLOSES if state == WORD and after[kind] == GAP else 0)
            | (IS_CAPITAL if kind == CAPITAL else 0) | (IS_POINT if kind not in (REST, END) else 0) | (IS_SYMBOL if kind == SYMBOL else 0)
        )
    return after, emits.ravel()


CLASSES = byte_classes()
AFTER, EMITS = transitions()
CHUNK = 1 << 20
LONG = 256
PAD = bytes(8)


class Spans:
    """Word spans of a run of texts, put into one open hash table; ``first`` marks the first of equal words of a text.

    Words are read as limbs of 8 bytes.  All spans that are not placed yet go for their slot at once: an empty slot takes
    one of them, a slot whose owner is the same word (same text, same length, same bytes) makes a span a
    repeat, and the others go on to the next slot.
    """

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, text: np.ndarray):
        self.data, self.starts, self.text = data, starts, text
        self.size = ends - starts
        self.limbs = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.head = self._limb(np.arange(len(starts)), 0)
        self.first = self._insert(self._hashes())

    def _limb(self, which: np.ndarray, k: int) -> np.ndarray:
        over = np.minimum(self.size[which] - 8 * k, 8)
        return self.limbs[self.starts[which] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - over) * 8).astype(np.uint64))

    def _hashes(self) -> np.ndarray:
        mix = np.uint64(0x9E3779B97F4A7C15)
        h = (self.head ^ (self.text.astype(np.uint64) << np.uint64(32)) ^ self.size.astype(np.uint64)) * mix
        live, k = np.flatnonzero((self.size > 8) & (self.size <= LONG)), 1
        while len(live):
            h[live] = (h[live] ^ (h[live] >> np.uint64(29)) ^ self._limb(live, k)) * mix
            k += 1
            live = live[self.size[live] > 8 * k]
        for i in np.flatnonzero(self.size > LONG):
            digest = hashlib.blake2b(self._bytes(i), digest_size=8).digest()
            h[i : i + 1] = (h[i : i + 1] ^ np.frombuffer(digest, "<u8")) * mix
        return h ^ (h >> np.uint64(32))

    def _bytes(self, i: int) -> memoryview:
        return memoryview(self.data)[self.starts[i] : self.starts[i] + self.size[i]]

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] are the same word of the same text, by all their bytes."""
        same = (self.head[a] == self.head[b]) & (self.size[a] == self.size[b]) & (self.text[a] == self.text[b])
        live, k = np.flatnonzero(same & (self.size[a] > 8) & (self.size[a] <= LONG)), 1
        while len(live):
            good = self._limb(a[live], k) == self._limb(b[live], k)
            same[live[~good]] = False
            k += 1
            live = live[good & (self.size[a[live]] > 8 * k)]
        for i in np.flatnonzero(same & (self.size[a] > LONG)):
            same[i] = self._bytes(a[i]) == self._bytes(b[i])
        return same

    def _insert(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        bits = max(4, int(2 * n).bit_length())
        mask = (1 << bits) - 1
        slots = np.full(1 << bits, -1, np.int32)
        first = np.zeros(n, bool)
        waiting = np.arange(n, dtype=np.int32)
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(waiting):
            owner = slots[at]
            free = owner < 0
            slots[at[free]] = waiting[free]
            owner = slots[at]
            placed = owner == waiting
            first[waiting[placed]] = True
            others = np.flatnonzero(~placed)
            others = others[~self._equal(waiting[others], owner[others])]
            waiting, at = waiting[others], (at[others] + 1) & mask
        return first


def transduce(texts: Sequence[bytes]) -> tuple[Spans, dict[str, np.ndarray]]:
    """One pass over texts laid end to end: figures of every text, and its word spans."""
    data = b"\xff".join([*texts, PAD])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]]
    kinds = CLASSES[raw]
    state = np.empty(len(raw), np.uint8)
    state[0], state[1:] = GAP, AFTER[kinds[:-1]]
    emits = EMITS[state * np.uint8(6) + kinds]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, bounds), prepend=0)

    starts, ends = np.flatnonzero(emits & OPENS), np.flatnonzero(emits & CLOSES)
    words = per_text(starts)
    spans = Spans(data, starts, ends, np.repeat(np.arange(len(texts)), words))
    no_point = per_text(np.flatnonzero((emits & IS_POINT) == 0))
    figures = {
        "n_words": words, "n_distinct": np.bincount(spans.text[spans.first], minlength=len(texts)), "n_capitals": per_text(np.flatnonzero(emits & IS_CAPITAL)),
        "n_points": np.diff(bounds, prepend=0) - no_point, "n_symbols": per_text(np.flatnonzero(emits & IS_SYMBOL)),
    }
    return spans, figures


FIGURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def _long_text(text: memoryview) -> list[int]:
    """Figures of one text that is longer than a chunk, piece by piece; pieces end where a word does, or a character."""
    seen: set[bytes] = set()
    total = dict.fromkeys(FIGURES, 0)
    start = 0
    while start < len(text):
        stop = min(start + CHUNK, len(text))
        if stop < len(text):
            gaps = np.flatnonzero(CLASSES[np.frombuffer(text[start:stop], np.uint8)] == SPACE)
            while not len(gaps) and stop < len(text):  # one word longer than a chunk
                stop = min(stop + CHUNK, len(text))
                gaps = np.flatnonzero(CLASSES[np.frombuffer(text[stop - CHUNK if stop - CHUNK > start else start : stop], np.uint8)] == SPACE)
                if len(gaps):
                    gaps = gaps + (max(stop - CHUNK, start) - start)
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
        spans, figures = transduce([bytes(text[start:stop])])
        for name in FIGURES:
            total[name] += int(figures[name][0])
        seen.update(bytes(spans._bytes(i)) for i in np.flatnonzero(spans.first))
        start = stop
    total["n_distinct"] = len(seen)
    return [total[name] for name in FIGURES]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("_text"))
        out = np.zeros((batch.num_rows, len(FIGURES)), np.int64)
        digests: list[bytes] = []
        run: list[bytes] = []
        begin, held = 0, 0

        def flush(run: list[bytes], begin: int, out: np.ndarray = out) -> None:
            if run:
                figures = transduce(run)[1]
                for k, name in enumerate(FIGURES):
                    out[begin : begin + len(run), k] = figures[name]

        for i, value in enumerate(column):
            text = memoryview(value.as_buffer())
            digests.append(hashlib.sha256(text).digest())
            if len(text) > CHUNK:
                flush(run, begin)
                out[i] = _long_text(text)
                run, begin, held = [], i + 1, 0
                continue
            run.append(bytes(text))
            held += len(text)
            if held >= CHUNK:
                flush(run, begin)
                run, begin, held = [], i + 1, 0
        flush(run, begin)
        kept = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != "_text"]
        names = [f.name for f in batch.schema if f.name != "_text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.binary()), *(pa.array(out[:, k]) for k in range(len(FIGURES)))], names=[*names, "digest", *FIGURES])


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``digest`` (SHA-256 of the text) and the figures of every row; a null text is an empty one.

    Words are maximal runs of bytes other than white space, told apart by case.
    """
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    kept = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(_measured, f"{kept}{', ' if kept else ''}digest binary, " + ", ".join(f"{name} long" for name in FIGURES))


def rules() -> dict[str, Column]:
    """The filters that look at one text, by letter: true where it fails.  The repeat filter needs the table."""
    n = F.col
    return {
        "A": n("n_words") < 100, "B": n("n_distinct") * 100 < n("n_words") * 80,
        "C": n("n_capitals") * 100 > n("n_points") * 10, "D": n("n_symbols") > 0,
    }


REPEAT = "E"


def profiles(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, good, toxic, docs``: how many rows of a part fail exactly these filters.

    ``fails`` has one bit per filter in the order of the letters, the repeat filter last.  Rows of one digest are counted by
    what else tells them apart before they meet, so a text that a third of all rows hold is a few rows.
    """
    bits = F.lit(0)
    for k, rule in enumerate(rules().values()):
        bits = bits + F.when(rule, 1 << k).otherwise(0)
    rows = measured.select("doc_id", "digest", "part", bits.cast("int").alias("fails"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    with_id = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    without = rows.where(F.col("doc_id").isNull()).select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    told = ["digest", "part", "fails", "good", "toxic"]
    known = with_id.groupBy("doc_id", *told).agg(F.count(F.lit(1)).alias("n"))
    grouped = known.groupBy(*told).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    nameless = without.groupBy(*told).agg(F.count(F.lit(1)).alias("n")).select(*told, "n", F.lit(None).cast(grouped.schema["least"].dataType).alias("least"), F.col("n").alias("at_least"))
    lowest = grouped.groupBy("digest").agg(F.min("least").alias("lowest"))
    judged = grouped.join(lowest, "digest").withColumn("stays", F.when(F.col("least") == F.col("lowest"), F.col("at_least")).otherwise(0)).drop("lowest").unionByName(nameless.withColumn("stays", F.col("n")))
    repeat = 1 << len(rules())
    split = F.inline(F.array(
        F.struct(F.col("fails").alias("f"), F.col("stays").alias("docs")), F.struct((F.col("fails") + repeat).alias("f"), (F.col("n") - F.col("stays")).alias("docs"))))
    counted = judged.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), split)
    return counted.groupBy("part", F.col("f").alias("fails"), "good", "toxic").agg(F.sum("docs").alias("docs"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes in every order, per part (value of ``lang``; null: empty string).

    One row per part, order and step, zeros included: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    A row without doc_id is neither smaller nor larger than any, so it is never a repeat and makes none; rows with one
    doc_id are not smaller than each other.  Several labels of a doc_id: good or toxic if one says so; labels without doc_id
    are of no document.  An empty table gives no row.  Only the named columns of either table are read.
    """
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    seen = profiles(checkpointed(measure(rows, "doc_id", "part")), labels.select("doc_id", "quality", "toxic"))
    letters = [*rules(), REPEAT]
    orders = ["".join(p) for p in itertools.permutations(letters)]
    known = F.create_map(*[x for k, letter in enumerate(letters) for x in (F.lit(letter), F.lit(1 << k))])
    steps = seen.select("*", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    own = known[F.substring("filter_order", F.col("step"), F.lit(1))]
    earlier = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda s, k: s + F.when(k > 0, known[F.substring("filter_order", k, F.lit(1))]).otherwise(0))
    placed = steps.withColumn("own", own).withColumn("earlier", earlier)
    f, own, earlier = F.col("fails"), F.col("own"), F.col("earlier")
    fails, gone = f.bitwiseAND(own) > 0, f.bitwiseAND(earlier) > 0
    here = fails & ~gone
    total = lambda when: F.sum(F.when(when, F.col("docs")).otherwise(0))
    ways = F.lit(len(orders)) / F.bit_count(f)
    return placed.groupBy("part", "filter_order", "step").agg(
        total(f.bitwiseAND(own + earlier) == 0).alias("kept"), total(here).alias("removed"), total(fails & gone).alias("redundant"), total(f == own).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("docs") * ways.cast("long")).otherwise(0)).alias("shapley"),
    )
