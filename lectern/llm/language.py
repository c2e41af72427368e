"""Language identification with bit-sliced Bloom filters of character n-grams.

There is one Bloom filter per language; they are stored sliced, as one bit mask of languages per
position, so a lookup of an n-gram ANDs a few masks and has every language that holds it.  A
text's hits are counted per language, less the false positives that its filter's fill explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.memory import settled
from lectern.llm.tokens import mix
from lectern.session import checkpointed

SIZES = (3, 4)
POSITIONS = 2**18
HASHES = 3
#: Labelled documents per language that a filter is fitted on, at most.
SAMPLE = 2_000
#: An n-gram belongs to a language if this share of its documents holds it.
LEAST_SHARE = 0.01
#: Letters in a row share n-grams, so that many n-grams tell as much as one independent draw.
ALIKE = sum(SIZES)
#: Characters handled at a time.
SLICE = 400_000
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars < size):
            chars += len(texts[to] or "")
            to += 1
        yield at, [t or "" for t in texts[at:to]]
        at = to


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, n-gram hash, letters per text)`` of all n-grams: letters in lower case, anything
    between them one blank, a blank at either end."""
    raw = [f"\n{t.lower()}\n".encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw)))
    letter = letter_table()[codes]
    letters = np.bincount(owner, weights=letter, minlength=len(texts)).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep]
    rows, found = [], []
    for size in SIZES:
        n = max(0, len(codes) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        same = owner[:n] == owner[size - 1 : size - 1 + n]
        rows.append(owner[:n][same])
        found.append(mix(h[same]))
    return np.concatenate(rows), np.concatenate(found), letters


def places(hashes: np.ndarray, positions: int = POSITIONS) -> list[np.ndarray]:
    """The filter positions of each n-gram."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(positions)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """``masks[w, position]``: languages ``64 w .. 64 w + 63`` that have the position set."""

    languages: list[str]
    masks: np.ndarray
    commonest: str | None
    #: Share of a document's n-grams that the filter learned from the other documents of its language holds; 1 where not known.
    usual: tuple[float, ...] = ()

    def false_rates(self) -> np.ndarray:
        fill = [np.mean((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits per (text, language), and letters per text."""
        return self.hits(texts)[:2]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``counts`` and the n-grams per text."""
        rows, hashes, letters = grams(texts)
        total = np.bincount(rows, minlength=len(texts))
        at = places(hashes)
        out = np.zeros((len(texts), len(self.languages)))
        rates = self.false_rates()
        for w in range(len(self.masks)):
            hit = self.masks[w][at[0]]
            for p in at[1:]:
                hit = hit & self.masks[w][p]
            some = np.flatnonzero(hit)
            hit, row = hit[some], rows[some]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                has = (hit >> np.uint64(i % 64)) & np.uint64(1)
                out[:, i] = np.bincount(row, weights=has.astype(np.float64), minlength=len(texts))
        return np.maximum(0, (out - total[:, None] * rates) / (1 - rates).clip(1e-9)), letters, total


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from ``labelled(doc_id, text, lang)``: the ``sample`` documents of each language
    that come first by a hash of their id (and those that tie with the last).  What reaches the driver is bounded by the number of positions."""
    hashed = labelled.where("lang is not null and text is not null").withColumn("_h", F.xxhash64("doc_id"))
    first = hashed.select("lang", "_h").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= sample)
    # One row per language; the texts are then chosen where they are read, without a shuffle.
    told = {r["lang"]: r for r in first.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("_h").alias("last")).collect()}
    sizes, languages = {name: r["n"] for name, r in told.items()}, sorted(told)
    if not languages:
        return Filters([], np.zeros((0, POSITIONS), np.uint64), None)
    last = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(told[name]["last"]))])
    chosen = hashed.where(F.col("_h") <= last[F.col("lang")]).select("doc_id", "text", "lang")

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in slices(batch["text"].tolist()):
                rows, hashes, _ = grams(texts)
                lang = batch["lang"].iloc[first : first + len(texts)].to_numpy()
                pairs = pd.DataFrame({"row": rows, "gram": hashes.view(np.int64)}).drop_duplicates()
                yield pairs.assign(lang=lang[pairs["row"]], n=1).groupby(["lang", "gram"], as_index=False)["n"].sum()[["lang", "gram", "n"]]

    counted = checkpointed(chosen.mapInPandas(collect, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    least = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(max(1.0, min(2.0, sizes[name]), LEAST_SHARE * sizes[name])))])

    # A document's n-gram that n documents hold is in n - 1 others.
    others = counted.groupBy("lang").agg((F.sum(F.when(F.col("n") - 1 >= least[F.col("lang")], F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    usual = {r["lang"]: r["share"] for r in others.collect()}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["gram"].to_numpy(np.int64).view(np.uint64)
            bit = np.left_shift(np.uint64(1), (batch["i"].to_numpy() % 64).astype(np.uint64)).view(np.int64)
            for p in places(hashes):
                yield pd.DataFrame({"word": batch["i"] // 64, "position": p, "mask": bit})

    kept = counted.where(F.col("n") >= least[F.col("lang")]).select("gram", number[F.col("lang")].alias("i"))
    masks = np.zeros((-(-len(languages) // 64), POSITIONS), np.uint64)
    for r in kept.mapInPandas(spread, "word long, position long, mask long").groupBy("word", "position").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        masks[r["word"], r["position"]] = np.uint64(r["mask"] % 2**64)
    return Filters(languages, masks, max(languages, key=lambda x: (sizes[x], x)), tuple(usual.get(name) or 0.0 for name in languages))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score, share, grams`` and every other column of ``docs`` in ``_doc`` when it has that.

    ``share`` is the part of the text's ``grams`` n-grams that the filter of ``lang_pred`` holds, against what it
    holds of a text of its language usually; unlike ``score`` it does not depend on the other languages.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing
    was learned.  A text whose n-grams are in no filter gets the commonest language with
    score 0.  Equal counts go to the first language in order.  Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS masks for each 64 languages

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in settled(batches):
            parts = [pd.DataFrame({"lang": pd.Series([], dtype=str), "score": pd.Series([], dtype=float), "share": pd.Series([], dtype=float), "grams": pd.Series([], dtype=np.int64)})]
            for _, texts in slices(batch.tolist()):
                if not known.languages:
                    parts.append(pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "share": 0.0, "grams": 0}))
                    continue
                counts, letters, grams_in = known.hits(texts)
                best = counts.argmax(axis=1)
                top, total = counts.max(axis=1), counts.sum(axis=1)
                lang = np.array(known.languages, object)[best]
                lang[top == 0] = known.commonest
                lang[letters == 0] = "und"
                usual = np.array(known.usual or [1.0] * len(known.languages))[best]
                share = np.where(usual > 0, top / (grams_in * usual).clip(1e-9), 1.0)
                parts.append(pd.DataFrame({"lang": lang, "score": np.where((letters > 0) & (total > 0), top / total.clip(1e-9), 0.0), "share": share, "grams": grams_in}))
            yield pd.concat(parts, ignore_index=True)

    guessed = F.pandas_udf(guess, "lang string, score double, share double, grams long")
    carried = [c for c in docs.columns if c == "_doc"]
    out = docs.select("doc_id", guessed(F.col("text")).alias("_g"), *carried)
    return out.select("doc_id", F.col("_g.lang").alias("lang_pred"), F.col("_g.score").alias("score"), F.col("_g.share").alias("share"), F.col("_g.grams").alias("grams"), *carried)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.select("doc_id", "text", "lang").where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, filters: Filters, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known: a letter at least, and a ``share`` in the
    best language that is not below ``least`` by more than three standard deviations of so short a text."""
    out = predict(docs.select("doc_id", "text", F.struct("*").alias("_doc")), filters)
    slack = 3 * F.sqrt(F.lit(ALIKE * least * (1 - least)) / F.greatest("grams", F.lit(1)))
    return out.where((F.col("lang_pred") != "und") & (F.col("share") >= least - slack)).select("_doc.*")
