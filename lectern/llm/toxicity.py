"""Toxicity as an ordinal grade: cumulative-link regression on sparse counts of words and word beginnings.

One weight vector serves all ordered thresholds: ``P(grade > k) = s(w x - t_k)`` with ``t_0 <
t_1 < ...``; the expected severity is the sum of these.  Features are the words that labelled
documents show to be tied to the label; the fit uses a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

#: Labelled documents used, and words kept, at most.
SAMPLE = 8_000
FEATURES = 256
#: Least strength (in standard errors of the log odds) and least count of a feature among graded documents.
STRENGTH, LEAST_DOCS = 4.0, 3
#: Lengths of the word beginnings that are features besides whole words: they catch inflected and compound words.
BEGINNINGS = range(4, 9)
#: Words whose features a worker remembers.
REMEMBERED = 300_000
#: Uses of tell-tale words from which a document of a two-grade label counts as severe.
SEVERE_USES = 3
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` per row of ``measures`` and threshold."""
        return 1 / (1 + np.exp(-((x @ self.weights)[:, None] - self.thresholds)))


class Features(dict):
    """The numbers of the features in a word, remembered."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.places = {w: i for i, w in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = [word, *[word[:n] + "*" for n in BEGINNINGS if n < len(word)]]
        found = tuple(self.places[n] for n in names if n in self.places)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def measures(texts: list[str | None], features: Features) -> np.ndarray:
    """Per text: log of each feature's count, and of its count among 200 words."""
    out = np.zeros((len(texts), len(features.places)))
    lengths = np.zeros(len(texts))
    for row, text in enumerate(texts):
        words = _WORD.findall((text or "").lower())
        lengths[row] = len(words)
        for at in chain.from_iterable(map(features.__getitem__, words)):
            out[row, at] += 1
    return np.concatenate([np.log1p(out), np.log1p(200 * out / (lengths[:, None] + 50))], axis=1)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, steps: int = 600, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood (Adam, thresholds as a start and log gaps)."""
    k = int(grades.max(initial=0))
    if k == 0 or not len(x):
        return np.zeros(x.shape[1]), np.array([10.0])
    free = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(k - 1)])
    m, v, n = np.zeros_like(free), np.zeros_like(free), x.shape[1]
    for step in range(1, steps + 1):
        gaps = np.exp(free[n + 1 :])
        t = free[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-((x @ free[:n])[:, None] - t)))
        full = np.concatenate([np.ones((len(x), 1)), p, np.zeros((len(x), 1))], axis=1)
        slope = full * (1 - full)
        rows = np.arange(len(x))
        mass = (full[rows, grades] - full[rows, grades + 1]).clip(1e-9)
        by_eta = (slope[rows, grades] - slope[rows, grades + 1]) / mass
        by_t = np.zeros((len(x), k + 2))
        by_t[rows, grades] -= slope[rows, grades] / mass
        by_t[rows, grades + 1] += slope[rows, grades + 1] / mass
        each = by_t[:, 1:-1].mean(axis=0)
        up = np.concatenate([x.T @ by_eta / len(x) - decay * free[:n], [each.sum()], gaps * np.cumsum(each[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up**2
        free = free + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n], free[n] + np.concatenate([[0.0], np.cumsum(np.exp(free[n + 1 :]))])


def beginnings(names: Column, n: int) -> Column:
    longer = F.filter(names, lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on ``labels(doc_id, grade)`` with grades 0, 1, ...; null grades are left out.

    The ``sample`` rows that come first by a hash of the id are used; being so few they are broadcast.  Where the labels have two grades only,
    grade 1 is split at ``SEVERE_USES`` uses of tell-tale words.
    """
    labelled = labels.where("grade is not null and doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = checkpointed(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labelled.select("doc_id", F.col("grade").cast("int").alias("grade"))), "doc_id"))
    bad = F.col("grade") > 0
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()
    n_bad, n_good = sizes["bad"], sizes["n"] - sizes["bad"]
    names = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    begun = F.flatten(F.array(names, *[beginnings(names, n) for n in BEGINNINGS]))
    words = F.explode(F.array_distinct(begun)).alias("word")
    counted = rows.select(bad.alias("bad"), words).groupBy("word").agg(F.sum(F.col("bad").cast("int")).alias("b"), F.sum((~F.col("bad")).cast("int")).alias("g"))
    b, g = F.col("b") + 0.5, F.col("g") + 0.5
    odds = F.log(b / (n_bad + 0.5 - F.col("b") + 0.5)) - F.log(g / (n_good + 0.5 - F.col("g") + 0.5))
    strength = odds / F.sqrt(1 / b + 1 / g)
    best = counted.where((F.col("b") >= LEAST_DOCS)).withColumn("z", strength).where(F.col("z") >= STRENGTH).orderBy(F.desc("z"), "word").limit(features)
    vocabulary = [r["word"] for r in best.collect()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = measures(batch["text"].tolist(), Features(vocabulary))
            at = [np.flatnonzero(r) for r in x]
            yield pd.DataFrame({"grade": batch["grade"], "at": [a.tolist() for a in at], "n": [r[a].tolist() for r, a in zip(x, at, strict=True)]})

    # One short row for each sampled document: bounded by the sample.
    found = rows.select("text", "grade").mapInPandas(count, "grade int, at array<int>, n array<double>").collect() if vocabulary else []
    x, grades = np.zeros((len(found), 2 * len(vocabulary))), np.array([r["grade"] for r in found], int)
    for i, r in enumerate(found):
        x[i, r["at"]] = r["n"]
    if grades.max(initial=0) == 1:
        grades = grades + ((grades == 1) & (np.expm1(x[:, : len(vocabulary)]).sum(axis=1) >= SEVERE_USES))
    weights, thresholds = fit_ordinal(x, grades)
    return Model(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: Model, toxic: float = 0.5) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` of every row.

    ``severity`` is the expected grade, ``grade`` the number of thresholds that are more likely
    passed than not, ``p_toxic`` the probability of any grade above 0.  Null and empty texts have no
    features.  Whole texts are read; rows are scored alone, so repeated rows and null ids change nothing.
    """
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(model.words)
        for texts in batches:
            p = model.above(measures(texts.tolist(), features))
            yield pd.DataFrame({"severity": p.sum(axis=1), "grade": (p >= 0.5).sum(axis=1), "p_toxic": p[:, 0]})

    rated = F.pandas_udf(rate, "severity double, grade long, p_toxic double")
    out = docs.select("doc_id", rated(F.col("text")).alias("_r")).select("doc_id", "_r.*")
    return out.withColumn("toxic", F.col("p_toxic") >= toxic)
