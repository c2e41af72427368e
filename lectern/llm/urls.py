"""URL verdicts: rules for host and path first, else logistic regression on hashed character n-grams.

The model is fitted on a small labelled URL table (its rows are the bound: it is a parameter)
and has a fixed number of weights, so it travels with the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import mix

#: (rule, verdict); a rule is a host, with its subdomains, and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BITS = 14
SIZES = (3, 4, 5)
#: Labelled URLs: 1 is to be blocked.
LABELLED = (
    *((u, 1) for u in (
        "http://cheap-pills.example.com/en/12", "http://www.cheap-pills.example.org/buy/9", "https://cheap-meds.example.net/order", "https://online-casino.example.com/slots", "http://casino-bonus.example.org/en/77",
        "http://free-bets.example.com/de/41", "https://m.free-bets.example.org/en/3", "https://betting-tips.example.net/win", "http://adult-x.example.net/en/5", "https://www.adult-x.example.com/fr/88", "http://xxx-video.example.org/watch",
        "https://adult-cams.example.net/live", "http://spam-farm.example.org/en/728", "https://blog.spam-farm.example.com/en/5", "http://link-farm.example.net/out/1", "http://ads-track.example.org/en/31", "https://m.ads-track.example.net/px?id=3",
        "http://ad-server.example.com/click", "https://track-pixel.example.org/t", "http://payday-loans.example.com/apply", "http://quick-loan.example.net/cash", "https://free-download-crack.example.org/keygen", "http://warez-crack.example.com/serial",
        "http://casino-jackpot.example.net/fr/2", "http://win-prize.example.net/claim", "http://miracle-diet.example.org/buy-now", "https://replica-watches.example.com/sale", "http://phishing-login.example.net/verify-account", "https://malware-exe.example.org/setup.exe")),
    *((u, 0) for u in (
        "http://theory.example.com/en/12", "https://www.library.example.org/en/44", "https://blog.garden.example.net/en/9", "https://m.therapy.example.net/de/25", "http://thther.example.org/en/685", "https://therin.example.net/fr/770", "http://www.thonth.example.org/es/5",
        "https://blog.tionsh.example.net/en/533", "https://ththin.example.com/en/671", "http://news.example.org/2021/05/story.html", "https://university.example.com/courses/12", "http://www.museum.example.net/fr/visit", "https://docs.example.org/guide/install",
        "https://wiki.example.com/en/history", "http://recipes.example.net/de/brot", "https://weather.example.org/es/madrid", "http://forum.example.com/thread/99?page=2", "https://science.example.org/articles/31", "http://school.example.net/en/teachers", "https://m.travel.example.com/fr/45.html",
        "http://city.example.org/de/825", "https://www.hospital.example.com/en/about", "http://music.example.net/en/360", "https://research.example.org/papers/7", "https://blog.theres.example.com/en/17", "http://ththed.example.org/de/3", "https://www.therst.example.com/es/2", "https://open-data.example.org/en/sets")),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of all character n-grams of the texts, as bytes between line ends."""
    raw = [b"\n" + t.encode("utf-8", "replace").replace(b"\n", b" ") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    rows, found = [], []
    for size in SIZES:
        n = max(0, len(data) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + data[k : k + n]
        same = owner[:n] == owner[size - 1 : size - 1 + n]
        rows.append(owner[:n][same])
        found.append((mix(h[same]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def fit(labelled: Sequence[tuple[str, int]] = LABELLED, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on mean-scaled n-gram counts."""
    texts, y = [text_of(u) for u, _ in labelled], np.array([v for _, v in labelled], float)
    rows, cols = features(texts)
    scale = 1 / np.sqrt(np.bincount(rows, minlength=len(texts)).clip(1))
    w, b = np.zeros(2**BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(texts)) * scale + b)))
        slope = (p - y) / len(texts)
        w -= rate * (np.bincount(cols, (slope * scale)[rows], 2**BITS) + decay * w)
        b -= rate * slope.sum()
    return w, b


def text_of(url: str) -> str:
    """Host and path as the model reads them."""
    _, found, rest = url.partition("://")
    return rest.partition("?")[0].partition("#")[0] if found else ""


def score(texts: Sequence[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    w, b = model
    rows, cols = features(texts)
    n = np.bincount(rows, minlength=len(texts)).clip(1)
    return 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(texts)) / np.sqrt(n) + b)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, p_block, verdict`` of every row.

    A null url, or one without ``://``, has an empty host and path and is judged by the model's
    bias like any text.  Rows are judged alone: repeated rows, null ids and further columns change nothing.
    """
    model = fit(labelled)

    def block(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts.tolist(), model))

    probability = F.pandas_udf(block, "double")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("p_block", probability(F.concat("host", "path")))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), "p_block", F.coalesce("_rule.verdict", own).alias("verdict"))
