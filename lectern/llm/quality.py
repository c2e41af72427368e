"""Quality rules: a table of thresholds compiled into one projection, without user functions.

All work on a text happens inside its row: words, windows and lines are arrays that are bound once
(``let``) and searched by sorting, so a very long text costs n log n and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages; fixed values.
STOP_WORDS = (
    "the of to and in is for that it was with as on are by this at from der die das und von zu den mit ist im des auf ein eine für nicht "
    "le la les de et un une du des que est en dans pour sur par el los las y una del que en es por con para se su al"
)
#: (metric, least, most); None: no bound on that side.  A metric that is null passes.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 1.5, 25.0),
    ("symbol_ratio", None, 0.5),
    ("stop_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.5),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words found twice or more, the first included.

    Windows are compared by 64-bit hashes.  Repeated ones are neighbours after sorting by
    (hash, place); their places in order cover ``min(window, gap to the next)`` words each.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("long")

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda p, k: (F.get(s, k - 1)["h"] == p["h"]) | (F.get(s, k + 1)["h"] == p["h"]))
        places = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda p: p["i"])))
        return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), let(places, covered)).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= window, let(let(hashed, windows), count)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """Struct of all counts of a text; null and empty texts have zeros."""
    whole = F.coalesce(text, F.lit(""))
    stops = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
    )
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    symbols = (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")
    return F.struct(let(word_array(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


def metrics() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return {
        "n_words": F.col("n_words"), "mean_word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": F.when(F.col("n_words") >= 50, F.col("n_stop_words") / F.col("n_words")), "dup_line_ratio": F.when(F.col("n_lines") >= 3, F.col("n_dup_lines") / F.col("n_lines")),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def compiled(rules: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """The names of the rules that a row breaks, as one expression over its measures."""
    known = metrics()
    broken = []
    for name, least, most in rules:
        value = known[name]
        low = value < least if least is not None else F.lit(False)
        high = value > most if most is not None else F.lit(False)
        broken.append(F.when(F.coalesce(low | high, F.lit(False)), F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``broken`` (rule names) and ``kept`` of every row.

    Null and empty texts have no words and fail the base rule.  Every row is judged by
    itself, so repeated rows, null ids and further columns change nothing.
    """
    m = docs.select("doc_id", measures(F.col("text")).alias("_m")).select("doc_id", "_m.w.*", "_m.l.*", "_m.n_symbols")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = m.withColumn("base_failed", base).withColumn("broken", compiled(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
