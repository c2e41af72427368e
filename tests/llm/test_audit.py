import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.llm import audit as A
from tests.llm.conftest import LONG

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text or "")
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or "")))


@pytest.mark.parametrize("seed", range(4))
def test_transducer_against_patterns(seed):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "中", "𝔘", "#", "|", " ", "\n", "\t", "\x0b", " ", "\x1c", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(200)]
    texts += ["x" * n for n in range(0, 40)] + ["x" * 8 + " " + "x" * 9 + " " + "x" * 8, ("y" * 300 + " ") * 3 + "y" * 299 + "z", " ".join("ab" * (k % 9) + str(k % 50) for k in range(3000))]
    got = A.transduce([t.encode() for t in texts])[1]
    assert [tuple(int(got[n][i]) for n in A.FIGURES) for i in range(len(texts))] == [figures(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all words every slot is a clash, and counts still hold."""
    monkeypatch.setattr(A.Spans, "_hashes", lambda self: self.size.astype("uint64") * 0)
    texts = ["a b a c abcdefghij abcdefghij abcdefghik", "a", "", "b b b " + "q" * 400 + " " + "q" * 400]
    assert A.transduce([t.encode() for t in texts])[1]["n_distinct"].tolist() == [figures(t)[1] for t in texts]


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 997)
    texts = [LONG, "x" * 5000, "é" * 3000 + " " + "é" * 3000, "ab " * 2000, " " * 4000 + "end", "A" * 996 + " b", ""]
    for text in texts:
        assert A._long_text(memoryview(text.encode())) == list(figures(text))


def by_hand(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        w, d, c, p, s = figures(text)
        fails = {k for k, v in {"A": w < 100, "B": 100 * d < 80 * w, "C": 100 * c > 10 * p, "D": s > 0, "E": i is not None and i > first[text or ""]}.items() if v}
        rows.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley, steps = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(hit)
                steps[order, step] = [len(left), len(hit), len(mine) - len(hit), sum(r[1] == {f} for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit)]
        out |= {(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in steps.items()}
    return out


def of_spark(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = A.audit(docs, labels).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}


def test_audit_of_odd_rows(spark, odd, none):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, None)]
    labels = spark.createDataFrame([Row(doc_id=i, quality=q, toxic=t, lang="x", text="x", n="y") for i, q, t in marks], "doc_id long, quality int, toxic int, lang string, text string, n string")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert of_spark(odd, labels) == by_hand(rows, marks)
    assert of_spark(odd, labels.where("false")) == by_hand(rows, [])
    assert of_spark(none, labels) == {}


def test_audit_of_copies(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("Alpha beta gamma DELTA eps# zeta".split()) + str(rng.randrange(k)) for _ in range(n)) for k, n in ((900, 150), (9, 150), (900, 20), (40, 120))] + ["", None]
    docs = [(i if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(300)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)]
    got = of_spark(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == by_hand(docs, labels)
    assert spark.createDataFrame(docs, "doc_id long, text string, lang string").where(F.col("lang").isNull()).count() > 0
