"""Exact and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.llm import exact, mixing, near
from lectern.session import checkpointed


def want_exact(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.text or ""].append(r.doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((r.doc_id or -1, best[r.text or ""] or -1, len(by[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows))


def test_exact_odd_rows(odd):
    got = exact.decide(odd).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.digest) for r in got) == want_exact(odd.collect())
    kept = Counter(r.digest for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.digest for r in got})


def test_exact_drop_keeps_columns(odd):
    out = exact.drop_repeats(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_exact_nothing(none):
    assert exact.decide(none).count() == 0


def test_exact_against_history(spark, odd):
    history = checkpointed(odd.where("doc_id = 1"))
    got = {(r.doc_id, r.digest): r for r in exact.decide(odd, history).collect()}
    repeats = [r for r in got.values() if r.member]
    assert {r.doc_id for r in repeats} == {1, 2} and all(r.keep_id == 1 and not r.kept for r in repeats)
    fresh = [r for r in exact.decide(odd, history).collect() if not r.member]
    assert Counter(r.digest for r in fresh if r.kept) == Counter({r.digest: 1 for r in fresh})
    assert all(r.kept for r in exact.decide(odd.where("doc_id = 3"), history.limit(0)).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 255, 256, 300])
def test_perfect_hash_is_minimal(n):
    for k in range(20):
        digests = [hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(n)]
        assert sorted(exact.find_displacements(digests)[2]) == list(range(n))


def jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    a = Counter({int(x): int(w) for x, w in zip(rng.integers(0, 2**62, 300), rng.integers(1, 40, 300), strict=True)})
    b = Counter({x: max(1, w + int(rng.integers(-8, 9))) for x, w in a.items() if rng.random() < 0.8})
    items = [(d, x, w) for d, c in enumerate((a, b)) for x, w in sorted(c.items())]
    doc, shingle, weight = (np.array(v) for v in zip(*items, strict=True))
    found = near.signatures(doc, shingle.astype(np.uint64), weight, 2, size=4096)
    assert abs((found[0] == found[1]).mean() - jaccard(a, b)) < 0.03


def near_texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(12):  # each is near the next, the ends are not near each other
        texts.append(" ".join(chain))
        chain = chain[6:] + [rng.choice(vocabulary) for _ in range(6)]
    return texts + ["line of five words\n" * 50, "line of five words\n" * 48, "short text", "short text", "", None, " "]


def resplit(spark, monkeypatch, *modules):
    """Let every stored table be followed by other file splits, as when executors come or go."""
    counts = iter(["1", "5"] * 50)

    def store(df):
        out = checkpointed(df)
        spark.conf.set("spark.sql.files.minPartitionNum", next(counts))
        return out

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    for module in modules:
        monkeypatch.setattr(module, "checkpointed", store)


def restore(spark):
    for name in ("minPartitionNum", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_rows_keep_their_numbers_when_files_split_anew(spark, tmp_path, monkeypatch):
    texts = near_texts()[:20]
    spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    stages = [lambda: exact.drop_repeats(docs), lambda: near.drop_near(docs), lambda: mixing.mix_documents(docs)]
    want = [sorted(stage().collect(), key=str) for stage in stages]
    resplit(spark, monkeypatch, near, mixing, session)
    try:
        for stage, rows in zip(stages, want, strict=True):
            out = stage()
            assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(out.collect(), key=str) == rows
    finally:
        restore(spark)


def test_near_groups_match_brute_force(spark, tmp_path):
    texts = near_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = near.groups(spark.read.parquet(str(tmp_path / "d"))).collect()
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= near.SIMILARITY:
                parent[find(i)] = find(j)
    want = defaultdict(set)
    for i in range(len(texts)):
        want[find(i)].add(i)
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in classes.values()} == {frozenset(v) for v in want.values()}
    assert all(r.class_id == max(classes[r.class_id]) and r.group_size == len(classes[r.class_id]) and r.kept == (r.doc_id == r.class_id) for r in got)


def test_members_no_hub_links_are_tested_pair_by_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "HUB_ROUNDS", 0)
    test_near_groups_match_brute_force(spark, tmp_path)


def test_near_odd_rows(odd):
    got = near.groups(odd).collect()
    assert len(got) == odd.count()
    assert sum(r.kept for r in got) == len({r.class_row for r in got})
    out = near.drop_near(odd)
    assert out.columns == odd.columns and out.count() == sum(r.kept for r in got)


def test_near_nothing(none):
    assert near.groups(none).count() == 0 and near.drop_near(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in near.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
