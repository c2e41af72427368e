import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import lines

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows, min_chars=20, min_docs=3):
    """``doc_id, text`` to (doc_id, n_lines, n_dropped, kept text), line by line; no doc_id is less than any."""
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(FOLD)
            if len(key) >= min_chars:
                holders[key].add(rank(doc_id))
    out = []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        keys = [p.strip(SPACE).translate(FOLD) for p in parts]
        stay = [p for p, k in zip(parts, keys, strict=True) if len(holders.get(k, ())) < min_docs or max(holders[k]) == rank(doc_id)]
        out.append((doc_id, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def of_spark(docs, **kw):
    done = lines.drop_lines(docs, **kw).select("_doc.doc_id", "n_lines", "n_dropped", "kept_text")
    return sorted((tuple(r) for r in done.collect()), key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"{'Shared line number ' if i % 2 else 'É shared line no. '}{i} of the pool" for i in range(40)] + ["short", "", "  ", "\tA SHARED LINE number 1 of the pool \r"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()} of document" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_hand(rows)
    for batches, fanout in ((1, 2), (4, 3), (5, 2)):
        assert of_spark(docs, batches=batches, fanout=fanout) == want
    assert any(n for _, _, n, _ in want) and any(not n for _, _, n, _ in want)


def test_lines_of_odd_rows(spark, odd, none):
    repeat = "A line that the odd rows share with every other one"
    rows = odd.select("doc_id", F.concat_ws("\n", "text", F.lit(repeat)).alias("text"), "lang", "source", "size", "kept", "row")
    assert of_spark(rows) == by_hand([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert of_spark(odd) == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lines.drop_lines(odd).select("_doc.*").columns == odd.columns
    assert of_spark(none) == []
    nulls = odd.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert of_spark(nulls) == by_hand([(None, r["text"]) for r in odd.collect()])


def test_runs_level_up_and_reopen(spark, tmp_path):
    """Every hash is fresh once; levels never hold ``fanout`` runs; a store goes on in another object."""
    store = lines.LineRuns(spark, str(tmp_path / "runs"), buckets=4, fanout=2)
    rng, seen, counts = random.Random(1), {}, defaultdict(int)
    for batch in range(5):
        keys = {(f"line {rng.randrange(60)}", 100 - 10 * batch + rng.randrange(5)) for _ in range(40)}
        store.add(spark.createDataFrame(sorted(keys), "k string, doc_id long").select(lines.short_digest(F.col("k")).alias("h"), "doc_id"))
        for k, i in keys:
            counts[k] += 1
        for k in {k for k, _ in keys} - set(seen):
            seen[k] = max(i for q, i in keys if q == k)
        assert all(len(level) < 2 for level in store.levels + store.tallies)
        if batch == 2:
            store = lines.LineRuns.reopen(spark, str(tmp_path / "runs"), fanout=2)
    got = {bytes(r["h"]): (r["n"], r["owner"]) for r in store.totals().collect()}
    assert got == {hashlib.sha256(k.encode()).digest()[:16]: (counts[k], seen[k]) for k in seen}
    assert sum(run.count() for run in store.runs()) == len(seen)
    store.close()
    assert not (tmp_path / "runs").exists()


def test_runs_are_met_without_moving_them(spark, tmp_path):
    store = lines.LineRuns(spark, str(tmp_path / "runs"), buckets=4, fanout=9)
    rows = spark.range(500).select(lines.short_digest(F.col("id").cast("string")).alias("h"), F.col("id").alias("doc_id"))
    store.add(rows.where("id < 300"))
    store.add(rows.where("id > 100"))
    a, b = store.runs()
    plan = a.join(b.hint("merge"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.close()


@pytest.mark.parametrize("text,want", [(" \tAbÉ\x0b", "abÉ"), (" X", " x"), ("ǅZ", "ǅz"), ("", "")])
def test_keys_fold_only_ascii(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(lines.line_key(F.col("t"))).first()[0] == want
