"""Streams against their batch twins, sources and sinks."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.sources import files as FS
from lectern.sources import sinks
from lectern.streaming import events as E
from lectern.streaming import jobs as J
from lectern.streaming import stability as S

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def landed(spark, rows, schema, tmp_path, name):
    path = str(tmp_path / f"in-{name}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_coalescing(spark):
    schema = "event_id long, event_type string, path string, previous_path string, ts timestamp"
    batch = spark.createDataFrame([(1, "created", "/l/a.pdf", "/l/old.pdf", at(0)), (2, "modified", "/l/b.pdf", None, at(1))], schema)
    later = spark.createDataFrame([(3, "modified", "/l/a.pdf", None, at(2))], schema)
    got = E.merge_pending(E.coalesce_batch(batch), E.coalesce_batch(later)).orderBy("path").collect()
    assert [(r["event_type"], r["previous_path"]) for r in got] == [("modified", "/l/old.pdf"), ("modified", None)]
    good, bad = E.valid_events(batch.unionByName(spark.createDataFrame([(9, "created", "/x/c.pdf", None, at(3))], schema)), "/l")
    assert good.count() == 2 and bad.count() == 1


def test_stable_files_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, path string, size_bytes long, modified_at_ns long, ts timestamp"
    rows = [(1, "a", 1, 1, at(0)), (2, "a", 1, 1, at(1)), (3, "a", 1, 1, at(3)), (4, "b", 1, 1, at(0)), (5, "b", 2, 1, at(3)), (6, "b", 2, 1, at(4)), (7, "c", 5, 5, at(9))]
    batch = S.stable_files(spark.createDataFrame(rows, schema).withColumn("h", F.date_trunc("hour", "ts")), ["h"])
    want = {(r["path"], r["accepted_at"]) for r in batch.collect()}
    assert want == {("a", at(3))}
    stream = S.stable_stream(landed(spark, rows, schema, tmp_path, "stable"))
    assert {(r["path"], r["accepted_at"]) for r in drain(spark, stream, tmp_path, "stable").collect()} == want


def test_paths_out_of_sight_leave_the_state(spark, tmp_path):
    """One file set a batch: a path of the first is forgotten once event time has passed it by an hour."""
    schema = "event_id long, path string, size_bytes long, modified_at_ns long, ts timestamp"
    folder = str(tmp_path / "in-forget")
    for k, rows in enumerate([[(1, "gone", 1, 1, at(0))], [(2, "near", 1, 1, at(9000))], [(3, "near", 1, 1, at(9001))], [(4, "near", 1, 1, at(9003))], [(5, "gone", 1, 1, at(9004))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = S.stable_stream(spark.readStream.schema(schema).parquet(folder), forget=3600.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        if k == 2:
            rows_kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    accepted = [(r["path"], r["accepted_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert accepted == [("near", at(9003))]  # "gone" was forgotten: its second sighting starts anew
    assert rows_kept <= 3  # the value and the timer of "near", and nothing of "gone" but what a late batch clears


def test_pending_batches_are_folded(spark, tmp_path):
    path = str(tmp_path / "pending")
    schema = "event_id long, event_type string, path string, previous_path string, ts timestamp"
    write = E.write_pending(path)
    batches = [[(1, "created", "/a", "/old", at(0)), (2, "created", "/b", None, at(0))], [(3, "modified", "/a", None, at(1)), (4, "created", "/c", None, at(1))], [(5, "modified", "/b", None, at(2))], [(6, "removed", "/c", None, at(3))]]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    for k, rows in enumerate(batches):
        write(frame(rows), k)
    told = lambda: sorted((r["path"], r["event_id"], r["previous_path"]) for r in E.read_pending(spark, path).collect())
    want = told()
    assert want == [("/a", 3, "/old"), ("/b", 5, None), ("/c", 6, None)]
    assert E.fold_pending(spark, path) == 2 and told() == want
    assert sorted(p.name for p in (tmp_path / "pending").iterdir() if p.is_dir()) == ["batch=3", "fold=2"]
    assert E.fold_pending(spark, path) is None
    write(frame(batches[3]), 3)  # a retried batch replaces its own rows
    write(frame([(7, "modified", "/a", None, at(4))]), 4)
    assert E.fold_pending(spark, path, handled=frame([(5, "modified", "/b", None, at(2)), (3, "modified", "/a", None, at(1))])) == 3
    assert told() == [("/a", 7, None), ("/c", 6, None)]
    assert sorted(p.name for p in (tmp_path / "pending").iterdir() if p.is_dir()) == ["batch=4", "fold=3"]


def test_burst_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, root string, ts timestamp"
    rows = [(i, "r", at(s)) for i, s in enumerate([0, 1, 2.5, 6, 7])] + [(9, "r", at(5000))]
    batch = E.bursts(spark.createDataFrame(rows, schema).withColumn("h", F.date_trunc("hour", "ts")), "root", ["h"]).collect()
    want = {(r["burst_start"], r["burst_last"], r["n_events"]) for r in batch}
    assert (at(0), at(2.5), 3) in want and (at(6), at(7), 2) in want
    got = {tuple(r) for r in drain(spark, E.burst_stream(landed(spark, rows, schema, tmp_path, "burst")).drop("root"), tmp_path, "burst").collect()}
    assert got == {w for w in want if w[0] < at(4000)}


def test_activity_fold_stream_equals_batch(spark, tmp_path):
    schema = "request_id string, seq long, ts timestamp, kind string, text string, reasoning_characters int, input_tokens long, output_tokens long, error string"
    kinds = ["started", "connected", "thinking", "delta", "delta", "done"]
    rows = [("r", i, at(i), k, "abc" if k == "delta" else None, 4 if k == "thinking" else None, 9 if k == "done" else None, 3 if k == "done" else None, None) for i, k in enumerate(kinds)]
    batch = J.fold_activity(spark.createDataFrame(rows, schema)).collect()
    r = batch[0]
    assert (r["phase"], r["received_characters"], r["reasoning_characters"], r["input_tokens"], r["first_token_at"], r["completed_at"]) == ("completed", 6, 4, 9, at(2), at(5))
    assert drain(spark, J.fold_activity(landed(spark, rows, schema, tmp_path, "fold")), tmp_path, "fold", "update").collect() == batch


def test_stage_fold(spark):
    events = [(1, "j", "HASHING", 0.1, "", at(0)), (2, "j", "PARSING_LAYOUT", 0.4, "", at(1)), (3, "j", "PARTIAL", 0.9, "", at(2)), (4, "k", "PARSING_LAYOUT", 0.4, "", at(1)), (5, "k", "HASHING", 0.1, "", at(2))]
    df = spark.createDataFrame(events, "event_id long, job_id string, status string, progress double, message string, ts timestamp")
    got = {(r["job_id"], r["stage"]): (r["stage_status"], r["stage_progress"]) for r in J.finish_stages(J.stage_state(df)).collect()}
    assert got == {("j", "hash"): ("completed", 1.0), ("j", "layout"): ("completed", 1.0), ("j", "index"): ("partial", 1.0), ("k", "layout"): ("running", 0.4), ("k", "hash"): ("running", 0.1)}


def test_stage_stream_equals_batch(spark, tmp_path):
    """Three batches: a stage is finished when a later one first follows its start, and stays so."""
    schema = "event_id long, job_id string, status string, progress double, message string, ts timestamp"
    batches = [[(1, "j", "HASHING", 0.1, "", at(0)), (2, "k", "PARSING_LAYOUT", 0.4, "", at(1)), (3, "k", "HASHING", 0.1, "", at(2)), (4, "l", "FAILED", None, "", at(2))],
               [(5, "j", "PARSING_LAYOUT", 0.4, "", at(3)), (6, "k", "RECOGNIZING_TEXT", None, "", at(4))],
               [(7, "j", "HASHING", 0.2, "", at(5)), (8, "j", "PARTIAL", 0.9, "", at(6)), (9, "k", "READY", 0.9, "", at(7)), (10, "k", "NEW_STATUS", 0.9, "", at(8))]]
    folder, told = str(tmp_path / "in-stages"), {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = str(tmp_path / f"out-{k}")
        stream = J.stage_stream(spark.readStream.schema(schema).parquet(folder))
        query = stream.writeStream.foreachBatch(lambda df, n, out=out: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "cp-stages")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        told.update({(r["job_id"], r["stage"]): tuple(r) for r in spark.read.parquet(out).collect()})
    columns = ["job_id", "stage", "stage_status", "stage_progress", "started_at", "finished_at"]
    batch = J.job_stages(spark.createDataFrame([r for rows in batches for r in rows], schema)).select(*columns)
    assert set(told.values()) == {tuple(r) for r in batch.collect()}
    assert told["j", "hash"][2:] == ("completed", 1.0, at(0), at(3)) and told["k", "hash"][5] == at(4) and told["k", "layout"][5] == at(4)
    assert told["j", "index"][2:] == ("partial", 1.0, at(6), None)
    assert J.job_stages(spark.createDataFrame([], schema)).count() == 0


def test_file_inventory_and_tables(spark, tmp_path):
    root = tmp_path / "library"
    (root / "sub").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"%PDF /Type /Page /Type /Pages /Type /Page\n /Encrypt")
    (root / "sub" / "B.PDF").write_bytes(b"%PDF")
    (root / "c.txt").write_text("no")
    listing = FS.list_files(spark, str(root))
    assert listing.count() == 2
    rows = {r["path"].rsplit("/", 1)[1]: r for r in FS.read_changed(listing, 2).collect()}
    whole = {r["path"]: r for r in FS.inventory(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))).collect()}
    assert all(r == whole[r["path"]] for r in rows.values()) and set(rows) == {"a.pdf", "B.PDF"}
    gone = FS.read_changed(spark.createDataFrame([(f"file:{root}/none.pdf",)], ["path"]), 1).first()
    assert gone["sha256"] is None and gone["page_count"] is None
    assert FS.inventory_total(FS.read_changed(listing, 2)).first()["pages"] == 3
    assert rows["a.pdf"]["page_count"] == 2 and rows["a.pdf"]["encrypted"] and rows["B.PDF"]["page_count"] == 1
    table = spark.createDataFrame([(i, f"v{i}") for i in range(40)], ["paper_id", "v"])
    out = str(tmp_path / "table")
    sinks.write_bucketed(table, out, "paper_id", 4)
    stored = spark.read.parquet(out)
    hit = sinks.touched_buckets(stored, spark.createDataFrame([(3,)], ["paper_id"]), "paper_id", 4)
    assert 0 < hit.count() < 40
    csv = str(tmp_path / "csv")
    sinks.write_table_csv(spark.createDataFrame([("t", '| a | b |\n|---|---|\n| 1,5 | "q" |')], ["table_id", "markdown"]), csv)
    lines = sorted(r["value"] for r in spark.read.text(csv).collect())
    assert lines == ['t,0,a,b', 't,1,"1,5","""q"""']
    assert all(len([f for f in d.iterdir() if f.suffix == '.parquet']) <= 4 for d in (tmp_path / 'table').iterdir() if d.is_dir())


def test_marks_over_chunk_ends(tmp_path):
    body = b"/Type /Page/Type /Page /Type /Pages/Type /Page\n/Encrypt /Type /Page"
    (tmp_path / "a b.pdf").write_bytes(body)
    want = FS.inspect(str(tmp_path / "a b.pdf"))
    assert want[0] == len(body) and want[2] == 2 and want[3]
    assert all(FS.inspect(f"file:{tmp_path}/a b.pdf", n) == want for n in range(1, len(body) + 1))
