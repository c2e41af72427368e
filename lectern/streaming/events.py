"""File events: coalescing, bursts, and the pending table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.revisions import inside_root, latest
from lectern.skew import running
from lectern.streaming import WATERMARK


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def valid_events(events: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Events on wanted files inside the root, and the rejected ones for quarantine."""
    good = inside_root(F.col("path"), root) & (F.col("previous_path").isNull() | inside_root(F.col("previous_path"), root, ""))
    return events.where(good), events.where(~good)


def coalesce_batch(events: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The last event per path of one batch."""
    return latest(events, list(keys), ["ts", "event_id"])


def merge_pending(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """A new event replaces the pending one of its path but keeps its previous path when it
    names none."""
    old = pending.select("path", F.col("previous_path").alias("_old"))
    fresh = batch.join(old, "path", "left").withColumn("previous_path", F.coalesce("previous_path", "_old")).drop("_old")
    return pending.join(batch.select("path"), "path", "left_anti").select(*batch.columns).unionByName(fresh.select(*batch.columns))


def coalesce_history(events: DataFrame, batch: str) -> DataFrame:
    """Batch twin of feeding the batches one by one: last event per path and batch, then the
    last batch with the last previous path named by any batch's last event."""
    per_batch = latest(events, ["path", batch], ["ts", "event_id"])
    position = F.struct("ts", "event_id")
    return per_batch.groupBy("path").agg(
        F.max_by("event_type", position).alias("event_type"),
        F.max_by("previous_path", F.when(F.col("previous_path").isNotNull(), position)).alias("previous_path"), F.max("ts").alias("ts"))


def burst_stream(events: DataFrame, key: str = "root", gap: str = "2 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Bursts of a stream: a burst closes after two seconds of silence."""
    return events.withWatermark("ts", watermark).groupBy(F.col(key), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(
        key, F.col("w.start").alias("burst_start"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("burst_last"), "n_events")


def bursts(events: DataFrame, key: str, blocks: list[str], gap_seconds: float = 2.0) -> DataFrame:
    """Batch twin of ``burst_stream``, block by block, so a busy root spreads over many tasks."""
    order = ["ts", "event_id"]
    seen = running(events, [key], order, blocks, {"_before": ("last", F.col("ts"))}, inclusive=False)
    far = (micros("ts") - micros("_before")) >= int(gap_seconds * 1_000_000)
    flagged = seen.withColumn("_opens", F.when(F.col("_before").isNull() | far, 1).otherwise(0))
    numbered = running(flagged, [key], order, blocks, {"burst": ("sum", F.col("_opens"))})
    return numbered.groupBy(key, "burst").agg(F.min("ts").alias("burst_start"), F.max("ts").alias("burst_last"), F.count(F.lit(1)).alias("n_events"))


def write_pending(path: str):
    """``foreachBatch`` writer: one file set per batch under ``path``, with the batch's last events.

    A batch writes its own rows only; a retried batch overwrites its own folder.  ``read_pending``
    folds the batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        coalesce_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete ``kind=<number>`` folders under ``path``, wherever the session's file systems keep it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.globStatus(where.suffix(f"/{kind}=*"))] if files.exists(where) else []
    return sorted(int(f.getName().split("=")[1]) for f in found if files.exists(f.suffix("/_SUCCESS")))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[int], list[int]]:
    """Rows not folded yet with those of the newest fold, the batches among them, and all folds."""
    folds = _folders(spark, path, "fold")
    batches = [n for n in _folders(spark, path, "batch") if not folds or n > folds[-1]]
    parts = [f"{path}/batch={n}" for n in batches]
    rows = spark.read.option("basePath", path).parquet(*parts) if parts else None
    if folds:
        base = spark.read.parquet(f"{path}/fold={folds[-1]}").withColumn("batch", F.lit(folds[-1]))
        rows = base if rows is None else base.unionByName(rows)
    return rows, batches, folds


def _last_events(rows: DataFrame) -> DataFrame:
    order = F.struct("batch", "ts", "event_id")
    rest = [c for c in rows.columns if c not in ("path", "previous_path", "batch")]
    last = rows.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max_by("previous_path", F.when(F.col("previous_path").isNotNull(), order)).alias("previous_path"))
    return last.select("path", "previous_path", "_r.*")


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """The pending row of every path: its last event, with the last previous path that was named.

    Reads the newest fold and the batches after it, not every batch ever written.
    """
    rows, _, _ = _stored(spark, path)
    if rows is None:
        raise ValueError(f"no batch was written under {path}")
    return _last_events(rows)


def fold_pending(spark: SparkSession, path: str, handled: DataFrame | None = None) -> int | None:
    """Fold all batches but the newest (which may be written again) into one; gives its number, None if there was nothing to do.

    ``handled(path, event_id)``: events that are done; a row leaves when the event it stands for is.  The fold
    is complete before what it replaces is deleted, so a reader or a run that was stopped finds one or the other.
    """
    _, batches, folds = _stored(spark, path)
    if len(batches) < 2:
        return None
    upto = batches[-2]
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches[:-1]])
    if folds:
        rows = rows.unionByName(spark.read.parquet(f"{path}/fold={folds[-1]}").withColumn("batch", F.lit(folds[-1])))
    left = _last_events(rows)
    if handled is not None:
        left = left.join(handled.select("path", "event_id").distinct(), ["path", "event_id"], "left_anti")
    left.select(*[c for c in rows.columns if c != "batch"]).write.mode("overwrite").parquet(f"{path}/fold={upto}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [*(f"batch={n}" for n in batches[:-1]), *(f"fold={n}" for n in folds)]:
        files.delete(where.suffix(f"/{name}"), True)
    return upto


def marked(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Pending rows with ``status`` done or failed (and its ``error``) from ``results(path, error)``; others stay pending."""
    told = results.select("path", F.col("error").alias("_e"), F.lit(True).alias("_t"))
    joined = pending.join(told, "path", "left")
    status = F.when(F.col("_t").isNull(), "pending").when(F.col("_e").isNull(), "done").otherwise("failed")
    return joined.withColumn("status", status).withColumn("error", F.col("_e")).drop("_e", "_t")


def once_per_call(calls: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Replays of a (run, call) within the watermark are dropped from a stream."""
    return calls.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "tool_call_id"])
