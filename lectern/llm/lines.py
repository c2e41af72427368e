"""Line dedup against levelled sorted runs of line hashes.

A store is a folder of runs.  A run is a table of distinct line hashes, dealt into buckets by hash and sorted
within each, so two runs meet in a merge join without moving either.  A batch is first brought into that form;
an anti join with every run leaves its fresh hashes, which become a run of level 0 with the document that owns
each line; hashes that a run knows already only add to the tally of documents.  When a level holds ``fanout``
runs they are merged into one run of the next level, so a hash is rewritten once a level and a batch meets few runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import checkpointed, ensure_checkpoint_dir

# What is stripped from a line, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3


def short_digest(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased (other letters stay as they are)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table, wherever the session's file systems keep it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class LineRuns:
    """The runs of one folder, newest level first met.

    ``buckets`` is fixed when the store is made (the session's shuffle partitions unless given).  A manifest in
    the folder names the tables of every version, so ``LineRuns.reopen`` goes on in another session; tables that
    no manifest names any more are deleted when their successors are written.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tallies: list[list[str]] = []
        self.version = 0

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> LineRuns:
        manifest = spark.read.parquet(f"{folder}/manifest")
        last = manifest.agg(F.max("version").alias("v")).first()["v"]
        entries = sorted(manifest.where(F.col("version") == last).collect())
        store = cls(spark, folder, entries[0]["buckets"], fanout)
        store.version = last
        for entry in entries:
            kind, columns = (store.levels, "h BINARY, n BIGINT, owner BIGINT") if entry["kind"] == "run" else (store.tallies, "h BINARY, n BIGINT")
            while len(kind) <= entry["level"]:
                kind.append([])
            if entry["name"]:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {entry['name']} ({columns}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {store.buckets} BUCKETS LOCATION '{folder}/{entry['name']}'")
                kind[entry["level"]].append(entry["name"])
        return store

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, dealt: bool) -> str:
        """Store rows as a sorted run; ``dealt`` says that they are in their buckets already."""
        name = f"line_run_{uuid.uuid4().hex}"
        placed = rows if dealt else rows.repartition(self.buckets, "h")
        placed.sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, f"{self.folder}/{name}")

    def _commit(self) -> None:
        self.version += 1
        known = [("run", i, n) for i, names in enumerate(self.levels) for n in names] + [("tally", i, n) for i, names in enumerate(self.tallies) for n in names]
        entries = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("level"), F.lit(n).alias("name")) for k, i, n in known or [("run", 0, "")]]
        row = self.spark.range(1).select(F.lit(self.version).alias("version"), F.lit(self.buckets).alias("buckets"), F.inline(F.array(*entries)))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``lines(h, doc_id)``; gives its fresh hashes (h, n, owner), as stored."""
        per_document = lines.select("h", "doc_id").distinct()
        own = self._write(per_document.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")), dealt=False)
        known = self.runs()
        if known:
            fresh = self.spark.table(own)
            for run in known:
                fresh = fresh.join(run.hint("merge"), "h", "left_anti")
            added = self._write(fresh, dealt=True)
            seen = self.spark.table(own).join(self.spark.table(added).hint("merge"), "h", "left_anti").select("h", "n")
            self._put(self.tallies, self._write(seen, dealt=True))
            stale = [own]
        else:
            added, stale = own, []
        self._put(self.levels, added)
        stale += self._compact(self.levels, lambda t: t)
        stale += self._compact(self.tallies, lambda t: t.groupBy("h").agg(F.sum("n").alias("n")))
        self._commit()
        fresh = self.spark.table(added) if added not in stale else None
        self._drop(stale)
        return fresh

    @staticmethod
    def _put(levels: list[list[str]], name: str) -> None:
        if not levels:
            levels.append([])
        levels[0].append(name)

    def _compact(self, levels: list[list[str]], fold) -> list[str]:
        """Merge every full level into one run of the next; runs are disjoint, tallies are folded."""
        stale: list[str] = []
        level = 0
        while level < len(levels):
            names = levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(self._write(fold(merged), dealt=False))
                stale += names
                levels[level] = []
            level += 1
        return stale

    def totals(self) -> DataFrame:
        """``h, n, owner``: the documents that hold each line, over all batches, and the one that owns it."""
        rows = [run.select("h", "n", "owner") for run in self.runs()]
        if not rows:
            return self.spark.createDataFrame([], "h binary, n long, owner long")
        rows += [self.spark.table(n).select("h", "n", F.lit(None).cast(rows[0].schema["owner"].dataType).alias("owner")) for level in self.tallies for n in level]
        total = rows[0]
        for other in rows[1:]:
            total = total.unionByName(other)
        return total.groupBy("h").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def close(self) -> None:
        """Forget the tables and delete the folder."""
        self._drop([n for kind in (self.levels, self.tallies) for level in kind for n in level])
        remove_path(self.spark, self.folder)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, body, pos, h``: place and hash of every line whose key has ``min_chars`` code points or more."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", short_digest(text).alias("body"), F.split(text, "\n", -1).alias("lines"))
    lines = split.select("doc_id", "body", F.posexplode_outer("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "body", "pos", short_digest(F.col("key")).alias("h"))


def falling_batches(docs: DataFrame, batches: int) -> Column:
    """Batch number of a row, 0 for the largest doc_ids; rows without one are in the last."""
    shares = [1 - i / batches for i in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("c")).first()["c"] or []) if shares else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("doc_id") > cut, 0).otherwise(1)
    return number.cast("int")


def find_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, body, dropped``: ascending places of the lines that every text loses (texts that lose none are absent).

    Batches of falling doc_id go through the runs, so the batch in which a line is fresh holds its largest doc_id.
    The totals then tell which lines are in ``min_docs`` documents or more.  The result is stored; the runs and the table of hashes are deleted.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = keyed_lines(docs, min_chars).withColumn("batch", falling_batches(docs, batches))
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")
    store = LineRuns(spark, f"{folder}/runs", fanout=fanout)
    for batch in range(batches):
        store.add(lines.where(F.col("batch") == batch))
    # Stored, so that both sides of the join below are plain exchanges, and a line that most documents hold can be split.
    common = store.totals().where(F.col("n") >= min_docs).select("h", "owner")
    common.write.parquet(f"{folder}/common")
    common = spark.read.schema(common.schema).parquet(f"{folder}/common")
    hit = lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = checkpointed(hit.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("pos")).alias("dropped")))
    store.close()
    remove_path(spark, folder)
    return drops


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows of ``docs`` as ``_doc``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Null and empty texts are one empty line, which stays.  A document is told by its doc_id: rows with one doc_id
    (or without) count as one document and, where that one owns a line, all keep it; no doc_id is less than any.
    Of several equal lines in the owner all stay.  An empty table gives no row.  Other columns are carried in ``_doc``,
    so their names never clash.  Lines are compared by 16 bytes of SHA-256; texts of one doc_id are told apart likewise.
    """
    drops = find_drops(docs, min_chars, min_docs, batches, fanout)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("_doc"), text.alias("_text"), short_digest(text).alias("_body"))
    lost = drops.select(F.col("doc_id").alias("_lost_id"), F.col("body").alias("_lost_body"), "dropped")
    same = (F.col("_body") == F.col("_lost_body")) & F.col("_doc.doc_id").eqNullSafe(F.col("_lost_id"))
    met = rows.join(lost, same, "left").select("_doc", "_text", "dropped", F.split("_text", "\n", -1).alias("_lines"))
    edges = met.select("_doc", "_text", "dropped", "_lines", F.concat(F.array(F.lit(-1)), "dropped", F.array(F.size("_lines"))).alias("_edges"))
    between = F.transform(F.sequence(F.lit(0), F.size("dropped")), lambda i: F.slice("_lines", F.get("_edges", i) + 2, F.get("_edges", i + 1) - F.get("_edges", i) - 1))
    kept = F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(between), "\n"))
    return edges.select("_doc", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
