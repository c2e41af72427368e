"""Exact dedup over a minimal perfect hash of the distinct text digests seen so far.

The distinct digests are dealt into shards by their leading bits; a shard of about 256 digests gets
a hash-and-displace function that maps its n digests onto n slots.  A slot holds the full
digest, the locator of the row that stays and the number of rows.  A lookup computes the slot
and compares all 32 bytes, so it never errs; what is no member is grouped by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed, numbered

PER_SHARD = 256
PER_BUCKET = 4


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _word(hexed: Column, at: int, size: int = 8) -> Column:
    return F.conv(F.substring(hexed, at + 1, size), 16, 10).cast("long")


def shard_of(hexed: Column, shards: int) -> Column:
    return F.pmod(_word(hexed, 0, 14), F.lit(shards))


def find_displacements(digests: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """``(seed, displacements, slots)`` for n distinct hex digests.

    ``slot = (a + (d // n) * b + d % n) % n`` with the displacement ``d`` of the key's bucket, ``a``
    the crc32 of digest and seed and ``b`` a word of the digest.  Large buckets are placed first,
    each at its first displacement without a clash; the seed changes if a bucket finds none.
    """
    n = len(digests)
    count = -(-n // PER_BUCKET)
    bucket = np.array([int(d[14:22], 16) for d in digests]) % count
    b = np.array([int(d[22:30], 16) for d in digests])
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=count))[:-1])
    shifts = np.arange(n)
    for seed in range(10_000):
        a = np.array([zlib.crc32(f"{d}:{seed}".encode()) for d in digests])
        taken, slots = np.zeros(n, bool), np.zeros(n, np.int64)
        pilots = np.zeros(count, np.int64)
        for i in sorted(range(count), key=lambda i: (-len(members[i]), i)):
            keys = members[i]
            if not len(keys):
                break
            for turn in range(4 * n):
                at = (a[keys] + turn * b[keys]) % n
                if len(np.unique(at)) < len(at):
                    continue
                free = ~taken[(at[:, None] + shifts) % n].any(axis=0)
                if free.any():
                    shift = int(np.argmax(free))
                    pilots[i], slots[keys] = turn * n + shift, (at + shift) % n
                    taken[slots[keys]] = True
                    break
            else:
                break
        else:
            return seed, pilots, slots
        if taken.all():
            return seed, pilots, slots
    raise ValueError("no displacement found for a shard")


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """Shards over ``digests(digest, winner struct(doc_id, row), size)``, digests being distinct."""
    kind = digests.schema["winner"].dataType["doc_id"].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest").reset_index(drop=True)
        raw = [bytes.fromhex(d) for d in pdf["digest"]]
        seed, pilots, slots = find_displacements(pdf["digest"].tolist())
        order = np.argsort(slots)
        ids = [None if pd.isna(v) else v for v in pdf["doc_id"]]
        row = {"shard": pdf["shard"].iloc[0], "n": len(raw), "seed": seed, "pilots": pilots.tolist(), "digests": [raw[i] for i in order], "keeps": [ids[i] for i in order], "rows": [int(pdf["row"].iloc[i]) for i in order], "sizes": [int(pdf["size"].iloc[i]) for i in order]}
        return pd.DataFrame([row])

    schema = f"shard long, n int, seed int, pilots array<long>, digests array<binary>, keeps array<{kind}>, rows array<long>, sizes array<long>"
    flat = digests.select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "winner.doc_id", "winner.row", "size")
    return flat.groupBy("shard").applyInPandas(build, schema)


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``rows(digest, ...)`` with ``member``, ``keep_id``, ``keep_row`` and ``group_size``.

    One equi-join on the shard, whose large partitions Spark can split, so a text that is a
    third of all rows does no harm.  Slot and byte check are column expressions.
    """
    d = F.col("digest")
    keyed = rows.withColumn("shard", shard_of(d, shards))
    hit = keyed.join(index, "shard", "left")
    pilot = F.get("pilots", F.pmod(_word(d, 14), F.ceil(F.col("n") / PER_BUCKET)).cast("int"))
    slot = F.pmod(F.crc32(F.concat_ws(":", d, "seed").cast("binary")) + F.floor(pilot / F.col("n")) * _word(d, 22) + F.pmod(pilot, F.col("n")), F.col("n")).cast("int")
    found = hit.select(*rows.columns, slot.alias("_slot"), "digests", "keeps", "rows", "sizes")
    member = F.coalesce(F.get("digests", "_slot") == F.unhex(d), F.lit(False))
    value = lambda name: F.when(member, F.get(name, "_slot"))
    return found.select(*rows.columns, member.alias("member"), value("keeps").alias("keep_id"), value("rows").alias("keep_row"), value("sizes").alias("group_size"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays (largest doc_id, null least; then the last row) and the count."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("size"))


def decide(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id, row, digest, keep_id, keep_row, group_size, kept, member``.

    Without ``history`` the table is its own history.  With it (another table with doc_id and
    text), a text seen there is a repeat and its locator is the historical row; texts not seen
    are grouped among themselves and looked up in an index of their own.
    Null texts count as empty; of repeated rows with one doc_id one stays; an empty table
    gives no row.  ``row`` numbers the rows of ``docs`` as they are stored here, once.
    """
    return _decide(_digested(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")), history)


def _digested(rows: DataFrame) -> DataFrame:
    """``doc_id, row, digest`` of ``rows(doc_id, row, text)``, stored."""
    return checkpointed(rows.select("doc_id", "row", digest(F.col("text")).alias("digest")))


def _decide(carried: DataFrame, history: DataFrame | None) -> DataFrame:
    base = carried if history is None else _digested(history.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
    shards = max(1, -(-base.count() // PER_SHARD))
    found = look_up(carried, build_index(distinct_digests(base), shards), shards)
    if history is None:
        return found.withColumn("kept", F.col("row") == F.col("keep_row"))
    fresh = found.where(~F.col("member")).select(*carried.columns)
    shards = max(1, -(-carried.count() // PER_SHARD))
    own = look_up(fresh, build_index(distinct_digests(fresh), shards), shards)
    repeats = found.where("member").withColumn("kept", F.lit(False))
    return repeats.unionByName(own.withColumn("kept", F.col("row") == F.col("keep_row")).withColumn("member", F.lit(False)))


def drop_repeats(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only digests are dealt; texts meet the numbers of the rows that go.
    """
    stored = numbered(docs)
    dropped = checkpointed(_decide(_digested(stored.select("_doc.doc_id", "row", "_doc.text")), history).where(~F.col("kept")).select("row"))
    return stored.join(dropped, "row", "left_anti").select("_doc.*")
