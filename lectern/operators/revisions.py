"""Revision chains and change application: latest per key, upserts, cascades, guards.

Plain Parquet has no row updates, so a change job reads the old table and the change feed
and returns the new table; ``bucketed_overwrite`` in ``lectern.sources.sinks`` rewrites only the
touched buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.skew import first_rows, number_rows, running


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The last row per key; later order columns break ties."""
    usable = rows if where is None else rows.where(where)
    return first_rows(usable, keys, [F.col(c).desc() for c in order])


def latest_with_history(responses: DataFrame, questions: DataFrame, keys: Sequence[str], revision: str = "revision") -> DataFrame:
    """Questions in revision order, each row with the turn's latest response beside it."""
    newest = latest(responses, keys, [revision]).withColumnRenamed(revision, "response_revision")
    return questions.join(newest, list(keys), "left")


def next_revision(existing: DataFrame, arrivals: DataFrame, keys: Sequence[str], order: Sequence[str], revision: str = "revision", blocks: Sequence[str] | None = None) -> DataFrame:
    """Number arrivals after the highest existing revision of their key.

    With ``blocks`` (non-decreasing in ``order``) the numbering is done block by block; without
    them arrivals are range-partitioned.  Either way a hot key spreads over many tasks.
    """
    top = existing.groupBy(*keys).agg(F.max(revision).alias("_top"))
    if blocks is None:
        numbered = number_rows(arrivals, keys, order, "_n")
    else:
        numbered = running(arrivals, keys, order, blocks, {"_n": ("sum", F.lit(1))})
    joined = numbered.join(top, list(keys), "left")
    return joined.withColumn(revision, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")).drop("_top", "_n")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Last change per key wins; columns in ``keep`` (creation time) come from the old row."""
    newest = latest(changes, keys, order).select(*table.columns)
    old = table.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = newest.join(old, list(keys), "left") if keep else newest
    merged = merged.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns])
    untouched = table.join(newest.select(*keys), list(keys), "left_anti")
    return untouched.select(*table.columns).unionByName(merged)


def insert_missing(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], null_distinct: Sequence[str] = ()) -> DataFrame:
    """Insert rows whose key is new; with nulls in ``null_distinct`` columns keys never collide."""
    nullable = F.lit(False)
    for column in null_distinct:
        nullable = nullable | F.col(column).isNull()
    free = rows.where(nullable)
    fresh = first_rows(rows.where(~nullable), keys, [F.col(c) for c in order]).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns)).unionByName(free.select(*table.columns))


def carry_forward(history: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null in a change means "keep": the last known value at each event."""
    return running(history, keys, order, blocks, {f"current_{c}": ("last", F.col(c)) for c in columns})


def favorite_since(history: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[str], flag: str, at: str) -> DataFrame:
    """When the current favourite mark was first set; null while it is off.

    The mark keeps its time until it is cleared, so the time is that of the first set after
    the last clear: a running "last" over the events that switch it on.
    """
    seen = running(history, keys, order, blocks, {"_was": ("last", F.col(flag).cast("int"))}, inclusive=False)
    switched = F.when(F.col(flag) & (F.coalesce(F.col("_was"), F.lit(0)) == 0), F.col(at))
    marked = running(seen, keys, order, blocks, {"_since": ("last", switched)})
    return marked.withColumn("favorited_at", F.when(F.col(flag), F.col("_since"))).drop("_was", "_since")


def cascade_delete(tables: dict[str, tuple[DataFrame, str, str]], root: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """Remove deleted ids and everything that hangs on them.

    ``tables`` maps a name to ``(rows, parent table or "", foreign key column)`` in dependency
    order, every table keyed by ``id``; ``deleted(id)`` names rows of ``root``.
    """
    gone: dict[str, DataFrame] = {root: deleted.select("id").distinct()}
    left: dict[str, DataFrame] = {}
    for name, (rows, parent, key) in tables.items():
        if name == root:
            left[name] = rows.join(gone[root], "id", "left_anti")
        elif parent in gone:
            lost = rows.join(gone[parent].withColumnRenamed("id", key), key, "left_semi")
            gone[name] = lost.select("id")
            left[name] = rows.join(gone[parent].withColumnRenamed("id", key), key, "left_anti")
        else:
            left[name] = rows
    return left


def refuse_referenced(deletions: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split deletions into allowed ones and those refused because children exist."""
    used = children.select(F.col(key).alias("id")).distinct()
    return deletions.join(used, "id", "left_anti"), deletions.join(used, "id", "left_semi")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All child rows of a re-read parent are replaced by its fresh ones."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def append_and_repoint(records: DataFrame, saved: DataFrame, annotations: DataFrame, keys: Sequence[str], order: Sequence[str], revision_keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Append new revisions; annotations of older records of the key give way to new ones.

    Revision numbers count per ``revision_keys`` (block and language), the superseded records
    are those of the full ``keys`` (with the range).
    """
    numbered = next_revision(records, saved, revision_keys or keys, order)
    merged = records.unionByName(numbered.select(*records.columns))
    old = records.join(saved.select(*keys).distinct(), list(keys), "left_semi").select(F.col("id").alias("related_id"))
    kept = annotations.join(old, "related_id", "left_anti")
    newest = latest(numbered, keys, ["revision"])
    pointed = newest.select(*[F.col("id").alias(c) if c == "related_id" else F.col(c) if c in newest.columns else F.lit(None).alias(c) for c in annotations.columns])
    return merged, kept.select(*annotations.columns).unionByName(pointed)


def terminal_guard(events: DataFrame, key: str, order: Sequence[str], status: str, terminal: Sequence[str]) -> DataFrame:
    """Events up to the first terminal one; later ones count only when they repeat it."""
    position = F.struct(*order)
    first = events.where(F.col(status).isin(*terminal)).groupBy(key).agg(
        F.min(position).alias("_at"), F.min_by(F.col(status), position).alias("_final"))
    joined = events.join(first, key, "left")
    return joined.where(F.col("_at").isNull() | (position <= F.col("_at")) | (F.col(status) == F.col("_final"))).drop("_at", "_final")


def keep_published(attempts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A failed re-read leaves the last good revision published."""
    return latest(attempts, [key], order, F.col("status").isin("completed", "partial"))


def move_membership(current: DataFrame, moves: DataFrame, order: Sequence[str]) -> DataFrame:
    """One collection per moved paper: its last move, or none when that names none."""
    last = latest(moves, ["paper_id"], order)
    kept = current.join(last.select("paper_id"), "paper_id", "left_anti")
    return kept.unionByName(last.where("collection_id is not null").select(*current.columns))


def activate_compressions(items: DataFrame, requests: DataFrame, compressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Switch items to a compression whose source hash is still current; the rest is refused."""
    asked = requests.join(compressions.select(F.col("id").alias("compression_id"), "context_item_id", "source_hash", F.col("estimated_tokens").alias("compressed_tokens")), "compression_id")
    current = items.select(F.col("id").alias("context_item_id"), F.col("source_hash").alias("current_hash"))
    checked = asked.join(current, "context_item_id")
    good = first_rows(checked.where("source_hash = current_hash"), ["context_item_id"], [F.col("requested_at").desc()])
    switched = good.select(F.col("context_item_id").alias("id"), F.col("compression_id").alias("active_compression_id"), "compressed_tokens")
    joined = items.drop("active_compression_id").join(switched, "id", "left")
    out = joined.withColumn("mode", F.when(F.col("active_compression_id").isNotNull(), "compressed").otherwise(F.col("mode")))
    out = out.withColumn("estimated_tokens", F.coalesce("compressed_tokens", "estimated_tokens")).drop("compressed_tokens")
    return out, checked.where("source_hash <> current_hash")


def merge_manual(old: DataFrame, parsed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Parsed metadata with the old manual overrides put back; the title prefers an override.

    ``old(paper_id, manual)`` holds the overrides as a JSON object.
    """
    from lectern.functions.jsontext import overriding

    joined = parsed.join(old.select("paper_id", "manual"), "paper_id", "left")
    parsed_json = F.to_json(F.struct(*fields))
    columns = [overriding(parsed_json, F.coalesce("manual", F.lit("{}")), f).alias(f) for f in fields]
    return joined.select("paper_id", *columns, "manual")


def runs_per_profile(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest runs per profile with ties kept, and one row per profile: the last id of a tie."""
    top = runs.groupBy("profile_id").agg(F.max("created_at").alias("created_at"))
    tied = runs.join(top, ["profile_id", "created_at"])
    return tied, tied.groupBy("profile_id").agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


def question_revisions(history: DataFrame, key: str, order: Sequence[str], blocks: Sequence[str], message: str, snapshot: str) -> DataFrame:
    """A turn's question revision at each save: it grows when message or snapshot changed."""
    digest = F.sha2(F.to_json(F.struct(F.col(message), F.col(snapshot))), 256)
    seen = running(history.withColumn("_d", digest), [key], order, blocks, {"_before": ("last", F.col("_d"))}, inclusive=False)
    changed = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_d")), 1).otherwise(0)
    return running(seen, [key], order, blocks, {"question_revision": ("sum", changed)}).drop("_d", "_before")


def backfill_annotations(records: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Latest record per key as an annotation row of the given kind."""
    newest = latest(records, keys, ["revision", "id"])
    return newest.select("paper_id", "block_id", "source_start", "source_end", F.lit(kind).alias("annotation_type"), F.col("id").alias("related_id"))


def backfill_collections(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collection names of imported papers as nodes (names compare case-insensitively) and memberships."""
    folded = sources.where("collection_name is not null").withColumn("_name", F.lower(F.trim("collection_name")))
    nodes = folded.groupBy("_name").agg(F.min(F.trim("collection_name")).alias("name"), F.min("created_at").alias("created_at"))
    nodes = nodes.withColumn("id", F.concat(F.lit("collection-"), F.left(F.sha2("_name", 256), F.lit(16))))
    members = folded.join(nodes.select("_name", "id"), "_name").groupBy("paper_id", F.col("id").alias("collection_id")).agg(F.min("created_at").alias("assigned_at"))
    return nodes.drop("_name"), members


def recover_interrupted(rows: DataFrame, status: str, transient: Sequence[str], to: str, note: str, message: str, keep_first: bool = False) -> DataFrame:
    """Rewrite unfinished states after a stop; running it twice changes nothing more."""
    hit = F.col(status).isin(*transient)
    text = F.coalesce(F.col(message), F.lit(note)) if keep_first else F.lit(note)
    return rows.withColumn(message, F.when(hit, text).otherwise(F.col(message))).withColumn(status, F.when(hit, F.lit(to)).otherwise(F.col(status)))


def validate_papers(rows: DataFrame) -> DataFrame:
    """Rule violations per row; an empty array means accepted."""
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    broken = [
        F.when(title == "", "title_empty"),
        F.when(F.length(title) > 500, "title_long"),
        F.when(F.col("year").isNotNull() & ~F.col("year").between(1000, 2100), "year_range"),
        F.when(F.length("doi") > 300, "doi_long"),
        F.when(F.length("abstract") > 20000, "abstract_long"),
        F.when(F.length("venue") > 500, "venue_long"),
    ]
    names = F.filter(F.transform("authors", lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: a != "")
    tags = F.array_distinct(F.filter(F.transform("tags", lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: a != ""))
    return rows.select(
        *[c for c in rows.columns if c not in ("title", "authors", "tags")],
        title.alias("title"), F.slice(names, 1, 100).alias("authors"), F.slice(tags, 1, 50).alias("tags"), F.array_compact(F.array(*broken)).alias("violations"),
    )


def reading_violations(progress: Column, page: Column) -> Column:
    return F.array_compact(F.array(
        F.when(progress.isNotNull() & ~progress.between(0, 1), "progress_range"), F.when(page.isNotNull() & (page < 1), "page_range")))


def collection_violations(name: Column, color: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.array_compact(F.array(
        F.when((clean == "") | (F.length(clean) > 120), "name_length"),
        F.when(clean.rlike(r"[\\/\x00]"), "name_separator"),
        F.when(~F.lower(F.coalesce(color, F.lit("#4f6bed"))).rlike("^#[0-9a-f]{6}$"), "color_format"),
    ))


def inside_root(path: Column, root: str, suffix: str = ".pdf") -> Column:
    """Path under the root (no ``..``) with the wanted suffix."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & ~path.rlike(r"(^|/)\.\.(/|$)") & F.lower(path).endswith(suffix)
