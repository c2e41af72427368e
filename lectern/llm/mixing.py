"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in column expressions only.

A document gets the key ``-ln(u) / quality`` with ``u`` drawn from a hash of its id; ascending
keys are a weighted sample without replacement.  A source's budget is met by whole epochs
and then by the documents with the least keys, up to a cut-off found by blocked prefix sums.
The cut-offs (one row per source) are all that the second pass over the documents needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed
from lectern.skew import running

SPACE = r"\x20\x09-\x0D"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Documents in a block of the prefix sums, about.
BLOCK_ROWS = 5_000
#: Sources up to which their table (about 100 bytes a row) is broadcast; beyond, it is shuffled.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Share of letters in the text, 0.05 at least: the sampling weight of a document."""
    letters = F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text))
    return F.greatest(F.coalesce(letters, F.lit(0.0)), F.lit(0.05))


def sample_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    u = (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(u) / weight


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, row, size, key``, and ``_doc`` when ``docs`` has that; ``row`` is a number only once this is stored."""
    text, carried = F.col("text"), [c for c in docs.columns if c == "_doc"]
    rows = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), words(text).alias("size"), quality(text).alias("_q"), *carried)
    return rows.select("doc_id", "source", "row", "size", sample_key(F.col("doc_id"), F.col("_q")).alias("key"), *carried)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: ``source_size``, ``target``, whole ``turns`` and the words ``left`` after them.

    Sources in code-point order (null last) take the weights in turn.  A target is
    ``min(epochs * source_size, weight * level)`` with one level for all, which is where
    passing excess on by weight ends.  A row's ``_level`` supposes that the sources before it, by
    cap per weight, are capped; it falls again once that fails, so the largest that fits counts.  The windows see one row per source.
    """
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = stats.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(order), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(order), F.lit(0)))
    levels = weighed.withColumn("_level", level)
    reached = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(every)
    goal = F.least(F.col("_cap").cast("double"), F.col("_w") * reached)
    out = levels.select("source", "source_size", goal.alias("target"))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("turns", turns).withColumn("left", F.floor(F.col("target")).cast("long") - F.col("turns") * F.col("source_size"))


def cut_offs(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source with a fractional epoch: the document at which the budget ends, and the words it gives.

    Rows are dealt by sampled ranges of source and key and stored so; ``running`` sums within those blocks, so
    a source with a third of all rows is many blocks, whatever its keys are like.
    """
    count = rows.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    few = _bounded(goals.where("left > 0").select(F.col("source").alias("_s"), "left"))
    wanted = rows.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = wanted.select("doc_id", "row", "size", "key", "left", group.alias("_g"))
    ranged = keyed.repartitionByRange(blocks, "_g", "key", "doc_id", "row").withColumn("_block", F.spark_partition_id().cast("long"))
    keyed = checkpointed(ranged).withColumn("_coarse", F.floor(F.col("_block") / 1000))
    summed = running(keyed, ["_g"], ["key", "doc_id", "row"], ["_block", "_coarse"], {"_before": ("sum", F.col("size"))}, inclusive=False)
    last = summed.where("_before < left and _before + size >= left")
    return last.select("_g", F.struct("key", "doc_id", "row").alias("_at"), (F.col("left") - F.col("_before")).alias("_part"))


def _bounded(sources: DataFrame) -> DataFrame:
    """A table of one row per source, marked for broadcast where it was counted to be small enough."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def plan(rows: DataFrame) -> DataFrame:
    """One row per source, stored: ``targets`` with the cut-off."""
    goals = checkpointed(targets(rows))
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return checkpointed(goals.withColumn("_g", group).join(cut_offs(rows, goals), "_g", "left").drop("_g"))


def mixed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``turns``, ``part`` (words of the fractional epoch) and ``taken``."""
    right = _bounded(plans.withColumnRenamed("source", "_s"))
    joined = rows.join(right, F.col("source").eqNullSafe(F.col("_s")))
    here = F.struct("key", "doc_id", "row")
    part = F.when((F.col("left") <= 0) | F.col("_at").isNull(), F.lit(0).cast("long")).when(here < F.col("_at"), F.col("size")).when(here == F.col("_at"), F.col("_part")).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("part", part).withColumn("taken", F.col("turns") * F.col("size") + F.col("part")).drop("_s", "_at", "_part", "left")


def mix(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document.

    A null text has size 0 and gives nothing; a null source is a source; equal keys go by
    doc_id and then by row, so repeated rows are taken one after the other; an empty table
    gives no row.  Columns beyond doc_id, source and text are not looked at.
    """
    rows = checkpointed(sized(docs))
    return mixed(rows, plan(rows))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    chunks = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.when(n > 0, F.concat_ws("", F.slice(chunks, F.lit(1), n.cast("int")))).otherwise(F.lit(""))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: a document once per epoch that takes it; the one at a source's
    cut-off is cut after its last word within the budget."""
    keyed = checkpointed(sized(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))))
    taken = mixed(keyed, plan(keyed.drop("_doc")))
    copies = F.sequence(F.lit(1), F.col("turns").cast("int") + F.when(F.col("part") > 0, 1).otherwise(0))
    some = taken.where("turns > 0 or part > 0").withColumn("_turn", F.explode(copies))
    cut = (F.col("_turn") > F.col("turns")) & (F.col("part") < F.col("size"))
    text = F.when(cut, first_words(F.col("_doc.text"), F.col("part"))).otherwise(F.col("_doc.text"))
    return some.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")
