"""Building blocks that keep a group with a third of all rows out of one task.

* ``running``       prefix aggregates per key, computed block by block
* ``number_rows``   row numbers per key with no natural blocks (range partitions)
* ``number_children`` the same for keys of which few are large
* ``pairs_within``  pairs of members of a group, with the work of a large group split
* ``assemble_text`` ordered text of a key as one value
* ``placed_text``   ordered text of a key as pieces with their places
* ``contains_pairs`` substring join made of equi-joins

Rank filters (``row_number() <= k``) need no help: Spark limits every map partition to k
rows per key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed

PAIR_CHUNK = 256
GRAM = 24
TINY, SALTS = 3, 64
LARGE = 1_000_000


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key; planned with a map-side group limit."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def _local(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value).over(window), F.lit(0))
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _total(kind: str, value: Column, position: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    return F.max(value) if kind == "max" else F.max_by(value, F.when(value.isNotNull(), position))


def _combine(kind: str, here: Column, earlier: Column) -> Column:
    if kind == "sum":
        return here + F.coalesce(earlier, F.lit(0))
    return F.greatest(here, earlier) if kind == "max" else F.coalesce(here, earlier)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (nulls skipped) per key in ``order``.

    ``blocks`` are columns of ``df``, finest first: each must be non-decreasing in ``order``
    within a key, and each coarser one a function of the finer.  A task sees the rows of one
    (key, block); block totals are combined by the same rule one level up, so no task ever
    sees a whole key unless the key has few coarse blocks.
    ``values`` maps an output column to ``(kind, expression)``.
    """
    edge = 0 if inclusive else -1
    if not blocks:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, edge)
        return df.select("*", *[_local(k, v, window).alias(n) for n, (k, v) in values.items()])

    inputs = {n: f"_in_{n}" for n in values}
    staged = df.select("*", *[v.alias(inputs[n]) for n, (_, v) in values.items()])
    block_keys = [*keys, *blocks]
    position = F.struct(*order)
    totals = staged.groupBy(*block_keys).agg(
        *[
            _total(kind, F.col(inputs[n]), position).alias(inputs[n])
            for n, (kind, _) in values.items()
        ]
    )
    before = {n: f"_before_{n}" for n in values}
    prefixes = running(
        totals, keys, [blocks[0]], blocks[1:], {before[n]: (kind, F.col(inputs[n])) for n, (kind, _) in values.items()}, inclusive=False
    ).select(*block_keys, *before.values())
    window = Window.partitionBy(*block_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, edge)
    local = staged.select("*", *[_local(k, F.col(inputs[n]), window).alias(f"_local_{n}") for n, (k, _) in values.items()])
    joined = local.join(prefixes, on=block_keys, how="left")
    out = []
    for name, (kind, _) in values.items():
        here, earlier = F.col(f"_local_{name}"), F.col(before[name])
        out.append(_combine(kind, here, earlier).alias(name))
    return joined.select(*df.columns, *out)


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with a block column ``_range`` for orders without natural blocks.

    Rows are range-partitioned by (key, order) and checkpointed, so a partition number is a
    stable block: it survives executor loss, and a hot key spreads over many partitions.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return checkpointed(ranged.withColumn("_range", F.spark_partition_id()))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based row number per key over ``range_blocks``."""
    return running(range_blocks(df, keys, order), keys, order, ["_range"], {name: ("sum", F.lit(1))}).drop("_range")


def number_children(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", large: int = LARGE) -> DataFrame:
    """``number_rows`` for rows that are cheap to read again and keys of which few are large.

    The keys are counted first.  Keys of up to ``large`` rows are numbered in one window, so their rows are shuffled once and
    never written; the rows of the others, if there are any, are numbered over ``range_blocks``.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    hot = checkpointed(hot)
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias(name)
    if hot.isEmpty():
        return df.select("*", numbered)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    usual = df.join(hot, same, "left_anti").select("*", numbered)
    return usual.unionByName(number_rows(df.join(hot, same, "left_semi"), keys, order, name))


def pairs_within(members: DataFrame, group: Sequence[str], item: str, order: str, chunk: int = PAIR_CHUNK, rare: bool = False) -> DataFrame:
    """Ordered pairs ``(left_item, right_item)`` of members that share a group value.

    The left side of a group of n members is dealt into ceil(n / chunk) buckets and the right
    side is copied to each of them, so one task compares at most about chunk x n members.
    Only pairs that belong to the result are produced.  With ``rare`` few of the members share a group:
    the shared groups are written first, and only their members go further, so no task sorts all members.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if rare:
        sizes = checkpointed(sizes)
        members = members.join(sizes, list(group), "left_semi")
    sized = members.join(sizes, on=list(group)).withColumn("_buckets", F.ceil(F.col("_n") / F.lit(chunk)).cast("int")).drop("_n")
    sized = checkpointed(sized) if rare else sized
    left = sized.select(
        *group,
        F.pmod(F.hash(item, order), F.col("_buckets")).alias("_bucket"),
        F.col(item).alias(f"left_{item}"),
        F.col(order).alias("_left_order"),
    )
    right = sized.select(
        *group,
        F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("_bucket"),
        F.col(item).alias(f"right_{item}"),
        F.col(order).alias("_right_order"),
    )
    joined = left.join(right, on=[*group, "_bucket"]).where(F.col("_left_order") < F.col("_right_order"))
    return joined.drop("_bucket", "_left_order", "_right_order")


def assemble_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = "\n\n") -> DataFrame:
    """One row per key: its texts in order as ``body``, and their number.

    For keys whose whole text is one value by nature (a message, a conversation, a call).
    """
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_piece"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["_piece"]), separator).alias("body"), F.count(F.lit(1)).alias("n_pieces"))


def placed_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[str], text: str, separator: str = "\n\n") -> DataFrame:
    """The pieces of every key's text, each with ``start``, its place in the whole text.

    For keys that may hold any share of all rows: the whole text is these rows in order, at every size.
    """
    measured = rows.withColumn("_chars", F.length(text).cast("long") + len(separator))
    return running(measured, keys, order, blocks, {"start": ("sum", F.col("_chars"))}, inclusive=False).drop("_chars")


def exploded(df: DataFrame, array: Column | str, name: str, *keep: Column | str, pos: str | None = None) -> DataFrame:
    """One row per (non-null) element of an array.

    The outer form is used on purpose: for a plain ``explode`` Spark infers a filter on the
    array's size and pushes it down, so an expensive array would be computed twice.
    """
    rows = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, rows).where(F.col(name).isNotNull())


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` characters."""
    width = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(
        F.length(text) >= width,
        F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, width))),
    ).otherwise(F.array().cast("array<string>"))


def contains_pairs(needles: DataFrame, hays: DataFrame, needle: str, hay: str, gram: int = GRAM) -> DataFrame:
    """All ``(needle, hay)`` with the needle a substring of the hay; both inputs distinct.

    A needle shorter than ``gram`` is looked up whole among the hay's substrings of the same
    length.  A longer one is looked up by its rarest ``gram``-character piece, so a common
    opening does not pull in every text that shares it.  Every join is an equi-join.
    """
    needles = needles.select(needle).where(F.length(needle) > 0)
    hays = hays.select(hay)

    # A needle of one to three characters lies in very many hays: it is copied to every salt, and hays are dealt among them.
    # There are only so many of these as the alphabet gives.
    salted = F.col("_n") <= TINY
    short = needles.where(F.length(needle) < gram).withColumn("_n", F.length(needle))
    salts = F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = short.select(needle, "_n", F.explode(salts).alias("_salt"))
    # One row per hay and length in use (no more than ``gram`` - 1 lengths, hence the hint); its substrings of that length follow,
    # at the salt of the hay, one row per place.  A substring that occurs again counts at its first place only.
    lengths = F.sequence(F.lit(1), F.least(F.length(hay), F.lit(gram - 1)))
    wanted = short.select("_n").distinct()
    sized = exploded(hays.where(F.length(hay) > 0), lengths, "_n", hay).join(F.broadcast(wanted), on="_n")
    sized = sized.withColumn("_salt", F.when(salted, F.pmod(F.xxhash64(hay), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    places = exploded(sized, F.sequence(F.lit(1), F.length(hay) - F.col("_n") + 1), "_at", hay, "_n", "_salt")
    cut = places.select(F.substring(F.col(hay), F.col("_at"), F.col("_n")).alias(needle), hay, "_n", "_salt", "_at")
    short_hits = cut.join(dealt, on=[needle, "_n", "_salt"]).where(F.call_function("instr", F.col(hay), F.col(needle)) == F.col("_at")).select(needle, hay)

    # Only pieces that some needle owns are rated: the hays' other pieces go no further than the map stage's join.
    own = exploded(needles.where(F.length(needle) >= gram), grams(F.col(needle), gram), "_g", needle)
    owned = own.select("_g").distinct()
    pieces = exploded(hays.where(F.length(hay) >= gram), grams(F.col(hay), gram), "_g", hay)
    frequency = pieces.join(owned, "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    anchors = (
        own.join(frequency, on="_g")
        .groupBy(needle)
        .agg(F.min(F.struct(F.col("_f").alias("f"), F.col("_g").alias("g"))).alias("_a"), F.count(F.lit(1)).alias("_found"))
        .join(needles.select(needle, F.size(grams(F.col(needle), gram)).alias("_pieces")), needle)
        .where("_found = _pieces")
        .select(needle, F.col("_a.g").alias("_g"))
    )
    long_hits = pieces.join(anchors, on="_g").where(F.contains(F.col(hay), F.col(needle))).select(needle, hay)
    return short_hits.unionByName(long_hits)
