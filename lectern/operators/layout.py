"""Page geometry: block filters, clusters, caption regions, reading order.

``layout(paper_id, page, page_w, page_h, block_id, rect struct(x0,y0,x1,y1), text)``.  A page holds a
bounded number of blocks, so a page is the largest group anything here works on; joins carry
the (paper, page) equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions.markup import FIGURE_CAPTION, TABLE_CAPTION, expected_columns
from lectern.functions.text import collapse, heading
from lectern.skew import exploded

PAGE = ["paper_id", "page"]


def body_blocks(layout: DataFrame, boxes: DataFrame | None = None, share: float = 0.28, digits: int | None = 5) -> DataFrame:
    """Blocks outside the margins, not blank, no page number (of at most ``digits`` digits; ``None``: any), and not mostly under a table or figure box."""
    text = F.trim(F.regexp_replace("text", r"[ \t]+", " "))
    kept = layout.withColumn("text", text).where((F.col("text") != "") & ~G.is_marginal(F.col("rect"), F.col("text"), F.col("page_w"), F.col("page_h"), digits))
    if boxes is None:
        return kept
    covered = kept.join(boxes.select(*PAGE, F.col("rect").alias("box")), PAGE).where(G.overlap_ratio(F.col("rect"), F.col("box")) > share)
    return kept.join(covered.select(*PAGE, "block_id").distinct(), [*PAGE, "block_id"], "left_anti")


def lanes(blocks: DataFrame) -> DataFrame:
    """Full-width blocks lead or trail the columns; left column before right."""
    r = F.col("rect")
    full = (r["x0"] < F.col("page_w") * 0.25) & (r["x1"] > F.col("page_w") * 0.75)
    marked = blocks.withColumn("_full", full)
    top = F.min(F.when(~F.col("_full"), r["y0"])).over(Window.partitionBy(*PAGE))
    lead = F.col("_full") & (r["y0"] <= F.coalesce(top, F.col("page_h")) + 12)
    lane = F.when(lead, 0).when(F.col("_full"), 3).when(r["x0"] < F.col("page_w") / 2, 1).otherwise(2)
    return marked.withColumn("lane", lane).drop("_full")


def lane_clusters(blocks: DataFrame, gap: float = 38.0, height_ratio: float = 0.43) -> DataFrame:
    """Nearby blocks of a lane merged into regions of bounded height, in reading order.

    Whether a block joins depends on the region grown so far, so the blocks of a page lane are
    folded in order by an array aggregate.  Equal or tiny regions are dropped.
    """
    shape = "struct<y0:double,x0:double,y1:double,x1:double,text:string>"
    block = F.struct("rect.y0", "rect.x0", "rect.y1", "rect.x1", "text")
    pages = lanes(blocks).groupBy(*PAGE, "page_h", "lane").agg(F.array_sort(F.collect_list(block)).alias("bs"))
    start = F.struct(F.array().cast(f"array<{shape}>").alias("done"), F.lit(None).cast(shape).alias("open"))

    def step(acc: Column, b: Column) -> Column:
        o = acc["open"]
        joins = F.coalesce((b["y0"] - o["y1"] <= gap) & (F.greatest(o["y1"], b["y1"]) - F.least(o["y0"], b["y0"]) <= F.col("page_h") * height_ratio), F.lit(False))
        merged = F.struct(
            F.least(o["y0"], b["y0"]).alias("y0"), F.least(o["x0"], b["x0"]).alias("x0"), F.greatest(o["y1"], b["y1"]).alias("y1"), F.greatest(o["x1"], b["x1"]).alias("x1"),
            F.concat(o["text"], F.lit("\n"), b["text"]).alias("text"))
        closed = F.when(joins | o.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(o)))
        return F.struct(closed.alias("done"), F.when(joins, merged).otherwise(b).alias("open"))

    regions = F.aggregate("bs", start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    rows = exploded(pages, regions, "r", *PAGE, "lane", pos="_i").select(*PAGE, "lane", "_i", "r.*")
    wide = rows.where((F.col("x1") - F.col("x0") >= 40) & (F.col("y1") - F.col("y0") >= 12))
    box = [F.bround(c, 0) for c in ("x0", "y0", "x1", "y1")]
    order = [F.col("lane"), F.col("_i")]
    once = wide.withColumn("_same", F.row_number().over(Window.partitionBy(*PAGE, *box).orderBy(*order))).where("_same = 1").drop("_same")
    return once.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))).drop("_i")


def gap_islands(blocks: DataFrame, gap: float = 38.0) -> DataFrame:
    """Clusters by vertical gap alone (no height cap): a running sum of breaks per lane."""
    w = Window.partitionBy(*PAGE, "lane").orderBy("rect.y0", "rect.x0", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bottom = F.max("rect.y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = lanes(blocks).withColumn("_new", F.when(F.col("rect.y0") - bottom > gap, 1).otherwise(0))
    return flagged.withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def formula_regions(hits: DataFrame) -> DataFrame:
    """Regions of numbered display formulas from right-aligned ``(n)`` hits.

    ``hits(paper_id, page, page_w, page_h, rect, number)``; one region per page lane.
    """
    r, center = F.col("rect"), F.col("page_w") / 2
    lane = F.when(r["x0"] < center, 0).otherwise(1)
    right = F.when(lane == 0, center - 8).otherwise(F.col("page_w") - 48)
    aligned = hits.withColumn("lane", lane).where(r["x0"] >= right - 24)
    g = aligned.groupBy(*PAGE, "page_w", "page_h", "lane").agg(F.min("rect.y0").alias("top"), F.max("rect.y1").alias("bottom"), F.array_sort(F.collect_set("number")).alias("numbers"))
    return g.select(
        *PAGE, "lane",
        F.struct(
            F.when(F.col("lane") == 0, F.lit(28.0)).otherwise(F.col("page_w") / 2 + 8).alias("x0"), F.greatest(F.lit(28.0), F.col("top") - 34).alias("y0"),
            F.when(F.col("lane") == 0, F.col("page_w") / 2 - 8).otherwise(F.col("page_w") - 28).alias("x1"), F.least(F.col("page_h") * 0.925, F.col("bottom") + 18).alias("y1"),
        ).alias("rect"), "numbers",
    )


def union_box(prefix: str = "") -> list[Column]:
    r = F.col("rect")
    return [F.min(r["x0"]).alias(f"{prefix}x0"), F.min(r["y0"]).alias(f"{prefix}y0"), F.max(r["x1"]).alias(f"{prefix}x1"), F.max(r["y1"]).alias(f"{prefix}y1")]


def captions(layout: DataFrame, pattern: str) -> DataFrame:
    text = collapse(F.col("text"))
    found = layout.withColumn("text", text).where(F.regexp_extract("text", pattern, 1) != "")
    above = F.lag("rect.y1").over(Window.partitionBy(*PAGE).orderBy("rect.y1", "rect.x0", "block_id"))
    return found.select(*PAGE, "page_w", "page_h", F.col("block_id").alias("caption_id"), F.col("rect").alias("c"), F.col("text").alias("caption"), F.coalesce(above, F.lit(0.0)).alias("above"))


def figure_boxes(layout: DataFrame, graphics: DataFrame) -> DataFrame:
    """The picture above each figure caption.

    The graphics in a caption's window give the box: below the previous caption, within 45 % of the page height, in the
    caption's column (20 % overlap, any for a wide caption), at most 28 % of the page each.  A caption without any, as on a scanned
    page, takes the cluster of text blocks above it instead.  Either box then grows block by block down to the caption.
    """
    caps = captions(layout, FIGURE_CAPTION)
    g = F.col("rect")
    c, w, h = F.col("c"), F.col("page_w"), F.col("page_h")
    wide = G.width(c) >= w * 0.55
    across = F.least(g["x1"], c["x1"]) - F.greatest(g["x0"], c["x0"])
    fits = (
        (G.width(g) >= 3) & (G.height(g) >= 3) & (G.area(g) <= w * h * 0.28) & (g["y0"] >= F.greatest(F.col("above"), c["y0"] - h * 0.45))
        & (g["y1"] <= c["y0"] + 2) & (wide | (across > F.least(G.width(g), G.width(c)) * 0.2))
    )
    key = [*PAGE, "page_w", "page_h", "caption_id", "caption", "c"]
    shapes = graphics.select(F.col("paper_id").alias("_paper"), F.col("page").alias("_page"), "rect")
    pictured = caps.join(shapes, (F.col("paper_id") == F.col("_paper")) & (F.col("page") == F.col("_page")) & fits, "left").groupBy(*key).agg(*union_box("g_"))

    b = F.col("block")
    blocks = layout.select(
        F.col("paper_id").alias("_paper"), F.col("page").alias("_page"),
        F.struct("rect.y1", "rect.x0", "block_id", "rect.y0", "rect.x1", F.length(collapse(F.col("text"))).alias("chars")).alias("block"))
    over = (F.col("paper_id") == F.col("_paper")) & (F.col("page") == F.col("_page")) & (b["y1"] <= c["y0"] + 2)
    box = F.when(F.col("g_x0").isNotNull(), F.struct(*[F.col(f"g_{e}").alias(e) for e in ("x0", "y0", "x1", "y1")]))
    held = pictured.select(*key, box.alias("box")).join(blocks, over, "left").groupBy(*key, "box").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    seeded = held.withColumn("seed", F.coalesce("box", _walk_up(F.col("blocks"), c, w, h, wide)))
    clipped = seeded.where("seed is not null").select(*PAGE, "page_w", "page_h", "caption_id", "caption", _grow(F.col("blocks"), F.col("seed")).alias("clip"))
    return _padded(clipped, 6, 6, 6).where((G.width(F.col("box")) >= 72) & (G.height(F.col("box")) >= 40)).select(*PAGE, "caption_id", "caption", "box", "page_w", "page_h")


def _joined(a: Column, b: Column) -> Column:
    """The smallest box around both (least and greatest pass over nulls)."""
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def _walk_up(blocks: Column, c: Column, w: Column, h: Column, wide: Column) -> Column:
    """The cluster of text blocks above a caption, in its column and within 28 % of the page height.

    From the lowest up: a gap of over 24 ends the cluster, as does a wide block of running text.
    """
    half, right = w / 2, c["x0"] >= w / 2
    begin, end = F.when(wide | ~right, F.lit(0.0)).otherwise(half), F.when(wide | right, w).otherwise(half)
    prior = F.filter(blocks, lambda b: (b["y0"] >= c["y0"] - h * 0.28) & (F.least(b["x1"], end) - F.greatest(b["x0"], begin) > F.least(b["x1"] - b["x0"], half) * 0.2) & (b["chars"] > 0))
    lowest_first = F.array_sort(F.transform(prior, lambda b: F.struct((-b["y1"]).alias("up"), b["x0"].alias("x0"), b["block_id"].alias("block_id"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["chars"].alias("chars"))))
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    start = F.struct(none.alias("box"), c["y0"].alias("cursor"), F.lit(True).alias("open"))

    def step(acc: Column, b: Column) -> Column:
        stops = (acc["box"].isNotNull() & (acc["cursor"] - b["y1"] > 24)) | ((b["chars"] > 260) & (b["x1"] - b["x0"] > half * 0.72))
        takes = acc["open"] & ~stops
        return F.struct(
            F.when(takes, _joined(F.coalesce(acc["box"], F.struct(*[b[e].alias(e) for e in ("x0", "y0", "x1", "y1")])), b)).otherwise(acc["box"]).alias("box"),
            F.when(takes, F.least(acc["cursor"], b["y0"])).otherwise(acc["cursor"]).alias("cursor"), takes.alias("open"))

    return F.aggregate(lowest_first, start, step, lambda acc: acc["box"])


def _grow(blocks: Column, seed: Column) -> Column:
    """The box after taking in, in reading order, every block that reaches into it or lies below it."""
    near = lambda clip, b: (b["y0"] >= clip["y0"] - 12) & (F.least(b["x1"], clip["x1"]) - F.greatest(b["x0"], clip["x0"]) > 0)
    return F.aggregate(blocks, seed, lambda clip, b: F.when(near(clip, b), _joined(clip, b)).otherwise(clip))


def _padded(boxes: DataFrame, side: float, top: float, bottom: float) -> DataFrame:
    b = F.col("clip")
    return boxes.withColumn("box", F.struct(
        F.greatest(F.lit(0.0), b["x0"] - side).alias("x0"), F.greatest(F.lit(0.0), b["y0"] - top).alias("y0"),
        F.least(F.col("page_w"), b["x1"] + side).alias("x1"), F.least(F.col("page_h"), b["y1"] + bottom).alias("y1"))).drop("clip")


def table_bodies(layout: DataFrame) -> DataFrame:
    """The table below each table caption: blocks within 34 % of the page height in its
    column, up to the next heading once there is content; odd sizes are dropped."""
    caps = captions(layout, TABLE_CAPTION)
    blocks = layout.select(*PAGE, "block_id", "rect", collapse(F.col("text")).alias("text"))
    c, r, w, h = F.col("c"), F.col("rect"), F.col("page_w"), F.col("page_h")
    near = caps.join(blocks, PAGE).where(
        (r["y0"] >= c["y1"] - 2) & (r["y0"] <= c["y1"] + h * 0.34) & (F.col("block_id") != F.col("caption_id")) & (F.col("text") != ""))
    across = F.least(r["x1"], c["x1"]) - F.greatest(r["x0"], c["x0"])
    near = near.withColumn("_inside", (across > F.least(G.width(r), G.width(c)) * 0.15).cast("int")).withColumn("_head", heading(F.col("text")).isNotNull())
    group = Window.partitionBy(*PAGE, "caption_id").orderBy("rect.y0", "rect.x0", "block_id")
    before = F.coalesce(F.sum("_inside").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("_stop", (F.col("_head") & (before > 0)).cast("int"))
    near = near.withColumn("_stopped", F.max("_stop").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = near.where("_inside = 1 and _stopped = 0")
    lines = F.array_sort(F.collect_list(F.struct(F.col("rect.y0").alias("y"), F.col("rect.x0").alias("x"), "text")))
    g = body.groupBy(*PAGE, "page_w", "page_h", "caption_id", "caption", "c").agg(*union_box("b_"), F.array_join(F.transform(lines, lambda t: t["text"]), "\n").alias("source_text"))
    g = g.withColumn("clip", F.struct(F.least("b_x0", "c.x0").alias("x0"), F.least("b_y0", "c.y0").alias("y0"), F.greatest("b_x1", "c.x1").alias("x1"), F.greatest("b_y1", "c.y1").alias("y1")))
    out = _padded(g, 5, 4, 5)
    box = F.col("box")
    sized = out.where((G.width(box) >= 120) & (G.height(box) >= 45) & (G.area(box) <= w * h * 0.48))
    return sized.select(*PAGE, "caption_id", "caption", "box", "source_text", expected_columns(F.col("source_text")).alias("expected_columns"), "page_w", "page_h")


def reading_order(regions: DataFrame) -> DataFrame:
    """Regions by page and sequence; a table in the upper 40 % of its page leads it."""
    table = F.col("page") * 100 + F.when(F.col("top") < 0.4, 0).otherwise(90)
    ordered = regions.withColumn("sequence", F.when(F.col("kind") == "table", table).otherwise(F.col("page") * 100 + F.col("seq")))
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("sequence", "seq", "block_id")))


def page_rasters(images: DataFrame) -> DataFrame:
    """Images that are scans of the whole page."""
    return images.where(G.is_page_raster(F.col("image_w"), F.col("image_h"), F.col("page_w"), F.col("page_h")))
