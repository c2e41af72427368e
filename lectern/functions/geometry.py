"""Rectangles as struct(x0, y0, x1, y1) in points; origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    across = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((across > 0) & (down > 0), across * down).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies under ``b``."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def normalized_box(r: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct(
        F.greatest(F.lit(0.0), r["x0"] / page_w).alias("left"),
        F.greatest(F.lit(0.0), r["y0"] / page_h).alias("top"),
        F.least(F.lit(1.0), r["x1"] / page_w).alias("right"),
        F.least(F.lit(1.0), r["y1"] / page_h).alias("bottom"),
    )


def is_marginal(r: Column, text: Column, page_w: Column, page_h: Column, digits: int | None = 5) -> Column:
    """Header, footer, side strip or bare page number of at most ``digits`` digits (``None``: any number)."""
    edge = (r["y1"] < page_h * 0.07) | (r["y0"] > page_h * 0.925)
    strip = (height(r) > page_h * 0.55) & (width(r) < page_w * 0.08)
    return edge | strip | text.rlike(rf"(?i)^(?:page\s*)?\d{{1,{digits or ''}}}$")


def is_page_raster(image_w: Column, image_h: Column, page_w: Column, page_h: Column) -> Column:
    """An image with the page's shape that covers most of it at 200 dots per inch."""
    full_w, full_h = page_w * 200 / 72, page_h * 200 / 72
    page_aspect = page_w / page_h
    same = F.abs(image_w / image_h - page_aspect) / page_aspect < 0.035
    covers = (image_w >= full_w * 0.72) & (image_h >= full_h * 0.72)
    usable = (image_w >= 1) & (image_h >= 1) & (page_w > 0) & (page_h > 0)
    return F.coalesce(usable & same & (covers | ((image_w * image_h) / (full_w * full_h) >= 0.62)), F.lit(False))
