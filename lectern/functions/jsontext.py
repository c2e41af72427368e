"""Tolerant reading of JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def object_keys(value: Column) -> Column:
    """Keys of a JSON object; none when the text is malformed or not an object."""
    return F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))


def tolerant_object(value: Column) -> Column:
    """The text itself when it is a JSON object, else ``{}``."""
    return F.when(F.json_object_keys(value).isNotNull(), value).otherwise(F.lit("{}"))


def tolerant_list(value: Column) -> Column:
    """A JSON list as an array of strings; anything else is empty."""
    return F.coalesce(F.filter(F.from_json(value, "array<string>"), lambda v: v.isNotNull()), F.array().cast("array<string>"))


def overriding(parsed: Column, manual: Column, key: str) -> Column:
    """The manual value when the key exists there, even as null; else the parsed value."""
    return F.when(F.array_contains(object_keys(manual), key), F.get_json_object(manual, f"$.{key}")).otherwise(F.get_json_object(parsed, f"$.{key}"))


def strip_fence(value: Column) -> Column:
    head = F.regexp_replace(F.trim(value), r"(?i)^```(?:json|markdown)?\s*", "")
    return F.trim(F.regexp_replace(head, r"\s*```$", ""))


def page_answer(response: Column) -> Column:
    """A recognised page: ``struct(markdown, confidence, regions)`` from JSON or plain text.

    Plain text has confidence 0.72; confidence is clamped; only boxes of the three kinds with
    ordered edges inside the page are kept.
    """
    text = strip_fence(response)
    shape = (
        "struct<markdown:string,confidence:double,"
        "regions:array<struct<kind:string,caption:string,sourceText:string,"
        "bbox:struct<left:double,top:double,right:double,bottom:double>>>>"
    )
    parsed = F.from_json(text, shape)
    is_json = F.json_object_keys(text).isNotNull()
    box = lambda r: r["bbox"]
    valid = F.filter(
        parsed["regions"],
        lambda r: r["kind"].isin("figure", "table", "formula")
        & (box(r)["left"] >= 0) & (box(r)["left"] < box(r)["right"]) & (box(r)["right"] <= 1)
        & (box(r)["top"] >= 0) & (box(r)["top"] < box(r)["bottom"]) & (box(r)["bottom"] <= 1),
    )
    empty = F.lit(None).cast("array<struct<kind:string,caption:string,sourceText:string,bbox:struct<left:double,top:double,right:double,bottom:double>>>")
    return F.struct(
        F.when(is_json, F.coalesce(parsed["markdown"], F.lit(""))).otherwise(text).alias("markdown"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(is_json, F.coalesce(parsed["confidence"], F.lit(0.72))).otherwise(F.lit(0.72)))).alias("confidence"),
        F.coalesce(F.when(is_json, valid), empty, F.array().cast(empty_type())).alias("regions"),
    )


def empty_type() -> str:
    return "array<struct<kind:string,caption:string,sourceText:string,bbox:struct<left:double,top:double,right:double,bottom:double>>>"


def formula_answer(response: Column) -> Column:
    """A repaired formula: ``struct(latex, confidence, valid)``."""
    parsed = F.from_json(strip_fence(response), "struct<repairedLatex:string,confidence:double>")
    latex = F.trim(F.coalesce(parsed["repairedLatex"], F.lit("")))
    even = F.regexp_count(latex, F.lit(r"\$")) % 2 == 0
    wrapped = (latex.startswith("$") & latex.endswith("$")) | (latex.startswith("\\[") & latex.endswith("\\]"))
    return F.struct(
        latex.alias("latex"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.0)))).alias("confidence"),
        ((latex != "") & even & ~latex.rlike("[�□]") & wrapped).alias("valid"),
    )
