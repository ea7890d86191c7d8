"""Tolerant reading of recognition results: text that should hold one JSON object becomes typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import box
from foliospark.functions.names import free
from foliospark.functions.text import direction

PAGE = "struct<direction:string,blocks:array<struct<text:string,type:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,lines:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>"


def payload(c: Column) -> Column:
    """The JSON of a response as a variant: code fences and a leading word ``json`` go; if the rest isn't JSON, what stands
    between the first and the last brace is tried; null if that isn't JSON either."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s*```|```\s*\z", ""))
    t = F.regexp_replace(t, r"\A(?i:json)\s*", "")
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


def kind(v: Column) -> Column:
    """ARRAY, OBJECT or a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def coerce_string(v: Column) -> Column:
    """Null becomes empty, an array its first entry; objects and numbers their JSON text."""
    whole = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    first = F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.lit(""))
    return F.when(v.isNull(), "").when(kind(v) == "ARRAY", first).otherwise(whole)


def coerce_box(v: Column) -> Column:
    """An array's first four numbers, all of them or none; an object's x0, y0, x1, y1, missing ones zero, but all zero if one is null or
    no number; else zeros. Numeric strings count as numbers."""
    zeros = box(*[F.lit(0.0)] * 4)
    listed = [F.try_variant_get(v, f"$[{i}]", "double") for i in range(4)]
    named = [(F.try_variant_get(v, f"$.{n}", "double"), F.try_variant_get(v, f"$.{n}", "variant")) for n in ("x0", "y0", "x1", "y1")]
    whole, bad = F.lit(True), F.lit(False)
    for n in listed:
        whole = whole & n.isNotNull()
    for n, member in named:
        bad = bad | (n.isNull() & member.isNotNull())
    return (
        F.when(v.isNull(), zeros).when(kind(v) == "ARRAY", F.when(whole, box(*listed)).otherwise(zeros))
        .when(kind(v) == "OBJECT", F.when(bad, zeros).otherwise(box(*[F.coalesce(n, F.lit(0.0)) for n, _ in named]))).otherwise(zeros)
    )


def _entries(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def lines_of(v: Column) -> Column:
    """The objects with a text that isn't empty."""
    objects = F.filter(_entries(v, "$.lines"), lambda x: kind(x) == "OBJECT")
    typed = F.transform(objects, lambda x: F.struct(coerce_string(F.try_variant_get(x, "$.text", "variant")).alias("text"), coerce_box(F.try_variant_get(x, "$.bbox", "variant")).alias("bbox")))
    return F.filter(typed, lambda x: x["text"] != "")


def normalize(v: Column) -> Column:
    """A page: direction and blocks. What isn't an object is an empty page; blocks that aren't objects go; a type that is missing is
    empty (``layout_type`` calls it unknown)."""
    objects = F.filter(_entries(v, "$.blocks"), lambda x: kind(x) == "OBJECT")
    blocks = F.transform(
        objects,
        lambda x: F.struct(
            coerce_string(F.try_variant_get(x, "$.text", "variant")).alias("text"),
            coerce_string(F.try_variant_get(x, "$.type", "variant")).alias("type"),
            coerce_box(F.try_variant_get(x, "$.bbox", "variant")).alias("bbox"),
            lines_of(x).alias("lines"),
        ),
    )
    page = F.struct(direction(coerce_string(F.try_variant_get(v, "$.direction", "variant"))).alias("direction"), blocks.alias("blocks"))
    empty = F.struct(F.lit("horizontal").alias("direction"), F.filter(blocks, lambda x: F.lit(False)).alias("blocks"))
    return F.when(F.coalesce(kind(v) == "OBJECT", F.lit(False)), page).otherwise(empty)


def export(v: Column) -> Column:
    """A page as the JSON text that a cache entry is given out as: every value coerced, boxes as arrays, direction and types as they were
    written (horizontal if there is no direction)."""
    own = normalize(v)
    listed = lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])
    line = lambda x: F.struct(x["text"].alias("text"), listed(x["bbox"]).alias("bbox"))
    blocks = F.transform(own["blocks"], lambda b: F.struct(b["text"].alias("text"), b["type"].alias("type"), listed(b["bbox"]).alias("bbox"), F.transform(b["lines"], line).alias("lines")))
    given = F.try_variant_get(v, "$.direction", "variant")
    written = F.when(F.coalesce(kind(v) == "OBJECT", F.lit(False)) & given.isNotNull(), coerce_string(given)).otherwise("horizontal")
    return F.to_json(F.struct(written.alias("direction"), blocks.alias("blocks")))


def parse_pages(raw: DataFrame, column: str = "payload") -> DataFrame:
    """``raw`` with its responses replaced by ``page_result``. The variant is a column of its own behind a filter that keeps every row, which
    the optimizer doesn't look into: so each response is parsed once, not once for every use of it. Filters on other columns should come
    before, as they aren't pushed through it."""
    (variant,) = free(raw, "variant")
    parsed = raw.withColumn(variant, payload(F.col(column))).filter(F.rand(0) >= 0)
    return parsed.withColumn("page_result", normalize(F.col(variant))).drop(column, variant)
