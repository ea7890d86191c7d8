"""Sizes of embedded images, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_SIDE, LEAST_BYTES, SPANNING = 150, 5000, 0.6
_PNG, _JPEG, _FRAMES = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", (0xC0, 0xC1, 0xC2)


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        if data[at + 1] in _FRAMES:
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return 0, 0


def image_size(data: bytes | None) -> tuple[int, int]:
    """Width and height from a PNG's or a JPEG's header; zeros if it has none."""
    if data is None or len(data) < 24:
        return 0, 0
    if data.startswith(_PNG):
        return int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    return jpeg_size(data) if data.startswith(_JPEG) else (0, 0)


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for content in batches:
        yield pd.DataFrame([image_size(bytes(c) if c is not None else None) for c in content], columns=["width", "height"])


def png_size(content: Column) -> Column:
    """The size of a PNG without leaving the JVM."""
    side = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.struct(side(17).alias("width"), side(21).alias("height"))


def is_significant(width: Column, height: Column, n_bytes: Column) -> Column:
    return F.when((width == 0) & (height == 0), n_bytes > LEAST_BYTES).otherwise((width >= LEAST_SIDE) & (height >= LEAST_SIDE))


def spans_page(image_area: Column, page_area: Column) -> Column:
    return (page_area > 0) & F.coalesce(F.try_divide(F.abs(image_area), page_area) >= SPANNING, F.lit(False))
