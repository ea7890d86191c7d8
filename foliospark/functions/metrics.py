"""Widths of characters, and lines broken by them.

A width is a share of the font size, in thousandths: full width for the scripts of East Asia, half width for their half-width forms, for
printable ASCII the metrics of the standard sans serif font, nothing for control characters and combining marks, and one width for all
other characters."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths of U+0020 to U+007E in the standard font Helvetica.
LATIN = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
# Ranges of characters of full and of half width, and of those without one.
FULL = ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x4DBF), (0x4E00, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x3FFFD))
HALF = ((0xFF61, 0xFFDC),)
NONE = ((0x0000, 0x001F), (0x007F, 0x009F), (0x0300, 0x036F))
OTHER = 600


def width_of(character: Column) -> Column:
    """The width of one character in thousandths; 0 for an empty text."""
    code = F.ascii(character)
    within = lambda ranges: reduce(or_, [code.between(a, b) for a, b in ranges])
    latin = F.get(F.array(*map(F.lit, LATIN)), code - 0x20)
    return F.when(code.between(0x20, 0x7E), latin).when(within(FULL), 1000).when(within(HALF), 500).when(within(NONE), 0).otherwise(OTHER)


def text_width(text: Column) -> Column:
    """The widths of a text's characters added up, in thousandths of the font size; 0 for null."""
    characters = F.split(F.coalesce(text, F.lit("")), "")
    return F.aggregate(characters, F.lit(0).cast("long"), lambda acc, c: acc + width_of(c))


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.full(0x40000, OTHER, np.int64)
    for ranges, width in ((FULL, 1000), (HALF, 500), (NONE, 0)):
        for a, b in ranges:
            out[a : b + 1] = width
    out[0x20 : 0x20 + len(LATIN)] = LATIN
    return out


def advances(text: str) -> np.ndarray:
    """The width of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return _table()[np.minimum(codes, 0x3FFFF)]


def break_line(line: str, size: float, width: float) -> list[str]:
    """``line`` cut before each character that would pass ``width``; a character wider than that has a line of its own. The widths'
    running sum is searched for each end."""
    ends = np.cumsum(advances(line))
    out, at, base = [], 0, 0
    most = width * 1000 / size if size > 0 else np.inf
    while at < len(line):
        to = int(np.searchsorted(ends, base + most, "right"))
        # the comparison that counts, as the division may round
        while to > at and (ends[to - 1] - base) * size / 1000 > width:
            to -= 1
        while to < len(line) and (ends[to] - base) * size / 1000 <= width:
            to += 1
        to = max(to, at + 1)
        out.append(line[at:to])
        at, base = to, int(ends[to - 1])
    return out


def wrapped_lines(text: str | None, size: float, width: float) -> list[str]:
    """A text's lines, each broken at ``width``; a blank one stays as an empty one, and there is one line at least."""
    out = []
    for line in (text or "").split("\n"):
        out += break_line(line, size, width) if line.strip() else [""]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap(text: pd.Series, size: pd.Series, width: pd.Series) -> pd.Series:
    """Lines of at most ``width`` by the widths of their characters."""
    return pd.Series([wrapped_lines(t, s, w) for t, s, w in zip(text, size, width)])


NOMINAL, LINE_FACTOR, LEAST, MOST = 12.0, 1.2, 3.0, 48.0


@F.pandas_udf(T.StructType([T.StructField("size", T.DoubleType()), T.StructField("lines", T.ArrayType(T.StringType()))]))
def fitted(text: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Font size and lines of a block of text: wrapped at a nominal size for the number of lines, sized to the height, wrapped again."""
    sizes, lines = [], []
    for t, w, h in zip(text, width, height):
        w = max(w, 1.0)
        n = max(1, len(wrapped_lines(t, NOMINAL, w)))
        size = max(LEAST, min(h / (n * LINE_FACTOR) if h > 0 else NOMINAL, MOST))
        sizes.append(size)
        lines.append(wrapped_lines(t, size, w))
    return pd.DataFrame({"size": sizes, "lines": lines})
