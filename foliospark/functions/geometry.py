"""Boxes as structs of four doubles (x0, y0, x1, y1), and their measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    """Width times height, not clamped: two negative sides give a positive area."""
    return width(b) * height(b)


def clamped_area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def touches(a: Column, b: Column) -> Column:
    """Whether the interiors meet: a cheap test before any ratio."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlaps(a: Column, b: Column, least: float = 0.3) -> Column:
    """Intersection over union of at least ``least``; false without an intersection or with a union that isn't positive."""
    union = area(a) + area(b) - intersection(a, b)
    return (intersection(a, b) > 0) & (union > 0) & F.coalesce(F.try_divide(intersection(a, b), union) >= least, F.lit(False))


def contains(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether at least ``least`` of ``b`` lies in ``a``."""
    return (intersection(a, b) > 0) & (area(b) > 0) & F.coalesce(F.try_divide(intersection(a, b), area(b)) >= least, F.lit(False))


#: The grid of ``cells``: so many cells a side, each of so many units; the cells at its edges reach on without end.
GRID, CELL = 16, 256.0


def cell_at(x: Column, y: Column) -> tuple[Column, Column]:
    """Column and row of the grid's cell that a point lies in."""
    at = lambda v: F.floor(F.coalesce(F.greatest(F.least(v / CELL, F.lit(GRID - 1.0)), F.lit(0.0)), F.lit(0.0))).cast("int")
    return at(x), at(y)


def cell_of(x: Column, y: Column) -> Column:
    """The number of the grid's cell that a point lies in."""
    column, row = cell_at(x, y)
    return row * GRID + column


def cells(b: Column) -> Column:
    """The cells that a box touches, that of its first corner first; at most GRID squared. Two boxes whose interiors meet share the
    cell of the point (greater x0, greater y0), so a pair can be counted there alone."""
    first, last = cell_of(b["x0"], b["y0"]), cell_of(b["x1"], b["y1"])
    rows = F.sequence(F.floor(first / GRID).cast("int"), F.floor(last / GRID).cast("int"))
    columns = F.sequence(first % GRID, last % GRID)
    return F.when(first == last, F.array(first)).otherwise(F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: y * GRID + x))))


def clamped_iou(a: Column, b: Column) -> Column:
    """Intersection over union with sides clamped at zero; 0 without an intersection."""
    inter = intersection(a, b)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(inter, clamped_area(a) + clamped_area(b) - inter), F.lit(0.0)))


def scaled(b: Column, by, dx=0.0, dy=0.0) -> Column:
    by, dx, dy = (c if isinstance(c, Column) else F.lit(c) for c in (by, dx, dy))
    return box(b["x0"] * by + dx, b["y0"] * by + dy, b["x1"] * by + dx, b["y1"] * by + dy)


def to_points(b: Column, dpi: int = 300) -> Column:
    return scaled(b, 72.0 / dpi)


def to_pixels(b: Column, dpi: int = 300) -> Column:
    return scaled(b, dpi / 72.0)


def clamp_to_page(b: Column, page_width, page_height, dpi: int = 300) -> Column:
    """A pixel box in points, its sides in order, cut at the page; null if it is empty or a side has one point or less."""
    p = to_points(b, dpi)
    w, h = (c if isinstance(c, Column) else F.lit(float(c)) for c in (page_width, page_height))
    cut = box(
        F.greatest(F.least(p["x0"], p["x1"]), F.lit(0.0)), F.greatest(F.least(p["y0"], p["y1"]), F.lit(0.0)),
        F.least(F.greatest(p["x0"], p["x1"]), w), F.least(F.greatest(p["y0"], p["y1"]), h),
    )
    return F.when((width(cut) > 1) & (height(cut) > 1), cut)


def downscale(width_px: Column, height_px: Column, most: int = 2048) -> Column:
    """Scale and whole sides of an image whose longer side has at most ``most`` pixels."""
    longest = F.greatest(width_px, height_px)
    scale = F.when(longest > most, F.lit(float(most)) / longest).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), (width_px * scale).cast("int").alias("width"), (height_px * scale).cast("int").alias("height"))


def tile_grid(width_px: Column, height_px: Column, overlap: float = 0.10) -> Column:
    """Four overlapping quadrants in reading order: array of (tile, x0, y0, x1, y1)."""
    w, h = width_px.cast("int"), height_px.cast("int")
    mid_x, mid_y = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    ox, oy = (w * overlap).cast("int"), (h * overlap).cast("int")
    left, right = (F.lit(0), F.least(w, mid_x + ox)), (F.greatest(F.lit(0), mid_x - ox), w)
    top, bottom = (F.lit(0), F.least(h, mid_y + oy)), (F.greatest(F.lit(0), mid_y - oy), h)
    cells = [(x, y) for y in (top, bottom) for x in (left, right)]
    return F.array(*[F.struct(F.lit(i).alias("tile"), x[0].alias("x0"), y[0].alias("y0"), x[1].alias("x1"), y[1].alias("y1")) for i, (x, y) in enumerate(cells)])
