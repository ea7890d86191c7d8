"""Results of tiles brought together on their page."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.functions.names import free

TILE_FROM = 1500
#: So many accepted boxes are looked through one by one, before a hash of their cells is worth its while.
FEW = 8


def needs_tiles(n_blocks: Column, width_px: Column, height_px: Column) -> Column:
    return (n_blocks == 0) & (F.greatest(width_px, height_px) >= TILE_FROM)


def upscaled(blocks: Column, by: Column) -> Column:
    """Blocks (array of structs with bbox and lines, these with a bbox too) with all their boxes multiplied; other fields stay. Null lines
    and boxes stay null."""
    larger = lambda b: F.when(b.isNotNull(), G.scaled(b, by))
    return F.transform(blocks, lambda b: b.withField("bbox", larger(b["bbox"])).withField("lines", F.transform(b["lines"], lambda x: x.withField("bbox", larger(x["bbox"])))))


def on_page(bbox: Column, inverse_scale: Column, origin_x: Column, origin_y: Column) -> Column:
    return G.scaled(bbox, inverse_scale, origin_x, origin_y)


class AcceptedBoxes:
    """Boxes by level and cell: a box is on the level of the power of two that its longer side doesn't exceed, in the cell of its middle. Two
    boxes that share ``least`` of their union have sides that differ by that factor at most, so few levels, and few cells of each, can hold
    a box that overlaps another one by so much. The first ``FEW`` boxes are a list."""

    def __init__(self, least: float):
        self.least, self.far = least, math.ceil(math.log2(1 / least)) + 1 if 0 < least <= 1 else 0
        self.levels: dict[int, dict[tuple[int, int], list[tuple]]] = {}
        self.few: list[tuple] = []
        self.n = 0

    def overlapped(self, box: tuple[float, float, float, float]) -> bool:
        if self.least <= 0 or not self.n:
            return self.n > 0
        if self.n <= FEW:
            return any(_shared(a, box) >= self.least for a in self.few)
        level = _level(box)
        if level is None:
            return False
        x0, y0, x1, y1 = box
        for other in range(level - self.far, level + self.far + 1):
            found = self.levels.get(other)
            if not found:
                continue
            side = 2.0**other
            near = ((x, y) for x in range(math.floor((x0 - side) / side), math.floor((x1 + side) / side) + 1) for y in range(math.floor((y0 - side) / side), math.floor((y1 + side) / side) + 1))
            if any(_shared(a, box) >= self.least for cell in near for a in found.get(cell, ())):
                return True
        return False

    def add(self, box: tuple[float, float, float, float]) -> None:
        self.n += 1
        if self.n <= FEW:
            self.few.append(box)
            return
        for one in (*self.few, box):
            self._place(one)
        self.few = []

    def _place(self, box: tuple[float, float, float, float]) -> None:
        level = _level(box)
        if level is not None:
            side = 2.0**level
            self.levels.setdefault(level, {}).setdefault((math.floor((box[0] + box[2]) / 2 / side), math.floor((box[1] + box[3]) / 2 / side)), []).append(box)


def _level(box: tuple[float, float, float, float]) -> int | None:
    """None for a box without an area, which overlaps nothing."""
    w, h = box[2] - box[0], box[3] - box[1]
    return math.frexp(max(w, h))[1] if w > 0 and h > 0 and math.isfinite(w) and math.isfinite(h) else None


def _shared(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def merge_tiles(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``blocks`` that stay, all columns. Greedy, in order of tile and ord: a block goes if an accepted one of its page
    with its stripped text overlaps it by ``least`` (intersection over union; a null box is one of zeros, a null text an empty one). Needs
    doc_id, page, text, tile, ord, bbox.

    Only blocks with one text meet, so they are dealt out by page and stripped text and stream through a task in order; it holds the boxes
    that it has accepted of one text, in a hash of cells."""
    key, begin = free(blocks, "key", "begin")
    names, columns = blocks.columns, ["doc_id", "page", key]
    stripped = T.strip(F.coalesce(F.col("text"), F.lit("")))
    corners = F.array(*[F.coalesce(F.col(f"bbox.{c}"), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")])
    rows = blocks.select("*", stripped.alias(key), corners.alias(begin)).repartition(*columns).sortWithinPartitions(*columns, "tile", "ord")
    own = [len(names), names.index("doc_id"), names.index("page"), len(names) + 1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, accepted = None, AcceptedBoxes(least)
        for batch in batches:
            stays = []
            for text, doc_id, page, box in zip(*(batch.column(i).to_pylist() for i in own)):
                if at != (doc_id, page, text):
                    at, accepted = (doc_id, page, text), AcceptedBoxes(least)
                fine = not accepted.overlapped(box)
                if fine:
                    accepted.add(box)
                stays.append(fine)
            yield batch.select(range(len(names))).filter(pa.array(stays, pa.bool_()))

    return rows.mapInArrow(fold, blocks.schema)


def tiled_direction(whole: Column, tiles: Column) -> Column:
    """An aggregate: vertical if the whole page or any tile is."""
    return F.when(F.bool_or((whole == "vertical") | (tiles == "vertical")), "vertical").otherwise("horizontal")


def sent_tiles(width_px: Column, height_px: Column) -> Column:
    """The four tiles of a page that have an area, in order: array of structs with tile, its sides x0, y0, x1, y1, and the scale and sides
    (to_width, to_height) at which it is sent. A page without sides has none."""

    def sent(t: Column) -> Column:
        to = G.downscale(t["x1"] - t["x0"], t["y1"] - t["y0"])
        return F.struct(*[t[c].alias(c) for c in ("tile", "x0", "y0", "x1", "y1")], to["scale"].alias("scale"), to["width"].alias("to_width"), to["height"].alias("to_height"))

    return F.transform(F.filter(G.tile_grid(width_px, height_px), lambda t: (t["x1"] > t["x0"]) & (t["y1"] > t["y0"])), sent)


def tiles_of(pages: DataFrame) -> DataFrame:
    """``pages`` (width_px, height_px and others) once for each of its tiles, with the fields of ``sent_tiles``."""
    return pages.withColumn("t", F.explode(sent_tiles(F.col("width_px"), F.col("height_px")))).select(*pages.columns, "t.*")


def stays(least: float = 0.3):
    """A function of an array (text, x0, y0, x1, y1) in order: for each block of one page, whether the greedy merge of ``merge_tiles`` keeps
    it. Texts are stripped and not null, nor are corners."""

    @F.arrow_udf(ArrayType(BooleanType()))
    def work(pages: pa.Array) -> pa.Array:
        texts, *corners = pages.flatten().flatten()
        blocks, kept, ends = zip(texts.to_pylist(), zip(*(c.to_numpy().tolist() for c in corners))), [], [0]
        for n in pages.value_lengths().fill_null(0).to_numpy().tolist():
            accepted: dict[str, AcceptedBoxes] = {}
            for text, box in islice(blocks, n):
                own = accepted.get(text)
                if own is None:
                    own = accepted[text] = AcceptedBoxes(least)
                fine = not own.overlapped(box)
                if fine:
                    own.add(box)
                kept.append(fine)
            ends.append(len(kept))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept, pa.bool_()))

    return work


def tiled_pages(whole: DataFrame, tiles: DataFrame) -> DataFrame:
    """doc_id, page, tiled, direction, blocks: ``whole`` (one row a page: doc_id, page, direction, blocks), where the tiles of a page found
    something with their merged blocks instead of its own. ``tiles`` (doc_id, page, tile, scale, x0, y0, direction, blocks) has the answers
    there are, at most one for each tile, of the pages that were cut; a tile that failed has no row. See ``merged_pages``."""
    block = lambda b: F.struct(*[b[c].alias(c) for c in ("text", "type", "bbox", "lines")])
    answer = F.struct("tile", "scale", "x0", "y0", "direction", F.transform("blocks", block).alias("blocks"))
    answers = tiles.groupBy("doc_id", "page").agg(F.collect_list(answer).alias("tiles"))
    return merged_pages(whole.select("doc_id", "page", "direction", "blocks").join(answers, ["doc_id", "page"], "left"))


def merged_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, tiled, direction, blocks of ``pages`` (one row a page: doc_id, page, direction, blocks, and tiles, the answers for its
    tiles: null or an array of structs with tile, scale, x0, y0, direction, blocks). Blocks of tiles are on the page's
    pixels afterwards, in order of tile and place, without blank ones; a page is vertical if it or any of its tiles is. A page whose tiles
    found nothing stays as it is. A page and its at most four answers are one row, so nothing is dealt out: only texts and corners of the
    tiles' blocks go to the merge."""

    def placed(t: Column) -> Column:
        at = lambda b: on_page(b, t["by"], t["dx"], t["dy"])
        lines = lambda b: F.transform(b["lines"], lambda x: x.withField("bbox", at(x["bbox"])))
        return F.transform(t["blocks"], lambda b: F.struct(T.strip(F.coalesce(b["text"], F.lit(""))).alias("text"), b["type"].alias("type"), at(b["bbox"]).alias("bbox"), lines(b).alias("lines")))

    by = lambda t: F.when(t["scale"] < 1, 1 / t["scale"]).otherwise(F.lit(1.0))
    answers = F.transform(F.sort_array(F.filter("tiles", lambda t: t["blocks"].isNotNull())), lambda t: F.struct(by(t).alias("by"), t["x0"].cast("double").alias("dx"), t["y0"].cast("double").alias("dy"), t["blocks"].alias("blocks")))
    found = F.filter(F.flatten(F.transform(answers, placed)), lambda b: b["text"] != "")
    upright = F.coalesce(F.exists("tiles", lambda t: t["direction"] == "vertical"), F.lit(False))
    own = pages.select("doc_id", "page", "direction", "blocks", upright.alias("upright"), found.alias("found"))
    corners = lambda b: [F.coalesce(b["bbox"][c], F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    own = own.withColumn("stays", stays()(F.transform("found", lambda b: F.struct(b["text"].alias("text"), *corners(b)))))
    merged = F.transform(F.filter(F.arrays_zip("found", "stays"), lambda z: z["stays"]), lambda z: z["found"])
    tiled = F.coalesce(F.size("found") > 0, F.lit(False))
    direction = F.when(tiled & F.col("upright"), "vertical").otherwise(F.col("direction"))
    return own.select("doc_id", "page", tiled.alias("tiled"), direction.alias("direction"), F.when(tiled, merged.cast(pages.schema["blocks"].dataType.simpleString())).otherwise(F.col("blocks")).alias("blocks"))
