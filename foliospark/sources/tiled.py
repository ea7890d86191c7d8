"""Recognition of whole pages, and of the tiles of large pages on which it found nothing, brought together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import ocr_json as J
from foliospark.functions import text as T
from foliospark.operators import tiling as TI
from foliospark.operators.jobs import to_recognize
from foliospark.operators.pages import cache_hits
from foliospark.sources.cache import cache_at
from foliospark.sources.ocr import recognize_into

#: Takes an image, the part of it (x0, y0, x1, y1) and the sides (width, height) that the part is to have; gives an image.
Cut = Callable[[bytes, tuple[int, int, int, int], tuple[int, int]], bytes]


def pictures(parts: DataFrame, cut: Cut) -> DataFrame:
    """job_id, page, image: the part of each image (x0, y0, x1, y1, to_width, to_height), null where ``cut`` fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for image, *n in zip(*(c.to_pylist() for c in batch.columns[2:])):
                try:
                    own.append(cut(image, tuple(n[:4]), tuple(n[4:])))
                except Exception:  # an image that can't be cut fails its page or tile alone
                    own.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["job_id", "page", "image"])

    sides = [F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1", "to_width", "to_height")]
    return parts.select(F.col("job_id").cast("string").alias("job_id"), F.col("page").cast("int").alias("page"), "image", *sides).mapInArrow(work, "job_id string, page int, image binary")


def _missing(parts: DataFrame, path: str) -> DataFrame:
    return to_recognize(parts, cache_hits(cache_at(parts.sparkSession, path)))


def recognize_pages(path: str, run: int, pages: DataFrame, name: str, config: dict, prompt: str, tile_prompt: str, cut: Cut, *, per_day: int | None = None, **limits) -> DataFrame:
    """job_id, page, tiled, direction, blocks for each of ``pages`` (job_id, page from 0, image, width_px, height_px; one row a page) that has
    an answer. A page is sent with at most 2048 pixels a side; where no block of it has a text and its longer side has ``TILE_FROM`` pixels, its four
    overlapping tiles are sent too, and their blocks are merged on the page (see ``tiling.tiled_pages``). A tile that fails is
    left out, and tried again by the next run, like a page. Answers are kept below ``path`` (``pages``, ``tiles``: a tile has the number
    4 * page + tile), and what is there isn't sent or cut again. ``per_day`` holds for pages and tiles together, pages first; other limits are
    those of ``ocr.recognize``."""
    spark, whole_at, tiles_at = pages.sparkSession, f"{path}/pages", f"{path}/tiles"
    sent = G.downscale(F.col("width_px"), F.col("height_px"))
    sides = [F.col("width_px").alias("x1"), F.col("height_px").alias("y1"), sent["scale"].alias("scale"), sent["width"].alias("to_width"), sent["height"].alias("to_height")]
    own = pages.select(F.col("job_id").cast("string").alias("job_id"), F.col("page").cast("int").alias("page"), "image", "width_px", "height_px", F.lit(0).alias("x0"), F.lit(0).alias("y0"), *sides)
    missing = _missing(own, whole_at)
    left = None if per_day is None else max(0, per_day - missing.count())
    recognize_into(whole_at, run, pictures(missing, cut), name, config, prompt, per_day=per_day, **limits)
    answers = J.parse_pages(cache_at(spark, whole_at).join(own.drop("image", "x0", "y0", "x1", "y1", "to_width", "to_height"), ["job_id", "page"]), "result")
    larger = TI.upscaled(F.col("page_result.blocks"), F.when(F.col("scale") < 1, 1 / F.col("scale")).otherwise(F.lit(1.0)))
    whole = answers.select("job_id", "page", "width_px", "height_px", F.col("page_result.direction").alias("direction"), larger.alias("blocks"))
    n_blocks = F.size(F.filter("blocks", lambda b: ~T.is_blank(b["text"])))
    large = whole.filter(TI.needs_tiles(n_blocks, F.col("width_px"), F.col("height_px"))).select("job_id", "page")
    tiles = TI.tiles_of(own.select("job_id", "page", "image", "width_px", "height_px").join(large, ["job_id", "page"], "left_semi"))
    tiles = tiles.withColumn("page", F.col("page") * 4 + F.col("tile"))
    recognize_into(tiles_at, run, pictures(_missing(tiles, tiles_at), cut).filter("image is not null"), name, config, tile_prompt, per_day=left, **limits)
    found = J.parse_pages(cache_at(spark, tiles_at).join(tiles.select("job_id", "page", "tile", "scale", "x0", "y0"), ["job_id", "page"]), "result")
    found = found.select(F.col("job_id").alias("doc_id"), F.floor(F.col("page") / 4).cast("int").alias("page"), "tile", "scale", "x0", "y0", "page_result.direction", "page_result.blocks")
    return TI.tiled_pages(whole.withColumnRenamed("job_id", "doc_id"), found).withColumnRenamed("doc_id", "job_id")
