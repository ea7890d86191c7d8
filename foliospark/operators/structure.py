"""From recognized blocks to elements: joins of boxes in a page, classification, headings, image numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.functions.names import free

PAGE = ["doc_id", "page"]
CORNERS = ("x0", "y0", "x1", "y1")
DEFAULT_SIZE = 12.0


def upper_median(size: Column) -> Column:
    """An aggregate: the upper median of the positive sizes of a page, 12 without any."""
    kept = F.sort_array(F.collect_list(F.when(size > 0, size)))
    return F.coalesce(F.get(kept, F.floor(F.size(kept) / 2).cast("int")), F.lit(DEFAULT_SIZE))


def font_size(bbox: Column, direction: Column, lines: Column, text: Column) -> Column:
    """The side across the lines divided by their number: lines with text, else line feeds plus one."""
    filled = F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: ~T.is_blank(x)))
    n = F.when(filled > 0, filled).otherwise(F.size(F.split(text, "\n")))
    return F.when(direction == "vertical", G.width(bbox)).otherwise(G.height(bbox)) / n


def last_matches(blocks: DataFrame, wanted: list[tuple[DataFrame, str, Callable[[Column, Column], Column], str]]) -> DataFrame:
    """``blocks`` with a column for each of ``wanted`` (others, value, meets, name): the value of the last (by ord) of the page's others that
    meets the block, or null. All have doc_id, page, ord, bbox.

    One join for all of ``wanted``, by page and cell of a grid: boxes are copied to the cells they touch, and a pair counts in the one cell
    that holds its reference corner, so that a page of very many boxes is many tasks' work. A block's other columns go with
    its first copy alone. Rows that are equal in all columns are one block."""
    home, cell, rest, same = free(blocks, "home", "cell", "rest", "same")
    names, key = [n for _, _, _, n in wanted], [*PAGE, "ord", "bbox"]
    others = None
    for i, (other, value, _, _) in enumerate(wanted):
        values = [F.col(value).alias(f"o_value{k}") if k == i else F.lit(None).cast(w[0].schema[w[1]].dataType).alias(f"o_value{k}") for k, w in enumerate(wanted)]
        own = other.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, "ord", "bbox")], F.lit(i).alias("o_which"), *values)
        others = own if others is None else others.unionByName(own)
    # the join's condition has plain numbers that are never null, so that its generated code stays small enough to be compiled
    whole = lambda b: reduce(and_, [b[c].isNotNull() for c in CORNERS])
    corners = lambda b, side: [F.coalesce(b[c], F.lit(0.0)).alias(f"{side}_{c}") for c in CORNERS]
    first = lambda b, side: [at.alias(f"{side}_first_{c}") for c, at in zip("xy", G.cell_at(b["x0"], b["y0"]))]
    box, o_box = F.col("bbox"), F.col("o_bbox")
    others = others.filter(whole(o_box)).select(*[c for c in others.columns if c != "o_bbox"], *corners(o_box, "o"), *first(o_box, "o"), F.explode(G.cells(o_box)).alias("o_cell"))
    payload = [c for c in blocks.columns if c not in key]
    hashed = F.xxhash64(*[F.col(c) for c in payload]) if payload else F.lit(0).cast("long")
    at = F.when(whole(box), G.cells(box)).otherwise(F.array(F.lit(-1)))
    placed = blocks.select(*key, hashed.alias(same), F.struct(*payload, F.lit(1).alias(home)).alias(rest), *corners(box, "a"), *first(box, "a"), F.posexplode(at).alias(home, cell))
    placed = placed.withColumn(rest, F.when(F.col(home) == 0, F.col(rest))).withColumn("a_cell_x", F.col(cell) % G.GRID).withColumn("a_cell_y", F.floor(F.col(cell) / G.GRID).cast("int"))
    a, b = (F.struct(*[F.col(f"{side}_{c}").alias(c) for c in CORNERS]) for side in "ao")
    # the cell of the point (greater x0, greater y0)
    corner = reduce(and_, [F.greatest(f"a_first_{c}", f"o_first_{c}") == F.col(f"a_cell_{c}") for c in "xy"])
    meets = F.lit(False)
    for i, (_, _, test, _) in enumerate(wanted):
        meets = meets | ((F.col("o_which") == i) & test(a, b))
    on = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & (F.col(cell) == F.col("o_cell")) & G.touches(a, b) & corner & meets
    found = [F.max_by(f"o_value{i}", F.when(F.col("o_which") == i, F.col("o_ord"))).alias(n) for i, n in enumerate(names)]
    per_block = placed.join(others, on, "left").groupBy(*key, same).agg(F.first(rest, ignorenulls=True).alias(rest), *found)
    return per_block.select(*[F.col(c) if c in key else F.col(f"{rest}.{c}").alias(c) for c in blocks.columns], *names)


def layout_types(blocks: DataFrame, layout: DataFrame, least: float = 0.3) -> DataFrame:
    return last_matches(blocks, [(layout, "block_type", lambda a, b: G.overlaps(a, b, least), "matched_type")])


def link_targets(blocks: DataFrame, links: DataFrame, least: float = 0.5) -> DataFrame:
    return last_matches(blocks, [(links, "url", lambda a, b: G.contains(a, b, least), "href")])


def infer_type(text: Column, size: Column, bbox: Column, median: Column, page_height: Column) -> Column:
    middle, t = (bbox["y0"] + bbox["y1"]) / 2, T.strip(text)
    return (
        F.when(T.is_page_number(t) & ((middle < page_height * 0.1) | (middle > page_height * 0.9)), "page-number")
        .when(size > median * 1.4, "heading").when((size < median * 0.75) & (middle > page_height * 0.8), "footnote")
        .when(T.is_list_item(t), "list-item").otherwise("paragraph")
    )


def heading_level(size: Column, median: Column) -> Column:
    return F.when(size > median * 2.0, 1).when(size > median * 1.6, 2).otherwise(3)


def elements(blocks: DataFrame, layout: DataFrame, links: DataFrame, page_height: Column) -> DataFrame:
    """doc_id, page, ord, element_type, text, level, href: the blocks with a text, typed by the last layout block they overlap,
    else by inference. ``blocks`` has doc_id, page, ord, text, bbox and size. A type that was matched stays, ``unknown`` too."""
    medians = blocks.groupBy(*PAGE).agg(upper_median(F.col("size")).alias("median"))
    wanted = [(layout, "block_type", lambda a, b: G.overlaps(a, b, 0.3), "matched_type"), (links, "url", lambda a, b: G.contains(a, b, 0.5), "href")]
    own = blocks.filter(~T.is_blank(F.col("text"))).select(*PAGE, "ord", "bbox", "text", "size")
    typed = last_matches(own, wanted).join(medians, PAGE)
    kind = F.coalesce("matched_type", infer_type(F.col("text"), F.col("size"), F.col("bbox"), F.col("median"), page_height))
    typed = typed.withColumn("element_type", kind)
    level = F.when(F.col("element_type") == "heading", heading_level(F.col("size"), F.col("median"))).otherwise(1)
    return typed.select(*PAGE, "ord", "element_type", T.strip(F.col("text")).alias("text"), level.alias("level"), "href")


def table_of_contents(elements: DataFrame) -> DataFrame:
    return elements.filter("element_type = 'heading'").select("doc_id", "page", "ord", "level", "text")


def image_ids(images: DataFrame) -> DataFrame:
    """Numbers the kept images of a document in order of page and place."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord"))
    return images.withColumn("image_id", F.format_string("img_%04d", n))


def image_only(pages: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """The pages without a text block that have a significant image (column ``significant``)."""
    with_image = images.filter("significant").select(*PAGE).distinct()
    return pages.join(blocks.select(*PAGE), PAGE, "left_anti").join(with_image, PAGE, "left_semi")


def page_images(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """The significant images; where the page has text, only those that don't span it."""
    with_text = blocks.select(*PAGE).distinct().withColumn("has_text", F.lit(True))
    return images.join(with_text, PAGE, "left").filter("significant and not (spanning and coalesce(has_text, false))").drop("has_text")
