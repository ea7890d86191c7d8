"""Layout of text on pages: wrapping, overlays, pagination, styles and fonts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import metrics as M
from foliospark.functions import text as T

#: Width of a character as a share of the font size, where all have one.
CHAR_WIDTH = 0.6

# Fonts by language, in order of preference.
FITZ_FONTS = {"ch_tra": "china-t", "ch_sim": "china-s", "japan": "japan", "korean": "korea"}
CID_FONTS = {
    "ch_sim": ["STSong-Light", "MSung-Light", "HeiseiMin-W3", "HYSMyeongJo-Medium"],
    "japan": ["HeiseiMin-W3", "MSung-Light", "STSong-Light", "HYSMyeongJo-Medium"],
    "korean": ["HYSMyeongJo-Medium", "MSung-Light", "STSong-Light", "HeiseiMin-W3"],
    "ch_tra": ["MSung-Light", "STSong-Light", "HeiseiMin-W3", "HYSMyeongJo-Medium"],
}
# Style, font size and leading by type of element; fall-back size without styles.
STYLES = [("heading", 1, 16, 22, 16), ("heading", 2, 14, 19, 14), ("heading", 3, 12, 17, 12), ("paragraph", 1, 11, 18, 11), ("list-item", 1, 11, 18, 11), ("footnote", 1, 9, 13, 9), ("page-number", 1, 9, 12, 8), ("caption", 1, 10, 14, 10)]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a function over an array it would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def wrap(text: Column, size: Column, width: Column) -> Column:
    """Lines of at most ``width``, broken between characters; a blank line stays as an empty one; there is one line at least.
    All characters have one width, so a line takes a fixed number of them (``metrics.wrap`` goes by their own widths)."""

    def cut(line: Column, most: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / most).cast("int")), lambda i: F.substring(line, i * most + 1, most))
        return F.when(T.is_blank(line), F.array(F.lit(""))).otherwise(pieces)

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return bound(characters_of(size, width), lambda m: F.flatten(F.transform(lines, lambda line: cut(line, m))))


def characters_of(size: Column, width: Column) -> Column:
    """How many characters of one width a line takes, one at least."""
    # as the running width is compared after each character, the count is found by that comparison, not by a division
    fits = lambda n: n * size * CHAR_WIDTH <= width
    most = lambda n: F.when(fits(n + 1), n + 1).when(fits(n), n).otherwise(F.greatest(F.lit(1), n - 1))
    return bound(F.greatest(F.lit(1), F.floor(width / (size * CHAR_WIDTH)).cast("int")), most)


def wrapped(text: Column, size: Column, width: Column) -> Column:
    """The number of ``wrap``'s lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    of = lambda line, most: F.when(T.is_blank(line), 1).otherwise(F.floor((F.length(line) - 1) / most).cast("int") + 1)
    return bound(characters_of(size, width), lambda m: F.aggregate(lines, F.lit(0), lambda n, line: n + of(line, m)))


def clamp_size(size: Column) -> Column:
    return F.greatest(F.lit(3.0), F.least(size, F.lit(48.0)))


def horizontal_overlay(rect: Column, text: Column, uniform: bool = False) -> Column:
    """size, x and baseline of one line; null for a blank text or no box. Widths are those of ``metrics``, or with
    ``uniform`` one for all characters."""
    t, h, w = T.strip(text), G.height(rect), G.width(rect)
    first = clamp_size(h)
    own = F.length(t) * first * CHAR_WIDTH if uniform else M.text_width(t) * first / 1000
    size = F.when((own > w) & (own > 0), F.greatest(F.lit(3.0), first * (w / own))).otherwise(first)
    placed = F.struct(size.alias("size"), rect["x0"].alias("x"), (rect["y1"] - h * 0.18).alias("y"))
    return F.when(~T.is_blank(text) & rect.isNotNull(), placed)


def vertical_overlay(rect: Column, text: Column, page_height) -> Column:
    """Array of (i, character, x, y, size) down a column; what begins below the page's end is left out."""
    chars = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"{T.WS}+", ""), "")  # of an empty text an empty one

    def placed(own: Column) -> Column:
        step = G.height(rect) / F.size(own)
        size = F.greatest(F.lit(3.0), F.least(G.width(rect), step, F.lit(48.0)))
        column = F.struct(step.alias("step"), size.alias("size"), rect["x0"].alias("x"), (rect["y0"] + size).alias("y"))
        return F.when(F.get(own, F.lit(0)) != "", bound(column, lambda m: down(own, m)))

    def down(own: Column, m: Column) -> Column:
        of = F.transform(own, lambda c, i: F.struct(i.alias("i"), c.alias("c"), m["x"].alias("x"), (m["y"] + i * m["step"]).alias("y"), m["size"].alias("size")))
        return F.filter(of, lambda p: p["y"] <= F.lit(float(page_height)))

    return bound(chars, placed)


def block_overlay(rect: Column, text: Column, uniform: bool = False) -> Column:
    """Font size and lines of a whole block: wrapped at 12 points for the number of lines, sized to the box, wrapped again. Widths are those
    of ``metrics``, or with ``uniform`` one for all characters, which stays in the JVM."""
    if not uniform:
        return M.fitted(text, G.width(rect), G.height(rect))
    given = F.struct(text.alias("text"), F.greatest(G.width(rect), F.lit(1.0)).alias("w"), G.height(rect).alias("h"))

    def fitting(b: Column) -> Column:
        size = clamp_size(F.when(b["h"] > 0, b["h"] / (wrapped(b["text"], F.lit(12.0), b["w"]) * 1.2)).otherwise(12.0))
        return bound(size, lambda own: F.struct(own.alias("size"), wrap(b["text"], own, b["w"]).alias("lines")))

    return bound(given, fitting)


def block_lines(rect: Column, text: Column, page_height, uniform: bool = False) -> Column:
    """Array of (i, line, x, y) of ``block_overlay``'s lines: one below the other from the box's top. A blank line takes its place
    but isn't there; the first that would stand below the page's end, and all after it, are left out."""

    def placed(whole: Column) -> Column:
        y = lambda i: whole["y"] + whole["of"]["size"] * (1.0 + 1.2 * i)
        of = F.transform(whole["of"]["lines"], lambda line, i: F.struct(i.alias("i"), line.alias("line"), whole["x"].alias("x"), y(i).alias("y")))
        return F.filter(of, lambda p: (p["line"] != "") & (p["y"] <= F.lit(float(page_height))))

    return bound(F.struct(block_overlay(rect, text, uniform).alias("of"), rect["x0"].alias("x"), rect["y0"].alias("y")), placed)


def overlay_rows(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """The lines that have a place, and the blocks none of whose lines has one. ``lines`` has doc_id, page, ord, line, placed;
    ``blocks`` doc_id, page, ord."""
    key = ["doc_id", "page", "ord"]
    fine = lines.filter(F.col("placed").isNotNull())
    rest = blocks.join(fine.select(*key), key, "left_anti")
    return fine.select(*key, F.lit("line").alias("level"), "line").unionByName(rest.select(*key, F.lit("block").alias("level"), F.lit(None).cast("int").alias("line")))


def fitz_font(language: Column) -> Column:
    known = F.create_map(*[x for k, v in FITZ_FONTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, language), F.lit("china-t"))


def cid_font(language: Column, available: Column) -> Column:
    """The first font of the language's order that is available, else Helvetica."""
    lists = F.create_map(*[x for k, v in CID_FONTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.coalesce(F.element_at(lists, language), F.element_at(lists, F.lit("ch_tra")))
    return F.coalesce(F.get(F.filter(wanted, lambda f: F.array_contains(available, f)), F.lit(0)), F.lit("Helvetica"))


def styled(elements: DataFrame) -> DataFrame:
    """``elements`` with font_size, leading and fallback_size; unknown types are styled as paragraphs. The styles are a table of
    eight fixed rows."""
    table = elements.sparkSession.createDataFrame(STYLES, "s_type string, s_level int, font_size int, leading int, fallback_size int")
    kind = F.when(F.col("element_type").isin(*{s[0] for s in STYLES}), F.col("element_type")).otherwise("paragraph")
    level = F.when(kind == "heading", F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(3))).otherwise(1)
    return elements.join(F.broadcast(table), (kind == F.col("s_type")) & (level == F.col("s_level"))).drop("s_type", "s_level")


def body_markup(element_type: Column, text: Column, href: Column) -> Column:
    """An element's markup on the clean page: escaped, with a bullet for list items, and a link around headings, paragraphs and
    list items that have one."""
    safe = T.escape_markup(T.strip(text))
    safe = F.when(element_type == "list-item", F.concat(F.lit("• "), safe)).otherwise(safe)
    linked = F.concat(F.lit('<a href="'), T.escape_markup(href), F.lit('" color="blue">'), safe, F.lit("</a>"))
    return F.when(element_type.isin("heading", "paragraph", "list-item") & (F.coalesce(href, F.lit("")) != ""), linked).otherwise(safe)


PAGE_TOP, PAGE_BOTTOM, LINE, GAP, HEADING_GAP, BODY_WIDTH = 60.0, 790.0, 1.5, 4.0, 8.0, 495.0


def paginate(elements: DataFrame, uniform: bool = False) -> DataFrame:
    """doc_id, page, sheet (from 0), y, size, line: where each wrapped line of a page's elements stands. A fold over the elements of one
    page, in the JVM: a line that would begin below the bottom begins a new sheet. Needs ord, element_type, level, text, fallback_size. Lines
    are broken by the widths of ``metrics``, or with ``uniform`` by one for all characters."""
    size = F.col("fallback_size").cast("double")
    own = (wrap if uniform else M.wrap)(T.strip(F.col("text")), size, F.lit(BODY_WIDTH))
    rows = elements.filter(~T.is_blank(F.col("text"))).select("doc_id", "page", "ord", size.alias("size"), (F.col("element_type") == "heading").alias("heading"), own.alias("lines"))
    items = F.array_sort(F.collect_list(F.struct("ord", "size", "heading", "lines")))
    flat = F.flatten(F.transform(items, lambda e: F.transform(e["lines"], lambda line, i: F.struct(e["size"].alias("size"), line.alias("line"), F.when((i == 0) & e["heading"], HEADING_GAP).otherwise(0.0).alias("before"), F.when(i == F.size(e["lines"]) - 1, GAP).otherwise(0.0).alias("after")))))
    start = F.struct(F.lit(0).alias("sheet"), F.lit(PAGE_TOP).alias("y"), F.expr("cast(array() as array<struct<sheet:int,y:double,size:double,line:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        y = acc["y"] + x["before"]
        over = y > PAGE_BOTTOM
        sheet, y = F.when(over, acc["sheet"] + 1).otherwise(acc["sheet"]), F.when(over, F.lit(PAGE_TOP)).otherwise(y)
        row = F.struct(sheet.alias("sheet"), y.alias("y"), x["size"].alias("size"), x["line"].alias("line"))
        return F.struct(sheet.alias("sheet"), (y + x["size"] * LINE + x["after"]).alias("y"), F.concat(acc["out"], F.array(row)).alias("out"))

    placed = rows.groupBy("doc_id", "page").agg(F.aggregate(flat, start, step)["out"].alias("out"))
    return placed.select("doc_id", "page", F.explode("out").alias("o")).select("doc_id", "page", "o.sheet", "o.y", "o.size", "o.line")
