"""Text as the document model means it: Unicode white space and digits, scripts, escapes, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, and the four separators of ASCII.
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Ranges of scripts, and characters that only one of the two Chinese scripts has, in order of code points.
HANGUL = r"[\x{AC00}-\x{D7AF}]"
KANA = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3000}-\x{303F}]"
BLOCK_TRADITIONAL = "傳國灣統繁臺語體"
TRADITIONAL = "來個們備傳動勢區問國園圖場學實將對層後從態應戲擇時書會樓歡歲氣灣無當發碼種節統經練繁習聲臺與處號觀觸話該認語說調識讀變讓較這進遊過選還開閱關際離電題願飛館體點"
SIMPLIFIED = "与个习书从们会体关动变号后处备学实对应开当无时来欢点电码种练经观认识话该说读过还这问阅际题"

# Language hints and their labels.
HINTS = {
    "zh_tra_h": "Traditional Chinese (horizontal text)",
    "zh_tra_v": "Traditional Chinese (vertical text)",
    "zh_sim_h": "Simplified Chinese (horizontal text)",
    "zh_sim_v": "Simplified Chinese (vertical text)",
    "ja_h": "Japanese (horizontal text, including hiragana, katakana, and kanji)",
    "ja_v": "Japanese (vertical text, including hiragana, katakana, and kanji)",
    "ko_h": "Korean (horizontal text)",
    "ko_v": "Korean (vertical text)",
}
LAYOUT_TYPES = ("heading", "paragraph", "list-item", "footnote", "page-number", "caption", "image")
FORMATS = ("clean", "searchable")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{WS[1:]}")


def of_scripts(c: Column) -> Column:
    """``c`` without the characters below U+3000, of which HANGUL, KANA and CJK have none; the empty text for null. Runs go at once, so
    that what looks for a script has little left to read."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{0000}-\x{2FFF}]+", "")


def block_language(c: Column) -> Column:
    """Of one block: a single hangul, kana or CJK character decides, in this order; CJK is simplified unless a traditional
    character shows. Null and empty texts are ``en``."""
    text = of_scripts(c)
    return (
        F.when(text.rlike(HANGUL), "korean").when(text.rlike(KANA), "japan")
        .when(text.rlike(CJK), F.when(text.rlike(f"[{BLOCK_TRADITIONAL}]"), "ch_tra").otherwise("ch_sim")).otherwise("en")
    )


def count_of(c: Column, characters: str) -> Column:
    """How many of a text's characters are among ``characters``, by a table of them: a pattern would compare each with all of them."""
    return F.length(c) - F.length(F.translate(c, characters, ""))


def language_of(texts: Column) -> Column:
    """An aggregate: the language of all texts of a group, from flags and counts; no text is collected."""
    text = of_scripts(texts)
    any_of = lambda pattern: F.coalesce(F.bool_or(text.rlike(pattern)), F.lit(False))
    size, simp, trad = F.sum(F.length(F.coalesce(texts, F.lit("")))), F.sum(count_of(text, SIMPLIFIED)), F.sum(count_of(text, TRADITIONAL))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "ch_tra").when(any_of(HANGUL), "korean").when(any_of(KANA), "japan")
        .when(any_of(CJK), F.when(simp > 2 * trad, "ch_sim").otherwise("ch_tra")).otherwise("en")
    )


def page_language(texts: Column) -> Column:
    """An aggregate: the language of a page's blocks as if they were one text without anything between."""
    text = of_scripts(texts)
    any_of = lambda pattern: F.coalesce(F.bool_or(text.rlike(pattern)), F.lit(False))
    return (
        F.when(any_of(HANGUL), "korean").when(any_of(KANA), "japan")
        .when(any_of(CJK), F.when(any_of(f"[{BLOCK_TRADITIONAL}]"), "ch_tra").otherwise("ch_sim")).otherwise("en")
    )


# Characters that a title, a line and a message keep.
TITLE_CHARS, LINE_CHARS, MESSAGE_CHARS = 100, 200, 500


def shortened(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def display_stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?i)\.pdf\z", "")


# What a job's status is shown as.
STATUS_LABELS = {"pending": "⏳ Pending", "queued": "⏳ Queued", "processing": "⚙ Processing", "paused": "⏸ Paused", "stopped": "⏹ Stopped", "failed": "✗ Failed", "done": "✓ Done"}
PARTIAL_LABEL, NO_DATE = "⚠ Partial", "—"


def status_label(status: Column, partial: Column) -> Column:
    """What a job's status is shown as; a done job whose output is partial has a label of its own, an unknown status is shown as it is."""
    known = F.create_map(*[x for k, v in STATUS_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.when((status == "done") & F.coalesce(partial, F.lit(False)), PARTIAL_LABEL).otherwise(F.coalesce(F.element_at(known, status), status))


def display_date(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Day, hour and minute of a time in seconds, in the session's zone; a dash for none and for zero."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, NO_DATE).otherwise(F.date_format(F.timestamp_seconds(seconds), pattern))


def is_list_item(c: Column) -> Column:
    return c.rlike(rf"\A[•·▪▸\-*]|\A\p{{Nd}}+[.)、]{WS}")


def is_page_number(c: Column) -> Column:
    return c.rlike(r"\A\p{Nd}{1,4}\z")


def escape_markup(c: Column) -> Column:
    """Control characters go, but for tab, line feed and carriage return; the five special characters become entities."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def layout_type(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*LAYOUT_TYPES), t).otherwise("unknown")


def direction(c: Column) -> Column:
    return F.when(F.lower(c) == "vertical", "vertical").otherwise("horizontal")


def formats(requested: Column) -> Column:
    """The known ones in the order of the request; without any, clean."""
    kept = F.filter(F.coalesce(requested, F.array().cast("array<string>")), lambda f: f.isin(*FORMATS))
    return F.when(F.size(kept) == 0, F.array(F.lit("clean"))).otherwise(kept)


def prompt(base: str, tile_note: str, tile: Column, hints: Column) -> Column:
    """The recognition prompt: base, note on tiles, and the labels of known hints in their order; unknown ones are dropped."""
    labels = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.lit(v))])
    known = F.filter(F.coalesce(hints, F.array().cast("array<string>")), lambda h: h.isin(*HINTS))
    named = F.array_join(F.transform(known, lambda h: F.element_at(labels, h)), ", ")
    return F.concat(F.lit(base), F.when(tile, F.lit(tile_note)).otherwise(""), F.when(F.size(known) == 0, "").otherwise(F.concat(F.lit("- Expected languages, in order: "), named, F.lit(".\n"))))


def email_allowed(given: Column, allowed: Column) -> Column:
    return F.lower(strip(given)) == F.lower(strip(allowed))


def output_name(filename: Column, kind: str) -> Column:
    return F.concat(display_stem(filename), F.lit(f"_{kind}.pdf"))
