"""A job's pages: what is ingested, the cache of recognized pages, the loop over pages, the order of sheets in the clean file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.functions.names import free
from foliospark.functions.ocr_json import export, kind, payload

PAGE_KEY = ["job_id", "page"]


# Ingest


def embedded_images(found: DataFrame) -> DataFrame:
    """Images with a place: ``rects`` has every place of an image on its page, of which the first counts; an image without one, or
    whose extraction failed (``error``), is left out."""
    return found.filter(F.col("error").isNull() & (F.size("rects") > 0)).withColumn("bbox", F.get("rects", F.lit(0))).drop("rects", "error")


def hyperlinks(annotations: DataFrame) -> DataFrame:
    """Links to an address: those of kind ``uri`` that name one and have a place."""
    return annotations.filter((F.col("kind") == "uri") & (F.coalesce("uri", F.lit("")) != "") & F.col("bbox").isNotNull())


# Recognized blocks


def recognized(blocks: DataFrame) -> DataFrame:
    """Blocks (direction, text, bbox, lines: array of text) with what recognition gives each: stripped text (blank blocks go), line_count, font_size,
    language, confidence. Without a line that has a text, line feeds count lines."""
    own = blocks.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    filled = F.size(F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: ~T.is_blank(x)))
    count = F.when(filled > 0, filled).otherwise(F.size(F.split("text", "\n")))
    across = F.when(F.col("direction") == "vertical", G.width(F.col("bbox"))).otherwise(G.height(F.col("bbox")))
    own = own.withColumn("line_count", count).withColumn("font_size", across / F.col("line_count"))
    return own.withColumn("language", T.block_language(F.col("text"))).withColumn("confidence", F.lit(1.0))


# Cache


def usable(result: Column) -> Column:
    """Whether a cache entry holds an object; anything else, corrupt or null, is a miss."""
    return F.coalesce(kind(F.try_parse_json(result)) == "OBJECT", F.lit(False))


def newest(cache: DataFrame) -> DataFrame:
    """One row (job_id, page, result) for each page: a later write (``seq``) replaces an earlier one."""
    return cache.groupBy(*PAGE_KEY).agg(F.max_by("result", "seq").alias("result"))


def cache_hits(cache: DataFrame) -> DataFrame:
    return cache.filter(usable(F.col("result")))


def replayed(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``pages`` with ``result`` and ``hit`` (columns of these names that ``pages`` has are replaced); without a usable entry the page has to
    be recognized."""
    found = cache_hits(cache).select(*PAGE_KEY, "result", F.lit(True).alias("hit"))
    return pages.drop("result", "hit").join(found, PAGE_KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def exported(cache: DataFrame) -> DataFrame:
    """job_id, page, json: each entry read tolerantly and written as one JSON object."""
    return cache.select(*PAGE_KEY, export(payload(F.col("result"))).alias("json"))


def to_clear(cache: DataFrame, finished: DataFrame) -> DataFrame:
    """The entries of jobs that ended in full success; all others stay for a resume."""
    return cache.join(finished.filter(~F.col("keep_cache")).select("job_id"), "job_id", "left_semi")


# Loop

#: Parts of a job's pages that meet its flags apart.
SALTS = 16


def run_pages(pages: DataFrame, flags: DataFrame) -> DataFrame:
    """What the loop over each job's pages (job_id, page from 0, ok) comes to. ``flags`` (job_id, flag, at_page) are requests to stop or
    pause, seen before the page of that number: the first one seen ends the loop, and stop beats pause where both are seen.

    job_id, tried, ok_pages, pages_total, status, keep_cache. Flags are summed by job before they meet the pages, which need no order and
    aren't held; a job with very many pages is dealt out by the pages' numbers. The cache stays unless every page succeeded."""
    at = lambda flag: F.min(F.when(F.col("flag") == flag, F.greatest("at_page", F.lit(0))))
    ends = flags.groupBy("job_id").agg(at("stop").alias("stop_at"), at("pause").alias("pause_at"))
    end = F.least("stop_at", "pause_at")
    (salt,) = free(pages, "salt")
    salted = ends.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = pages.withColumn(salt, F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(salted, ["job_id", salt], "left").withColumn("inside", F.coalesce(F.col("page") < end, F.lit(True)))
    summed = seen.groupBy("job_id").agg(F.count_if("inside").alias("tried"), F.count_if(F.col("inside") & F.col("ok")).alias("ok_pages"), F.count(F.lit(1)).alias("pages_total"), F.max("stop_at").alias("stop_at"), F.max("pause_at").alias("pause_at"))
    cut = F.col("tried") < F.col("pages_total")
    status = F.when(cut & (F.col("stop_at") <= F.coalesce("pause_at", "stop_at")), "stopped").when(cut, "paused").when(F.col("ok_pages") == 0, "failed").otherwise("done")
    return summed.select("job_id", "tried", "ok_pages", "pages_total", status.alias("status"), (F.col("ok_pages") < F.col("pages_total")).alias("keep_cache"))


# Clean file


def sheets(structured: DataFrame, source: DataFrame) -> DataFrame:
    """doc_id, position, kind, page: the clean file's sheets in order: a title, then for each structured page (doc_id, page) that the
    source has its scan, if there is one (``scan``), and its text."""
    both = structured.join(source, ["doc_id", "page"])
    order = F.array(F.when(F.col("scan"), F.lit("scan")), F.lit("text"))
    body = both.select("doc_id", "page", F.posexplode(F.filter(order, lambda x: x.isNotNull())).alias("nth", "kind"))
    title = structured.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("page"), F.lit(0).alias("nth"), F.lit("title").alias("kind"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "nth")) - 1
    return body.unionByName(title).select("doc_id", place.alias("position"), "kind", "page")
