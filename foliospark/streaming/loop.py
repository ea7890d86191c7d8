"""The loop over pages as a stream, and a log of what streams do.

Pages come in micro-batches of bounded size. Before each one the requests to stop or pause are read, and pages of such a job stay untried; every
answer is in the cache before the micro-batch ends, so one that is repeated after a failure pays for no page twice."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryListener

from foliospark.operators.pages import cache_hits
from foliospark.sources.cache import cache_at
from foliospark.sources.ocr import recognize_into

TRIED = "job_id string, page int, outcome string, batch long"


def page_loop(pages: DataFrame, flags: Callable[[], DataFrame], cache: str, log: str, checkpoint: str, name: str, config: dict, prompt: str, **limits) -> DataStreamWriter:
    """A writer that recognizes a stream of pages (job_id, page, image) into the cache at ``cache``. ``flags`` reads the jobs (job_id, flag: stop or
    pause) that were asked to end; stop beats pause. ``log`` gets a row for each page and micro-batch: job_id, page, outcome (ok, failed,
    stopped, paused). How many pages a micro-batch takes is the source's setting (such as maxFilesPerTrigger)."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ends = flags().groupBy("job_id").agg(F.when(F.bool_or(F.col("flag") == "stop"), "stopped").otherwise("paused").alias("ended"))
        own = batch.select("job_id", F.col("page").cast("int").alias("page"), "image").join(ends, "job_id", "left")
        going = own.filter("ended is null").drop("ended")
        recognize_into(cache, number, going, name, config, prompt, **limits)
        known = cache_hits(cache_at(spark, cache)).select("job_id", "page", F.lit(True).alias("known"))
        outcome = F.coalesce("ended", F.when(F.col("known"), "ok"), F.lit("failed"))
        rows = own.join(known, ["job_id", "page"], "left").select("job_id", "page", outcome.alias("outcome"), F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def loop_outcome(log: DataFrame, totals: DataFrame) -> DataFrame:
    """job_id, tried, ok_pages, pages_total, status, keep_cache of each job (``totals``: job_id, pages_total) by the last row that
    ``log`` has of each page. The cache stays unless every page succeeded."""
    last = log.groupBy("job_id", "page").agg(F.max_by("outcome", "batch").alias("outcome"))
    n = lambda o: F.count_if(F.col("outcome") == o)
    summed = last.groupBy("job_id").agg((n("ok") + n("failed")).alias("tried"), n("ok").alias("ok_pages"), n("stopped").alias("stopped"), n("paused").alias("paused"))
    both = totals.select("job_id", "pages_total").join(summed, "job_id", "left").na.fill(0, ["tried", "ok_pages", "stopped", "paused"])
    status = F.when(F.col("stopped") > 0, "stopped").when(F.col("paused") > 0, "paused").when(F.col("tried") < F.col("pages_total"), "processing").when(F.col("ok_pages") == 0, "failed").otherwise("done")
    return both.select("job_id", "tried", "ok_pages", "pages_total", status.alias("status"), (F.col("ok_pages") < F.col("pages_total")).alias("keep_cache"))


EVENTS = "query string, run string, event string, at timestamp, batch long, rows long, error string"


class ProgressLog(StreamingQueryListener):
    """Writes a row for the start, each micro-batch and the end of each of the session's queries to a table. ``with ProgressLog(spark, path):``
    adds it and takes it away."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, query: object, run: object, event: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        row = (str(query), str(run), event, datetime.now(timezone.utc), batch, rows, error)
        self.spark.createDataFrame([row], EVENTS).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write(event.id, event.runId, "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._write(p.id, p.runId, "progress", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write(event.id, event.runId, "failed" if event.exception else "ended", error=event.exception and event.exception[:2000])

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def query_health(events: DataFrame, now: Column, silent_s: int = 300) -> DataFrame:
    """query, state, batches, rows, last_at of each query by the log: its last run ``failed`` or ``ended``, else ``degraded`` if it hasn't been heard
    of for ``silent_s`` seconds, else ``ok``."""
    order = F.struct("at", F.when(F.col("event") == "started", 0).when(F.col("event") == "progress", 1).otherwise(2))
    summed = events.groupBy("query").agg(F.max_by("event", order).alias("last"), F.max("at").alias("last_at"), F.count_if(F.col("event") == "progress").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    silent = F.unix_timestamp(now) - F.unix_timestamp("last_at") > silent_s
    state = F.when(F.col("last").isin("failed", "ended"), F.col("last")).when(silent, "degraded").otherwise("ok")
    return summed.select("query", state.alias("state"), "batches", "rows", "last_at")
