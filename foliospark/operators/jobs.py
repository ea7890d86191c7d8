"""Job control: the state machine, queue, history, retention, outcomes, page lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, UPLOAD_HOURS, OUTPUT_DAYS, SESSION_DAYS = 10, 24, 7, 30
HELD = ("queued", "processing", "paused", "pending")
COMMANDS = ("start", "pause", "stop", "tick", "finish_ok", "finish_fail")


@dataclass
class Job:
    status: str = "pending"
    stop: bool = False
    pause: bool = False

    def apply(self, command: str) -> bool:
        """Whether the command was accepted. ``tick`` is the worker: it takes a queued job, and sees the flags of a running one."""
        s = self.status
        if command == "start" and s in ("pending", "paused", "stopped", "failed"):
            self.status, self.stop, self.pause = "queued", False, False
        elif command == "pause" and s in ("pending", "queued"):
            self.status = "paused"
        elif command == "pause" and s == "processing":
            self.pause = True
        elif command == "stop" and s in ("pending", "queued"):
            self.status = "stopped"
        elif command == "stop" and s in ("processing", "paused"):
            self.stop = True
        elif command == "tick" and s == "queued":
            self.status = "processing"
        elif command == "tick" and s == "processing" and (self.stop or self.pause):
            self.status, self.stop, self.pause = ("stopped" if self.stop else "paused"), False, False
        elif command in ("finish_ok", "finish_fail") and s == "processing":
            self.status = "done" if command == "finish_ok" else "failed"
        else:
            return False
        return True


TRANSITION = "job_id string, seq long, before string, command string, after string, accepted boolean, stop_flag boolean, pause_flag boolean"


def transitions(commands: DataFrame) -> DataFrame:
    """One row for each command (job_id, seq, command) of each job, from pending on. A job's commands stream through a task in
    order; its state is three values, so its history needs no memory."""
    dealt = commands.select("job_id", F.col("seq").cast("long").alias("seq"), "command").repartition("job_id").sortWithinPartitions("job_id", "seq")
    names = [f.split()[0] for f in TRANSITION.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, job = object(), Job()
        for batch in batches:
            rows = []
            for job_id, seq, command in zip(*(c.to_pylist() for c in batch.columns)):
                if job_id != at:
                    at, job = job_id, Job()
                before = job.status
                accepted = job.apply(command)
                rows.append((job_id, seq, before, command, job.status, accepted, job.stop, job.pause))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.bool_()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    return dealt.mapInArrow(fold, TRANSITION)


def response_code(exists: Column, accepted: Column) -> Column:
    return F.when(~exists, 404).when(~accepted, 400).otherwise(200)


STARTABLE = ("pending", "stopped", "failed", "paused")


def start_code(status: Column, source_exists: Column) -> Column:
    """What a request to start a job gives: 404 without a job (null status), 400 from a status that can't be started, 410 if its
    source is gone, else 200."""
    return F.when(status.isNull(), 404).when(~status.isin(*STARTABLE), 400).when(~F.coalesce(source_exists, F.lit(False)), 410).otherwise(200)


def merged(patches: DataFrame, fields: list[str]) -> DataFrame:
    """The record of each job after its patches (job_id, seq, fields): of each field the last value that isn't null. An aggregate, so
    a job's patches are folded where they are read."""
    return patches.groupBy("job_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def lookup(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, status, code: 404 for an id that no job has."""
    found = asked.join(jobs.select("job_id", "status"), "job_id", "left")
    return found.withColumn("code", response_code(F.col("status").isNotNull(), F.lit(True)))


def history_records(listed: DataFrame, records: DataFrame) -> DataFrame:
    """position, job_id, status: the history's ids (position, job_id) with their records (job_id, body: JSON text), in its order. Ids
    without a record, and records that aren't objects, drop out."""
    body = F.try_parse_json("body")
    whole = records.filter(F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)))
    return listed.join(whole.select("job_id", F.try_variant_get(body, "$.status", "string").alias("status")), "job_id").select("position", "job_id", "status")


def deletions(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, code, dequeued: what a request to delete gives; 404 for no job, 400 for one that is processing."""
    found = asked.join(jobs.select("job_id", "status"), "job_id", "left")
    code = response_code(F.col("status").isNotNull(), deletable(F.col("status")))
    return found.select("job_id", code.alias("code"), ((code == 200) & (F.col("status") == "queued")).alias("dequeued"))


def cascade(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (files, cache, records, history, queue: each with job_id) without the rows of jobs whose deletion was accepted."""
    gone = deleted.filter("code = 200")
    return {name: without_job(table, gone) for name, table in tables.items()}


def logged_out(sessions: DataFrame, logouts: DataFrame) -> DataFrame:
    """``sessions`` without those whose token was handed back."""
    return sessions.join(logouts.select("token"), "token", "left_anti")


TERMINAL, POLL_S = ("done", "failed", "stopped"), 5


def polls(seconds: Column, status: Column) -> Column:
    """How often a client that asks every five seconds asks until a job has ended after so many; null if it hasn't."""
    return F.when(status.isin(*TERMINAL), F.greatest(F.lit(1), F.ceil(seconds / POLL_S)).cast("long"))


def history(jobs: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest jobs by order of upload, which is kept in ``seq``: a limit, so tasks send ``most`` rows each."""
    newest = jobs.orderBy(F.desc("seq")).limit(most)
    return newest.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("seq"))))


def overflow(jobs: DataFrame, most: int = HISTORY) -> DataFrame:
    """The jobs that fell out of the history, and whether they may be purged: the seq of the oldest one kept is one number."""
    cut = jobs.orderBy(F.desc("seq")).limit(most).agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("oldest"))
    older = jobs.join(F.broadcast(cut), (F.col("kept") >= most) & (F.col("seq") < F.col("oldest")))
    return older.drop("kept", "oldest").withColumn("purge", ~F.col("status").isin(*HELD))


def first_in_queue(queue: DataFrame) -> DataFrame:
    return queue.orderBy("seq").limit(1)


def dequeue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue entries whose job exists and is still queued."""
    return queue.join(jobs.filter("status = 'queued'"), "job_id", "left_semi")


def retention(files: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """The files (kind, stem, mtime) to delete at ``now``: uploads after a day unless their job isn't done, outputs after a
    week, scratch folders after a day."""
    age = F.unix_timestamp(now) - F.unix_timestamp("mtime")
    upload, output = UPLOAD_HOURS * 3600, OUTPUT_DAYS * 86_400
    old = files.filter(((F.col("kind") == "output") & (age > output)) | (F.col("kind").isin("upload", "tmp") & (age > upload)))
    held = jobs.filter("status <> 'done'").select(F.col("job_id").alias("stem"), F.lit("upload").alias("kind")).distinct()
    return old.join(held, ["kind", "stem"], "left_anti")


def outcome(pages: DataFrame, produced: Column) -> DataFrame:
    """From pages (job_id, page from 0, ok): status, partial, pages_completed, pages_total, failed_pages (from 1), failed_page."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("page") + 1)))
    summed = pages.groupBy("job_id").agg(F.count_if("ok").alias("pages_completed"), F.count(F.lit(1)).alias("pages_total"), failed.alias("failed_pages"), F.bool_or(produced).alias("produced"))
    status = F.when(F.col("pages_completed") == 0, "failed").when(F.col("produced"), "done").otherwise("failed")
    partial = (F.size("failed_pages") > 0) & (F.col("pages_completed") > 0)
    return summed.select("job_id", status.alias("status"), partial.alias("partial"), "pages_completed", "pages_total", "failed_pages", F.get("failed_pages", F.lit(0)).alias("failed_page"))


def page_ranges(pages: DataFrame, key: str) -> DataFrame:
    """Distinct pages (from 0) of each key as ranges from 1: ``1–3, 6, 8–10``."""
    own = pages.select(key, (F.col("page") + 1).alias("p")).distinct()
    island = own.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p")))
    runs = island.groupBy(key, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("ranges"))


def progress(page: Column, total: Column) -> Column:
    return F.floor(F.lit(5) + page / total * 80).cast("int")


def cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(cache.select("job_id", "page"), ["job_id", "page"], "left_semi")


def to_recognize(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(cache.select("job_id", "page"), ["job_id", "page"], "left_anti")


def without_job(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """``table`` without the rows of deleted jobs; a job that is processing can't be deleted (see ``deletable``)."""
    return table.join(deleted.select("job_id"), "job_id", "left_anti")


def deletable(status: Column) -> Column:
    return status != "processing"


def sessions_valid(sessions: DataFrame, now: Column) -> DataFrame:
    """Tokens whose thirty days, counted from the login, aren't over."""
    return sessions.filter(F.col("token").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("created_at") < SESSION_DAYS * 86_400))


def upload_code(name: Column, declared: Column, size: Column, image_ok: Column, most: int) -> Column:
    """The reason an upload is turned away, in order of the checks; 200 if it isn't."""
    n = F.lower(name)
    is_image = n.rlike(r"\.jpe?g\z")
    return F.when(F.coalesce(name, F.lit("")) == "", 400).when(~(n.endswith(".pdf") | is_image), 400).when(declared > most, 413).when(size > most, 413).when(size == 0, 400).when(is_image & ~image_ok, 400).otherwise(200)


def download_code(exists: Column, status: Column, file_exists: Column) -> Column:
    return F.when(~exists, 404).when(status != "done", 400).when(~F.coalesce(file_exists, F.lit(False)), 410).otherwise(200)


def health_status(ok: Column) -> Column:
    """An aggregate: ok if the store and the worker are."""
    return F.when(F.bool_and(ok), "ok").otherwise("degraded")
