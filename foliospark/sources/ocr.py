"""Recognition as a source: providers by name, answers cached by page, only missing pages sent.

A provider is built once in each task, from a configuration that may name a key or a temperature. It takes image bytes and a prompt and returns
the response's text; it may have ``load`` and ``health``. A page's failure is a value (``error``), not a task's failure."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FuturesTimeout
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.jobs import to_recognize
from foliospark.operators.pages import cache_hits
from foliospark.sources.cache import append, cache_at


class Provider(Protocol):
    def analyse(self, image: bytes, prompt: str) -> str: ...


class Retryable(Exception):
    """A call that may be made again, after ``after`` seconds if the server said so."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


_makers: dict[str, Callable[[dict], Provider]] = {}


def register(name: str, make: Callable[[dict], Provider]) -> None:
    _makers[name.lower()] = make


def provider(name: str, config: dict) -> Provider:
    make = _makers.get(name.lower())
    if make is None:
        raise ValueError(f"no provider {name!r}; there are: {', '.join(sorted(_makers)) or 'none'}")
    return make(config)


def loaded(make: Callable[[dict], Provider], config: dict) -> Provider | Exception:
    """The provider, after its ``load`` if it has one; the error if either fails."""
    try:
        own = make(config)
        if hasattr(own, "load"):
            own.load()
        return own
    except Exception as e:
        return e


def provider_health(spark: SparkSession, name: str, config: dict, tasks: int = 1) -> DataFrame:
    """task, ok, error: whether the provider can be built, loaded and says that it is well (``health``, if it has that), asked in ``tasks``
    tasks of the executors."""
    make = _makers.get(name.lower()) or (lambda config: provider(name, config))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = loaded(make, config)
            error = f"{type(own).__name__}: {own}" if isinstance(own, Exception) else None if not hasattr(own, "health") or own.health() else "not well"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([error is None] * batch.num_rows), pa.array([error] * batch.num_rows, pa.string())], names=["task", "ok", "error"])

    return spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task")).mapInArrow(ask, "task long, ok boolean, error string")


class Fixture:
    """Answers from a given table, for tests: the image's bytes are the key."""

    def __init__(self, config: dict):
        self.answers = config["answers"]

    def analyse(self, image: bytes, prompt: str) -> str:
        return self.answers[image.decode()]


register("fixture", Fixture)


class Pace:
    """The times at which one of ``tasks`` tasks may make its calls, so that all of them make ``rpm`` a minute and none is lost: slots of
    60 / rpm seconds are dealt out in turn, a task's first one is that of its number, and a task leaves as many slots between its calls as
    there are tasks. A task that is run again waits for a round of slots first, as its calls before may just have been made."""

    def __init__(self, rpm: int, tasks: int, task: int, begin: float, again: bool = False, slack: float = 0.1, clock=time.time, sleep=time.sleep):
        slot = (60.0 + slack) / rpm
        self.between, self.clock, self.sleep = slot * tasks, clock, sleep
        self.next = begin + slot * task
        if again:
            self.next = max(self.next, clock() + self.between)

    def wait(self) -> None:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.between


class Timed:
    """Calls that may take ``seconds`` at most. One that takes longer is left behind with its thread, and is a TimeoutError."""

    def __init__(self, seconds: float | None):
        self.seconds, self.threads = seconds, None

    def call(self, function: Callable, *args):
        if self.seconds is None:
            return function(*args)
        self.threads = self.threads or ThreadPoolExecutor(1)
        try:
            return self.threads.submit(function, *args).result(self.seconds)
        except FuturesTimeout:
            self.threads.shutdown(wait=False)
            self.threads = None
            raise TimeoutError(f"no answer in {self.seconds} seconds") from None


def pause(attempt: int, after: float | None, is_api_error: bool, base: float, cap: float, draw=random.uniform) -> float:
    """Seconds before the next attempt: the server's hint within its bounds, else drawn between base and a ceiling that doubles; for other
    errors a multiple of base."""
    if not is_api_error:
        return min(cap, base * attempt)
    if after is not None:
        return min(cap, max(0.5, after))
    return draw(base, max(base, min(cap, base * 2 ** (attempt - 1))))


def recognize(pages: DataFrame, cache: DataFrame, name: str, config: dict, prompt: str, *, rpm: int = 2000, per_day: int | None = None, attempts: int = 8, base: float = 4.0, cap: float = 120.0, tasks: int = 8, timeout_s: float | None = 120.0) -> DataFrame:
    """job_id, page, result, error: pages with a usable cache entry as they are, the others from the provider. ``pages`` has job_id, page,
    image. Of the latter only the first ``per_day``, by job and page, are sent; the rest have an error. Every call, repeated ones too, has a
    slot of its own of the ``rpm`` a minute, dealt out over ``tasks`` in turn (see ``Pace``), and ``timeout_s`` seconds. A provider that can't be
    loaded fails its pages. The caller writes the rows before using them (see ``recognize_into``)."""
    if name.lower() not in _makers:
        provider(name, config)  # says what there is
    make = _makers[name.lower()]
    begin = time.time()
    whole = cache_hits(cache)
    todo = to_recognize(pages.withColumn("page", F.col("page").cast("int")), whole.withColumn("page", F.col("page").cast("int"))).select("job_id", "page", "image")
    rest = None
    if per_day is not None:
        sent = todo.select("job_id", "page").orderBy("job_id", "page").limit(per_day)
        todo, rest = todo.join(sent, ["job_id", "page"], "left_semi"), todo.join(sent, ["job_id", "page"], "left_anti")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own, pace, timed = loaded(make, config), Pace(rpm, tasks, context.partitionId(), begin, context.attemptNumber() > 0), Timed(timeout_s)
        for batch in batches:
            results, errors = [], []
            for image in batch.column(2).to_pylist():
                result = error = None
                for attempt in range(1, attempts + 1):
                    if isinstance(own, Exception):
                        error = f"{type(own).__name__}: {own}"
                        break
                    pace.wait()
                    try:
                        result, error = timed.call(own.analyse, image, prompt), None
                        break
                    except (Retryable, ConnectionError, TimeoutError) as e:
                        error = f"{type(e).__name__}: {e}"
                        if attempt < attempts:
                            time.sleep(pause(attempt, getattr(e, "after", None), isinstance(e, Retryable), base, cap))
                    except Exception as e:  # the page fails, not the job
                        error = f"{type(e).__name__}: {e}"
                        break
                results.append(result)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=["job_id", "page", "result", "error"])

    fresh = todo.repartition(tasks).mapInArrow(call, "job_id string, page int, result string, error string")
    known = pages.select("job_id", F.col("page").cast("int").alias("page")).join(whole.select("job_id", F.col("page").cast("int").alias("page"), "result"), ["job_id", "page"])
    found = fresh.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    if rest is not None:
        found = found.unionByName(rest.select("job_id", "page", F.lit(None).cast("string").alias("result"), F.lit("DailyLimit: no calls are left today").alias("error")))
    return found


def recognize_into(path: str, run: int, pages: DataFrame, name: str, config: dict, prompt: str, **limits) -> DataFrame:
    """``recognize`` with the cache at ``path`` (see ``cache``): new results are appended there as writes of ``run`` (runs ascend) before anything
    reads them, so no page is paid for twice. The answer to each page that has one; a page that failed has no row and is tried by the next
    run."""
    spark = pages.sparkSession
    pages = pages.withColumn("job_id", F.col("job_id").cast("string"))
    before = cache_at(spark, path)
    found = recognize(pages, before, name, config, prompt, **limits)
    known = cache_hits(before).select("job_id", "page")
    append(path, found.filter("result is not null").join(known, ["job_id", "page"], "left_anti"), run)
    return cache_at(spark, path).join(pages.select("job_id", F.col("page").cast("int").alias("page")), ["job_id", "page"], "left_semi")
