"""Streams with timers and a time to live, the page loop, the cache at rest, deletions, the log: each over several micro-batches and a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import jobs as Q
from foliospark.operators import limits as L
from foliospark.sources import cache, ocr, removal
from foliospark.streaming import loop, timed


class Source:
    """A folder of Parquet files, one taken by each micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        time.sleep(1.1)  # files are taken by age

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def into(streamed, out, checkpoint, rows=None):
    """Runs a stream until it has taken what is there; one that goes by the clock has no end, so it is stopped after so many ``rows``."""
    writer = streamed.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append")
    if rows is None:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(120)
    else:
        q = writer.trigger(processingTime="1 second").start()
        until = time.time() + 90
        while time.time() < until and q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < rows:
            time.sleep(0.5)
        q.stop()
    assert q.exception() is None


def test_sliding_stream_equals_batch(spark, tmp_path):
    timed.use_state_store(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    dense = events.select((F.col("user_id") % 3).alias("key"), F.col("event_id").alias("seq"), F.timestamp_micros((F.col("event_id") * 7_300_000 + F.col("user_id") % 5 * 11_000).cast("long")).alias("ts"))
    rows = [(r["key"], r["seq"], r["ts"]) for r in dense.orderBy("seq").limit(300).collect()]
    own = spark.createDataFrame(rows, dense.schema)
    last = own.agg(F.max("ts")).first()[0]
    import datetime

    end = [(k, 10_000 + k, last + datetime.timedelta(days=2)) for k in range(3)]
    source = Source(spark, tmp_path / "in", dense.schema)
    mixed = rows[:100][::-1] + rows[100:]  # the first file's rows come in another order
    source.add(mixed[:100])
    source.add(mixed[100:200])
    into(timed.sliding_counts(source.stream(), "30 seconds"), tmp_path / "out", tmp_path / "cp")
    source.add(mixed[200:])
    source.add(end)
    into(timed.sliding_counts(source.stream(), "30 seconds"), tmp_path / "out", tmp_path / "cp")  # a restart
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("seq < 10000").collect())
    want = sorted((r["key"], r["seq"], r["in_window"]) for r in L.sliding_counts(own, "key", "ts").collect())
    assert got == want and max(n for _, _, n in want) > 2


def test_sessions_stream_equals_batch(spark, tmp_path):
    timed.use_state_store(spark)
    signups = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_type = 'signup'").select(F.col("event_id").cast("string").alias("token"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("created_at")).limit(60).cache()
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = signups.filter("seq % 4 = 0")
    event = lambda df, what, ts: df.select("token", "seq", F.lit(what).alias("event"), ts.alias("ts"))
    login = event(signups, "login", F.col("created_at"))
    source = Source(spark, tmp_path / "in", login.schema)
    source.add(login.collect())
    source.add(event(out, "logout", F.col("created_at") + F.expr("interval 1 hour")).collect())
    into(timed.sessions(source.stream()), tmp_path / "out", tmp_path / "cp", signups.count() + out.count())
    source.add(event(signups, "check", now).collect() + [("unknown", 1, "check", signups.select(now).first()[0]), (None, 2, "login", signups.select(now).first()[0])])
    into(timed.sessions(source.stream()), tmp_path / "out", tmp_path / "cp", signups.count() + 1)
    got = {r["token"] for r in spark.read.parquet(str(tmp_path / "out")).filter("valid").collect()}
    want = {r["token"] for r in Q.logged_out(Q.sessions_valid(signups, now), out).collect()}
    assert got == want and 0 < len(want) < 60


def counting():
    class Counting:  # made here, so that it goes to the workers by value
        def __init__(self, config):
            self.folder = config["folder"]

        def analyse(self, image, prompt):
            import uuid

            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            if image == b"bad":
                raise ValueError("no page")
            return '{"blocks": []}'

    return Counting


def test_page_loop_stops_between_batches_and_calls_no_page_twice(spark, tmp_path):
    ocr.register("loop", counting())
    calls = tmp_path / "calls"
    calls.mkdir()
    source = Source(spark, tmp_path / "in", "job_id string, page int, image binary")
    for p in range(3):
        source.add([("a", p, b"x"), ("b", p, b"bad" if p == 1 else b"x")])
    flagged = [[]]
    flags = lambda: spark.createDataFrame(flagged[-1], "job_id string, flag string")
    store, log = f"{tmp_path}/cache", f"{tmp_path}/log"

    def run():
        q = loop.page_loop(source.stream(), flags, store, log, f"{tmp_path}/cp", "loop", {"folder": str(calls)}, "p", tasks=2, attempts=1).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    run()
    assert len(os.listdir(calls)) == 6
    totals = spark.createDataFrame([("a", 4), ("b", 4)], "job_id string, pages_total long")
    read = lambda: {r["job_id"]: tuple(r)[1:] for r in loop.loop_outcome(spark.read.schema(loop.TRIED).parquet(log), totals).collect()}
    assert read() == {"a": (3, 3, 4, "processing", True), "b": (3, 2, 4, "processing", True)}
    flagged.append([("b", "pause"), ("b", "stop")])
    source.add([("a", 3, b"x"), ("b", 3, b"x"), ("a", 0, b"x")])  # a page of before once more
    run()
    assert len(os.listdir(calls)) == 7
    assert read() == {"a": (4, 4, 4, "done", False), "b": (3, 2, 4, "stopped", True)}
    # the last micro-batch again, as after a lost driver
    last = max(int(f) for f in os.listdir(tmp_path / "cp" / "commits") if f.isdigit())
    for f in (tmp_path / "cp" / "commits" / str(last), tmp_path / "cp" / "commits" / f".{last}.crc"):
        f.unlink(missing_ok=True)
    run()
    assert len(os.listdir(calls)) == 7 and read()["a"] == (4, 4, 4, "done", False)
    # the cache at rest: full success drops a job's partition
    outcome = loop.loop_outcome(spark.read.schema(loop.TRIED).parquet(log), totals)
    assert [(r["path"].rpartition("/")[2], r["outcome"]) for r in cache.drop_jobs(spark, store, outcome).collect()] == [("job_id=a", "deleted")]
    assert sorted(d for d in os.listdir(store) if d.startswith("job_id")) == ["job_id=b"]
    assert [r["outcome"] for r in cache.drop_jobs(spark, store, outcome).collect()] == ["missing"]


def test_cache_is_compacted_by_job(spark, tmp_path):
    path = f"{tmp_path}/cache"
    rows = lambda *r: spark.createDataFrame(r, "job_id string, page int, result string")
    for run in range(3):
        cache.append(path, rows(("a b/c=é", 0, f"{{{run}}}"), ("x", 1, f"{{{run}}}"), ("x", run + 5, "{}")), run)
    before = sorted(map(tuple, cache.cache_at(spark, path).collect()))
    cache.compact(spark, path, rows(("x", 0, "")))
    assert cache.writes_at(spark, path).filter("job_id = 'x'").count() == 4 and cache.writes_at(spark, path).filter("job_id <> 'x'").count() == 3
    assert sorted(map(tuple, cache.cache_at(spark, path).collect())) == before and cache.cache_at(spark, f"{tmp_path}/none").count() == 0
    done = spark.createDataFrame([("a b/c=é", False), ("x", True), ("never", False)], "job_id string, keep_cache boolean")
    assert sorted(r["outcome"] for r in cache.drop_jobs(spark, path, done).collect()) == ["deleted", "missing"]
    assert {r["job_id"] for r in cache.writes_at(spark, path).collect()} == {"x"}


def test_files_are_deleted_with_outcomes(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("old.pdf", "held.pdf", "new.pdf", "out.pdf"):
        (folder / name).write_bytes(b"x")
    (folder / "work").mkdir()
    (folder / "work" / "page").write_bytes(b"y")
    at = lambda days: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(1_700_000_000 - days * 86_400))
    files = spark.createDataFrame([(f"{folder}/old.pdf", "upload", "old", at(2)), (f"{folder}/held.pdf", "upload", "held", at(2)), (f"{folder}/new.pdf", "upload", "new", at(0)), (f"{folder}/out.pdf", "output", "out", at(8)), (f"{folder}/work", "tmp", "work", at(2)), (f"{folder}/gone.pdf", "output", "gone", at(9)), (None, "tmp", "z", at(9))], "path string, kind string, stem string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    jobs = spark.createDataFrame([("held", "failed"), ("old", "done")], "job_id string, status string")
    now, log = F.lit(at(0)).cast("timestamp"), f"{tmp_path}/log"
    for want in ({"old.pdf": "deleted", "out.pdf": "deleted", "work": "deleted", "gone.pdf": "missing"}, {"old.pdf": "missing", "out.pdf": "missing", "work": "missing", "gone.pdf": "missing"}):
        assert {os.path.basename(r["path"]): r["outcome"] for r in removal.purge(files, jobs, now, log, "r").collect()} == want
        assert sorted(os.listdir(folder)) == ["held.pdf", "new.pdf"]
    source = Source(spark, tmp_path / "in", "job_id string")
    owned = spark.createDataFrame([("a", f"{folder}/held.pdf"), ("b", f"{folder}/new.pdf")], "job_id string, path string")
    states = spark.createDataFrame([("a", "done"), ("b", "processing")], "job_id string, status string")
    for asked in ([("a",), ("b",), ("c",)], [("a",)]):
        source.add(asked)
    q = removal.delete_jobs(source.stream(), lambda: owned, lambda: states, log, f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and os.listdir(folder) == ["new.pdf"]
    rows = spark.read.schema(f"{removal.OUTCOME}, run string").parquet(log)
    assert sorted((r["run"], r["outcome"]) for r in rows.filter("run like 'batch%'").collect()) == [("batch-0", "deleted"), ("batch-1", "missing")]


def test_log_of_streams(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "i long")
    source.add([(1,), (2,)])
    source.add([(3,)])
    path = f"{tmp_path}/events"

    def fails(batch, _):
        raise ValueError("no")

    with loop.ProgressLog(spark, path):
        good = source.stream().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start()
        good.awaitTermination(120)
        bad = source.stream().writeStream.foreachBatch(fails).option("checkpointLocation", f"{tmp_path}/b").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no"):
            bad.awaitTermination(120)
        for _ in range(60):
            time.sleep(0.5)
            if os.path.isdir(path) and spark.read.schema(loop.EVENTS).parquet(path).filter("event in ('ended', 'failed')").count() == 2:
                break
    events = spark.read.schema(loop.EVENTS).parquet(path)
    got = {r["query"]: (r["state"], r["rows"]) for r in loop.query_health(events, F.current_timestamp()).collect()}
    assert got == {str(good.id): ("ended", 3), str(bad.id): ("failed", 0)}
    quiet = spark.createDataFrame([("q", "r", "started", "2024-01-01 00:00:00")], "query string, run string, event string, at string").select("query", "run", "event", F.col("at").cast("timestamp").alias("at"), F.lit(None).cast("long").alias("rows"))
    assert [loop.query_health(quiet, F.lit(f"2024-01-01 00:{m}:00").cast("timestamp")).first()["state"] for m in ("01", "59")] == ["ok", "degraded"]


def test_provider_health(spark):
    class Broken:
        def __init__(self, config):
            pass

        def load(self):
            raise KeyError("no key")

        def analyse(self, image, prompt):
            return "{}"

    class Ill(counting()):
        def health(self):
            return False

    ocr.register("broken", Broken)
    ocr.register("ill", Ill)
    assert ocr.provider_health(spark, "broken", {}).first()["error"] == "KeyError: 'no key'"
    assert [tuple(r) for r in ocr.provider_health(spark, "ill", {"folder": "/"}, 2).collect()] == [(0, False, "not well"), (1, False, "not well")]
    assert not ocr.provider_health(spark, "nobody", {}).first()["ok"]
    pages = spark.createDataFrame([("j", 0, b"x")], "job_id string, page int, image binary")
    none = spark.createDataFrame([], "job_id string, page int, result string")
    assert "no key" in ocr.recognize(pages, none, "broken", {}, "p").first()["error"]
