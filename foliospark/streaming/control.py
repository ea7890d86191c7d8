"""Streaming counterparts of the batch folds: state by key, updated as events come. Each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.jobs import TRANSITION, Job
from foliospark.operators.limits import DAY_S

QUOTA = "key long, seq long, used long, refused boolean"


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job = Job(*state.get) if state.exists else Job()
    events = pd.concat(list(batches)).sort_values("seq")
    rows = []
    for seq, command in zip(events["seq"], events["command"]):
        before = job.status
        accepted = job.apply(command)
        rows.append((key[0], seq, before, command, job.status, accepted, job.stop, job.pause))
    state.update((job.status, job.stop, job.pause))
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in TRANSITION.split(", ")])


def transitions(commands: DataFrame) -> DataFrame:
    """The job machine over a stream of (job_id, seq, command); a job's events of one micro-batch are taken in order of seq."""
    own = commands.select("job_id", F.col("seq").cast("long").alias("seq"), "command")
    return own.groupBy("job_id").applyInPandasWithState(_job, TRANSITION, "status string, stop boolean, pause boolean", "append", GroupStateTimeout.NoTimeout)


def daily_quota(calls: DataFrame, most: int) -> DataFrame:
    """The window anchored at the first call over a stream of (key, seq, seconds)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        events = pd.concat(list(batches)).sort_values(["seconds", "seq"])
        rows = []
        for seq, t in zip(events["seq"], events["seconds"]):
            if start is None or t - start >= DAY_S:
                start, n = float(t), 0
            refused = n >= most
            n += not refused
            rows.append((key[0], seq, n, refused))
        state.update((start, int(n)))
        yield pd.DataFrame(rows, columns=["key", "seq", "used", "refused"])

    return calls.select("key", "seq", F.col("seconds").cast("double").alias("seconds")).groupBy("key").applyInPandasWithState(fold, QUOTA, "start double, n long", "append", GroupStateTimeout.NoTimeout)


def consume_queue(queue: DataFrame, jobs: Callable[[], DataFrame], run: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """A writer that, for each micro-batch, runs the entries whose job is still queued, in order of seq. ``jobs`` reads the
    current table of jobs."""

    def each(batch: DataFrame, _: int) -> None:
        run(batch.join(jobs().filter("status = 'queued'"), "job_id", "left_semi").orderBy("seq"))

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def calls_per_window(calls: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Calls in fixed windows of event time; an extension, not one of the limits."""
    return calls.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("calls"))
