"""Deletions carried out by tasks: a row for each path with what became of it.

A path that isn't there any more is no error: a deletion may run again, after a lost executor or for a micro-batch that is repeated, and ends
in the same state. File systems are those of Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from foliospark.operators.jobs import retention
from foliospark.sources.sink import opened

OUTCOME = "path string, outcome string, error string"


def _removed(path: str) -> tuple[str, str | None]:
    from pyarrow.fs import FileType

    try:
        fs, own = opened(path)
        kind = fs.get_file_info(own).type
        if kind == FileType.NotFound:
            return "missing", None
        (fs.delete_dir if kind == FileType.Directory else fs.delete_file)(own)
        return "deleted", None
    except FileNotFoundError:
        return "missing", None
    except Exception as e:  # a file that can't be deleted is a row; the others go
        return "failed", f"{type(e).__name__}: {e}"[:500]


def remove(files: DataFrame, column: str = "path") -> DataFrame:
    """Deletes each path of ``files``, folders with all they hold: path, outcome (deleted, missing, failed), error. It happens in the tasks of
    whatever action the result has; write the result once (``remove_into``), since a second action finds everything missing. A null path is
    left out, a path that is there twice is dealt to one task."""
    rows = files.filter(F.col(column).isNotNull()).select(F.col(column).alias("path")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_removed(path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o for o, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())], names=["path", "outcome", "error"])

    return rows.mapInArrow(run, OUTCOME)


def remove_into(files: DataFrame, log: str, run: str | None = None) -> DataFrame:
    """``remove``, its rows written to ``log`` (partitioned by run) before anything reads them. A run that is repeated replaces its rows."""
    run = run or uuid.uuid4().hex
    remove(files).withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(log)
    return files.sparkSession.read.schema(f"{OUTCOME}, run string").parquet(log).filter(F.col("run") == run).drop("run")


def purge(files: DataFrame, jobs: DataFrame, now: Column, log: str, run: str | None = None) -> DataFrame:
    """Deletes the files (path, kind, stem, mtime) that retention lets go at ``now`` and says what became of each."""
    return remove_into(retention(files, jobs, now), log, run)


def delete_jobs(requests: DataFrame, files: Callable[[], DataFrame], jobs: Callable[[], DataFrame], log: str, checkpoint: str) -> DataStreamWriter:
    """A writer that deletes the files (job_id, path) of the jobs that a stream of ``requests`` (job_id) names, but those of a job that is
    processing or unknown. ``files`` and ``jobs`` read the current tables. Outcomes go to ``log``, a run for each micro-batch; one that
    is repeated finds the files missing and ends alike."""
    from foliospark.operators.jobs import deletions

    def each(batch: DataFrame, number: int) -> None:
        accepted = deletions(batch.select("job_id").distinct(), jobs()).filter("code = 200")
        remove_into(files().join(accepted, "job_id", "left_semi"), log, f"batch-{number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
