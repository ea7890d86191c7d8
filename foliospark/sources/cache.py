"""The page cache at rest: a Parquet table partitioned by job, of which a job's entries are appended, compacted and dropped.

A write appends (``seq``: the number of the run; the last write of a page counts). ``compact`` leaves one row for each page of the jobs it is
asked for, by dynamic overwrite of their partitions alone; ``drop_jobs`` deletes the partitions of jobs that ended in full success."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.pages import newest
from foliospark.sources.removal import remove

# Characters that the names of partition folders have as % and their code (% itself first); control characters apart.
_ESCAPED = "%\"#'*/:=?\\{[]^"
CACHE = "page int, seq long, result string, job_id string"


def _there(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(own)


def writes_at(spark: SparkSession, path: str) -> DataFrame:
    """Every write (page, seq, result, job_id) at ``path``; none if nothing was written yet."""
    return spark.read.schema(CACHE).parquet(path) if _there(spark, path) else spark.createDataFrame([], CACHE)


def cache_at(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path`` (job_id, page, result): the last write of each page."""
    return newest(writes_at(spark, path))


def append(path: str, rows: DataFrame, run: int) -> None:
    """``rows`` (job_id, page, result) as writes of ``run``. A job's rows go to a few files of its partition."""
    own = rows.select("page", F.lit(run).cast("long").alias("seq"), "result", F.col("job_id").cast("string").alias("job_id"))
    own.write.mode("append").partitionBy("job_id").parquet(path)


def compact(spark: SparkSession, path: str, jobs: DataFrame) -> None:
    """Rewrites the partitions of ``jobs`` (job_id) with the last write of each page, as writes of their newest run. Other
    partitions aren't touched, and a failure leaves all as they were."""
    own = writes_at(spark, path).join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    whole = own.groupBy("job_id", "page").agg(F.max("seq").alias("seq"), F.max_by("result", "seq").alias("result")).select("page", "seq", "result", "job_id")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def drop_jobs(spark: SparkSession, path: str, finished: DataFrame) -> DataFrame:
    """Deletes the partitions of ``finished`` jobs (job_id, keep_cache: a job that didn't succeed in full keeps its own). path, outcome, error:
    what became of each (see ``removal.remove``)."""
    name = F.col("job_id").cast("string")
    for c in _ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    folders = finished.filter(~F.col("keep_cache")).select(F.concat(F.lit(path.rstrip("/") + "/job_id="), name).alias("path"))
    return remove(folders.distinct())
