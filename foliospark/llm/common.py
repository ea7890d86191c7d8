"""Shared pieces: the shared folder, written tables, ordering by id, vocabulary bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabularies are shipped to the executors in a broadcast; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Keys that ``by_size`` may broadcast, and the rows that such a key has at least.
HEAVY_KEYS, LEAST_HEAVY = 10_000, 64
#: Texts are handled in slices of about so many characters, so that memory doesn't follow the size of an Arrow batch.
SLICE_CHARS = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``). Where it is unset and all executors are on this
    machine, as in tests, a temporary folder is set as the checkpoint folder first; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors on other machines don't see this one's")
        base = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by whatever follows, no lineage behind it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scratches:
        _scratches[-1].made.append(out)
    return out


class Scratch:
    """``with Scratch() as own``: tables that ``written`` makes inside are deleted at the end, but those that ``own.keep`` got. After an
    error they stay."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [x for x in self.made if x.written_to != df.written_to]
        return df

    def __enter__(self) -> Scratch:
        _scratches.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scratches.remove(self)
        if kind is None:
            discard(*self.made)


_scratches: list[Scratch] = []


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to be computed reads them."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


def heavy_keys(sizes: DataFrame, total: int) -> DataFrame | None:
    """The rows of ``sizes`` (a key, and the number ``n`` of rows that have it, of ``total`` or fewer in all) with more than ``total / HEAVY_KEYS``
    rows, as a local table: there are fewer than HEAVY_KEYS of them. None if there are none."""
    found = sizes.filter(F.col("n") > most_rows(total)).toArrow()
    return sizes.sparkSession.createDataFrame(found, sizes.schema) if found.num_rows else None


def most_rows(total: int) -> int:
    """The rows that a key may have without being a heavy one."""
    return max(LEAST_HEAVY, total // HEAVY_KEYS)


def by_size(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``sizes``, which has a row for each ``key`` with the number ``n`` of rows (of ``total`` or fewer in all) that have
    it. A key with more than ``total / HEAVY_KEYS`` rows isn't shuffled: there are fewer than HEAVY_KEYS of them, which is the bound
    of what the driver gets and broadcasts. No task gets more than that share of the rows by one of the others."""
    heavy = heavy_keys(sizes, total)
    if heavy is None:
        return rows.join(sizes, key)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(sizes.filter(F.col("n") <= most_rows(total)), key)
    return rows.join(F.broadcast(heavy), key).unionByName(others)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str) -> bytes:
    """The file's bytes, read on the driver."""
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, "rb") as f:
        return f.read()


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``most`` characters each, one text at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def range_bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """At most ``parts - 1`` ascending values that cut ``column`` into even ranges."""
    if parts < 2:
        return []
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted(set(found))


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many of ``bounds`` are at most ``value`` (0 for null): a search in two steps, so that its cost per row is the
    square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    v = value.cast("double")
    every = F.array(*[F.lit(b) for b in bounds])
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    block = F.size(F.filter(heads, lambda b: b <= v))
    begin = F.greatest(block - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(every, begin + 1, F.lit(step)), lambda b: b <= v))
    return F.when(v.isNull() | (block == 0), F.lit(0)).otherwise(begin + inside).cast("int")
