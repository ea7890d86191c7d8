"""Token ids in files of length-delimited binary records, with a separate index of offsets.

A record file holds frames: length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of
the payload (4); integers are little-endian and a checksum is masked by a rotation of 15 bits and a constant, as record
files of this kind do. A payload is the document's id (8 bytes), a flag byte (bit 0: the id is null; bit 1: ids have four
bytes, not two), and the ids. The index file has one entry of 24 bytes for each record: offset of its frame, number of ids before it in the file,
document id; a reader takes any record, in any order, with one seek.

Files are ranges of ``doc_id``, and their numbers ascend with it. A task writes beside its target and renames at the end,
and the same input gives the same bytes, so a task that runs twice does no harm."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import range_bounds, range_of, shared_folder, shuffle_partitions, vocabulary
from foliospark.llm.tokens import encoder

#: Fixed value of the record format: added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL, ENTRY = 12, 4, 24
#: Records that one reading task takes from a file.
RECORDS_PER_TASK = 20_000
#: Bytes read at once.
READ_BYTES = 8 << 20


class CorruptRecord(ValueError):
    pass


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one begins; CorruptRecord if anything was changed or cut."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or masked(length) != int.from_bytes(data[at + 8 : at + HEAD], "little"):
        raise CorruptRecord(f"length at {at}")
    end = at + HEAD + int.from_bytes(length, "little")
    payload = bytes(data[at + HEAD : end])
    if end + TAIL > len(data) or masked(payload) != int.from_bytes(data[end : end + TAIL], "little"):
        raise CorruptRecord(f"payload at {at}")
    return payload, end + TAIL


def serialize(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """``ids``: little-endian unsigned 32-bit; narrow payloads keep two bytes of each."""
    flags = (doc_id is None) | wide << 1
    body = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([flags]) + body


def deserialize(payload: bytes) -> tuple[int | None, bytes]:
    flags = payload[8]
    ids = payload[9:] if flags & 2 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes()
    return None if flags & 1 else int.from_bytes(payload[:8], "little", signed=True), ids


#: Schemes of Spark's file systems, and those under which the workers' library has the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "abfss": "abfss", "abfs": "abfs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def worker_path(spark: SparkSession, path: str) -> str:
    """``path`` as workers open it. Spark resolves it, so a path without a scheme is one of its default file system, not of a
    worker's own disk. ValueError for a store that workers can't reach, and for a local folder on a cluster unless it
    is in spark.checkpoint.dir, which all machines share."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    whole = str(own.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())
    scheme, rest = whole.split(":", 1)
    if scheme not in SCHEMES:
        raise ValueError(f"workers have no file system for {scheme}: {path}")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = re.sub("^file:/+", "/", whole)
    inside = bool(shared) and local.startswith(re.sub("^file:/+", "/", shared.rstrip("/")) + "/")
    if scheme == "file" and not inside and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"a folder of one machine, where others don't see it: {path}")
    return f"file://{local}" if scheme == "file" else f"{SCHEMES[scheme]}:{rest}"


def write_records(docs: DataFrame, path: str, spec: bytes, end_id: int | None, *, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> list[dict]:
    """Writes the ids of every whole text (null: empty) in ascending order of id, equal ids in order of their texts, null
    ids first, and returns the manifest: one entry for each file, in order. ``end_id`` ends each document unless it is None.
    An empty table gives no files. Other columns are not read."""
    spark = docs.sparkSession
    path = worker_path(spark, path)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    parts = parts or shuffle_partitions(spark)
    bounds = range_bounds(rows, "doc_id", parts)
    dealt = rows.withColumn("part", range_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "text")
    sent = spark.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(sent.value)
        wide = codec.vocabulary_size > 65536 or (end_id or 0) > 65535
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        attempt = f".{context.taskAttemptId()}"
        done, name, out, index, at, tokens = [], None, None, [], 0, 0

        def close():
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx{attempt}") as f:
                f.write(b"".join(index))
            for kind in (".idx", ".rec"):
                store.move(f"{folder}/{name}{kind}{attempt}", f"{folder}/{name}{kind}")
            done.append((int(name), len(index), tokens, at))

        for batch in batches:
            part, ids, texts = (batch.column(i) for i in range(3))
            encoded = codec.encode(texts.to_pylist())
            for p, doc_id, found in zip(part.to_pylist(), ids.to_pylist(), encoded):
                if name != f"{p:08d}":
                    if out:
                        close()
                    name, index, at, tokens = f"{p:08d}", [], 0, 0
                    out = store.open_output_stream(f"{folder}/{name}.rec{attempt}")
                found += end
                data = frame(serialize(doc_id, found, wide))
                out.write(data)
                index.append(at.to_bytes(8, "little") + tokens.to_bytes(8, "little") + (doc_id or 0).to_bytes(8, "little", signed=True))
                at, tokens = at + len(data), tokens + len(found) // 4
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)] if done else [pa.array([], pa.int64())] * 4, names=["part", "records", "tokens", "bytes"])

    manifest = dealt.select("part", "doc_id", "text").mapInArrow(write, "part long, records long, tokens long, bytes long")
    return sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["part"])


def read_records(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """One row for each record, every checksum verified: doc_id, start (ids of all records before it), n_tokens,
    ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), file and offset. A changed or cut file
    raises CorruptRecord."""
    path, items, base = worker_path(spark, path), [], 0
    for m in manifest:
        items += [(m["part"], base, a, min(a + RECORDS_PER_TASK, m["records"]), m["records"], m["tokens"]) for a in range(0, m["records"], RECORDS_PER_TASK)]
        base += m["tokens"]
    work = spark.createDataFrame(items, "part long, base long, begin long, end long, records long, tokens long")
    if items:
        work = work.repartition(len(items))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        for batch in batches:
            for part, base, begin, end, records, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                name, last = f"{folder}/{part:08d}", end == records
                with store.open_input_file(f"{name}.idx") as f:  # the slice's own entries, and the one after it
                    entries = np.frombuffer(f.read_at((end - begin + (not last)) * ENTRY, begin * ENTRY), "<i8").reshape(-1, 3)
                    if f.size() != records * ENTRY:
                        raise CorruptRecord(f"{name}: the index has another number of records")
                with store.open_input_file(f"{name}.rec") as f:
                    offsets = np.append(entries[:, 0], f.size()) if last else entries[:, 0]
                    starts = base + (np.append(entries[:, 1], tokens) if last else entries[:, 1])
                    sizes = np.diff(starts)
                    at, n = 0, end - begin
                    while at < n:
                        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES, "right")) - 1)
                        data = memoryview(f.read_at(int(offsets[upto] - offsets[at]), int(offsets[at])))
                        rows = []
                        for i in range(at, upto):
                            payload, after_it = unframe(data, int(offsets[i] - offsets[at]))
                            doc_id, ids = deserialize(payload)
                            if after_it != offsets[i + 1] - offsets[at] or len(ids) // 4 != sizes[i]:
                                raise CorruptRecord(f"{name}: record {begin + i} differs from its index entry")
                            rows.append((doc_id, int(starts[i]), len(ids) // 4, zlib.crc32(ids), part, int(offsets[i])))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "file_offset"])
                        at = upto

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file long, file_offset long")


def record_at(path: str, part: int, number: int) -> tuple[int | None, bytes]:
    """One record by its number, through the index: what a shuffled reader does. ``path`` as ``worker_path`` gives it."""
    store, folder = _open(path)
    with store.open_input_file(f"{folder}/{part:08d}.idx") as f:
        at = int.from_bytes(f.read_at(8, number * ENTRY), "little")
    with store.open_input_file(f"{folder}/{part:08d}.rec") as f:
        length = int.from_bytes(f.read_at(8, at), "little")
        return deserialize(unframe(f.read_at(HEAD + length + TAIL, at))[0])


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the records of ``docs`` in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "records")
    return read_records(spark, path, write_records(docs, path, vocabulary(tokenizer), end_id))
