"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (the text between line feeds) is hashed to a wide vector of 16-bit lanes, and a document's fingerprint is the sum
of its paragraphs' vectors modulo 2**16: the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding
or subtracting its vector. ``IDENTITY`` lanes come from SHAKE-128 of the whole paragraph and tell multisets apart. ``SIGNS`` lanes sum
+1 or -1 for each shingle of three words of the paragraph, repeats included; read as signed numbers they estimate how much two
multisets of shingles differ, so fingerprints alone give a likeness. A lane wraps at 2**15 shingles of surplus in one
direction, which a text reaches only by repeating a shingle more than 32,767 times; likeness is then only a rough one, and
equality isn't touched."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import range_bounds, range_of, shuffle_partitions

IDENTITY, SIGNS, SHINGLE = 64, 256, 3
LANES = IDENTITY + SIGNS
#: A run without white space counts as words of this length.
WORD_CHARS = 16
AT_ONCE = 4096
#: Odd multipliers that draw 64 signs each from a shingle's hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_WORD = re.compile(r"\S{1,%d}" % WORD_CHARS)
_TEXT_MARK, _NO_WORDS = b"\x01", b"\x02"


def _units(paragraph: str) -> list[bytes]:
    words = _WORD.findall(paragraph)
    if not words:
        return [_NO_WORDS] if not paragraph else [_NO_WORDS + paragraph.encode()]
    if len(words) < SHINGLE:
        return [" ".join(words).encode()]
    return [f"{a} {b} {c}".encode() for a, b, c in zip(words, words[1:], words[2:])]


def _signs(units: list[bytes]) -> np.ndarray:
    import xxhash

    digest, total = xxhash.xxh3_64_intdigest, np.zeros(SIGNS, np.int64)
    for i in range(0, len(units), AT_ONCE):
        h = np.array([digest(u) for u in units[i : i + AT_ONCE]], np.uint64)
        h = h[:, None] * _MIX[: SIGNS // 64]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        total += 2 * np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16).astype(np.int64) - len(h)
    return total


def vector(paragraphs: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors, as unsigned 16-bit lanes."""
    total = np.zeros(LANES, np.uint16)
    if paragraphs:
        digests = [hashlib.shake_128(_TEXT_MARK + p.encode()).digest(2 * IDENTITY) for p in paragraphs]
        total[:IDENTITY] = np.frombuffer(b"".join(digests), "<u2").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64).astype(np.uint16)
        total[IDENTITY:] = _signs([u for p in paragraphs for u in _units(p)]).astype(np.uint16)
    return total


def text_vector(text: str) -> np.ndarray:
    return vector(text.split("\n"))


def edited_vector(whole: np.ndarray, text: str, edited: str) -> np.ndarray:
    """The vector of ``edited`` from that of ``text``: what follows their last shared line feed is taken out and put in."""
    shared = _shared(text, edited)
    cut = text.rfind("\n", 0, shared) + 1
    return whole - vector(text[cut:].split("\n")) + vector(edited[cut:].split("\n"))


def _shared(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else 1 - |A - B|**2 / (|A|**2 + |B|**2) of the multisets of shingles, as the sign lanes
    estimate it, within 0 and 1."""
    if (a == b).all():
        return 1.0
    x, y, d = ((v[IDENTITY:]).view(np.int16).astype(np.float64) for v in (a, b, a - b))
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 1 - (d @ d) / size))) if size else 0.0


def encode(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u2")


def insert(fingerprint: str, paragraphs: list[str]) -> str:
    return encode(decode(fingerprint) + vector(paragraphs))


def delete(fingerprint: str, paragraphs: list[str]) -> str:
    return encode(decode(fingerprint) - vector(paragraphs))


def fingerprint_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text; a null text is an empty one."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(text_vector(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(hash_texts, "doc_id long, fingerprint string")


def compare_with_edit(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document against its edited text, whose last quarter of code points is the beginning of the next document's, and
    against the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Next is next in ascending doc_id, nulls first, equal ids in order of their texts, and the first document after the last
    (itself, if it is the only one). A null text is an empty one; an empty table gives no rows. Texts move once, to ranges of
    ids; the first document of each range also goes to the range before, so no range waits for another."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", shuffle_partitions(spark))
    part = range_of(F.col("doc_id"), bounds)
    firsts = rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.max(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("least")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], _EDITED)
    found = {r["part"]: None if r["none"] else r["least"] for r in firsts}
    order = sorted(found)
    before = dict(zip(order[1:] + order[:1], order))
    first_ids = F.array(*[F.lit(found.get(p)).cast("long") for p in range(len(bounds) + 1)])
    parts_before = F.array(*[F.lit(before.get(p, 0)) for p in range(len(bounds) + 1)])
    member = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.get(parts_before, F.col("part")).alias("part"), F.lit(True).alias("ahead"))
    to = F.when(F.col("doc_id").eqNullSafe(F.get(first_ids, F.col("part"))), F.array(member, ahead)).otherwise(F.array(member))
    dealt = rows.withColumn("part", part).withColumn("to", F.explode(to)).select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "text")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, vector of the document whose next one comes
        for batch in batches:
            out = []
            for p, is_ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if is_ahead and (held is None or held[0] != p):
                    continue  # a further document of the next range
                own = text_vector(text)
                if held is not None:
                    _, held_id, held_text, held_vector = held
                    quarter = len(held_text) // 4
                    edited = held_text[: len(held_text) - quarter] + text[:quarter]
                    after = edited_vector(held_vector, held_text, edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((held_id, len(held_text), sha, encode(held_vector), encode(after), likeness(held_vector, after), likeness(held_vector, own)))
                held = None if is_ahead else (p, doc_id, text, own)
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _EDITED.split(", ")])

    return dealt.mapInArrow(compare, _EDITED)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
