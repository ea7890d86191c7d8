"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else becomes one space, so n-grams are those of words and their borders. N-grams of one
to three characters are hashed into ``BUCKETS`` buckets. Tasks count buckets by language for themselves and only those sums are
shuffled; the matrix of log probabilities (languages x buckets) is broadcast. Scoring counts the n-grams of many texts at once as sparse
triples (text, bucket, number); the matrix's rows are gathered once for each triple and summed by text.

The model is fitted on at most about ``TRAIN_DOCUMENTS`` labelled documents, chosen by a hash of id and text, repeated rows counting once;
everything else covers all rows and whole texts. With more languages than a whole matrix has room for (``MATRIX_BYTES``), only what the
sample has seen is held: a bucket's entries are the languages that have it, and all others share their language's value for unseen ones."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS, ORDERS, TRAIN_DOCUMENTS = 1 << 15, (1, 2, 3), 20_000
SMOOTHING = 0.5
#: Characters counted at once, and languages that are scored or counted at once.
TEXT_SLICE, LANGUAGES_AT_ONCE = 1 << 18, 64
#: The bytes that a whole matrix may have, counted at eight each; entries that are held beyond that; languages that there may be.
MATRIX_BYTES, MOST_ENTRIES, MOST_LANGUAGES = 64 << 20, 1 << 25, 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def letter_windows(text: str, most: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of the lower-cased letters, one space for whatever is between them, and at both ends; nothing if there is no letter. A
    text comes in windows of about ``most`` characters, so that memory doesn't follow its length; each begins with the last letters of
    the one before, and the number says how many."""
    most = most or TEXT_SLICE
    before, counted = np.array([32], np.uint32), 0
    for i in range(0, len(text), most):
        codes = np.frombuffer(text[i : i + most].lower().encode("utf-32-le"), "<u4")
        is_letter = _letter_table()[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of each run of others stands for the run
        keep[:1] = True
        out = np.where(is_letter, codes, np.uint32(32))[keep]
        if before[-1] == 32 and out[0] == 32:
            out = out[1:]
        if i + most >= len(text) and (out[-1] if len(out) else before[-1]) != 32:
            out = np.append(out, np.uint32(32))
        if not len(out):
            continue
        whole = np.concatenate((before, out))
        yield whole, counted
        before = whole[1 - max(ORDERS) :]
        counted = len(before)


def grams(codes: np.ndarray, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each place."""
    c, out = codes.astype(np.uint64), []
    rolled = np.zeros(len(c), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(c) < n:
            break
        rolled = rolled[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :] + np.uint64(n)
        if n in orders:
            mixed = rolled * _MULTIPLIER
            out.append(((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32))
    return out


def counted_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts of the n-grams of many texts, slice by slice: texts (ascending), buckets, numbers. A very long text comes in
    several slices."""

    def found(held: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(c) for _, c, _ in held])
        row, ends = np.repeat(np.array([i for i, _, _ in held]), sizes), np.repeat(np.cumsum(sizes), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes + np.array([n for _, _, n in held]), sizes)
        keys = []
        for n, own in zip(ORDERS, grams(np.concatenate([c for _, c, _ in held]))):
            at = np.arange(len(own))
            inside = (at + n <= ends[: len(own)]) & (at + n > begin[: len(own)])  # within a text, and not counted before
            keys.append(row[: len(own)][inside] * BUCKETS + own[inside])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // BUCKETS, key % BUCKETS, n

    held, size = [], 0
    for i, text in enumerate(texts):
        for codes, counted in letter_windows(text):
            held.append((i, codes, counted))
            size += len(codes)
            if size >= TEXT_SLICE:
                yield found(held)
                held, size = [], 0
    if held:
        yield found(held)


@dataclass
class LanguageModel:
    """Log probabilities of buckets by language: ``matrix`` (buckets x languages) whole, or, if it is None, for each language its value
    for a ``unseen`` bucket and the entries that differ from it (``more``) in order of bucket, ``begins`` giving each bucket's first."""

    languages: list[str]
    matrix: np.ndarray | None
    prior: np.ndarray
    unseen: np.ndarray | None = None
    begins: np.ndarray | None = None
    language: np.ndarray | None = None
    more: np.ndarray | None = None

    def sums(self, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        """texts x languages: the log probability of each text's n-grams."""
        size = len(self.languages)
        out = np.zeros((texts, size))
        if self.matrix is not None:
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            for a in range(0, size, LANGUAGES_AT_ONCE):  # so many columns that the gathered block stays small
                block = self.matrix[bucket, a : a + LANGUAGES_AT_ONCE] * n[:, None].astype(np.float32)
                out[row[first], a : a + LANGUAGES_AT_ONCE] += np.add.reduceat(block, first, axis=0, dtype=np.float64)
            return out
        out += np.bincount(row, n, texts)[:, None] * self.unseen
        held = self.begins[bucket + 1] - self.begins[bucket]
        ends = np.cumsum(held)
        at = 0
        while at < len(row):  # as many triples as have a few million entries between them, one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21))))
            some = slice(at, to)
            total = int(held[some].sum())
            place = np.repeat(self.begins[bucket[some]] - np.concatenate(([0], np.cumsum(held[some])[:-1])), held[some]) + np.arange(total)
            np.add.at(out, (np.repeat(row[some], held[some]), self.language[place]), np.repeat(n[some], held[some]) * self.more[place])
            at = to
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language (the first in the alphabet among equals) and its probability; UNKNOWN and 0 for a text that
        is null or has no letter. Probability is that of naive Bayes on the mean n-gram of texts longer than 256 n-grams
        times 256, so that length alone doesn't make it 1."""
        at_once = max(1, (1 << 22) // max(1, len(self.languages)))
        if len(texts) > at_once:
            parts = [self.score(texts[i : i + at_once]) for i in range(0, len(texts), at_once)]
            return [x for names, _ in parts for x in names], [x for _, scores in parts for x in scores]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for row, bucket, n in counted_grams([t or "" for t in texts]):
            low, high = row[0], row[-1] + 1
            sums[low:high] += self.sums(row - low, bucket, n, high - low)
            sizes[low:high] += np.bincount(row - low, n, high - low)
        own = np.flatnonzero(sizes)
        logs = self.prior + sums[own] * np.minimum(1.0, 256 / sizes[own])[:, None]
        logs -= logs.max(axis=1, keepdims=True)
        chance = np.exp(logs)
        chance /= chance.sum(axis=1, keepdims=True)
        for i, best, p in zip(own, chance.argmax(axis=1), chance.max(axis=1)):
            names[i], scores[i] = self.languages[best], float(p)
        return names, scores


def fit(labelled: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """A model of the languages of ``labelled``; rows with a null language are left out. ``most`` bounds the rows it is fitted
    on: of more, each stays with a probability that gives every language an even share of it, by a hash of id and text; of repeated rows
    one counts, so that an id or a text that very many rows have doesn't fill the sample. What the driver and the broadcast hold is bounded by
    ``MATRIX_BYTES``, or by ``MOST_ENTRIES`` entries; more languages than ``MOST_LANGUAGES``, or a sample with more entries, is an error that says so."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).filter("lang is not null")
    # a row for each language
    total = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(total) > MOST_LANGUAGES:
        raise ValueError(f"{lang_column} has more than {MOST_LANGUAGES} values")
    languages = sorted(total)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # the rarer a language, the more of it stays: each has an even share of the bound if it has the rows
    kept = spark.createDataFrame([(x, i, int(min(1.0, most / len(languages) / total[x]) * (1 << 30))) for i, x in enumerate(languages)], "lang string, k int, below int")
    own = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("below")
    drawn = rows.join(F.broadcast(kept), "lang").filter(own).groupBy("k", "id", F.xxhash64("text").alias("same")).agg(F.min("text").alias("text")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}

        def rows_of() -> pa.RecordBatch:
            k = np.repeat(np.array(list(own), np.int32), [np.count_nonzero(x) for x in own.values()])
            bucket = np.concatenate([np.flatnonzero(x) for x in own.values()]).astype(np.int32)
            n = np.concatenate([x[x > 0] for x in own.values()])
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(n)], names=["k", "bucket", "n"])

        for batch in batches:
            langs = batch.column(0).to_numpy()
            for row, bucket, n in counted_grams([t or "" for t in batch.column(1).to_pylist()]):
                k = langs[row]
                for x in np.unique(k).tolist():
                    if x not in own and len(own) >= LANGUAGES_AT_ONCE:
                        yield rows_of()
                    own.setdefault(x, np.zeros(BUCKETS, np.int64))
                    np.add.at(own[x], bucket[k == x], n[k == x])
        if own:
            yield rows_of()

    # at most languages x buckets rows, and MOST_ENTRIES, reach the driver
    whole = len(languages) * BUCKETS * 8 <= MATRIX_BYTES
    counted = drawn.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counted = (counted if whole else counted.limit(MOST_ENTRIES + 1)).toArrow()
    if not whole and counted.num_rows > MOST_ENTRIES:
        raise ValueError(f"{most} documents have more than {MOST_ENTRIES} entries: fit on fewer")
    bucket, k, n = (counted.column(c).to_numpy() for c in ("bucket", "k", "n"))
    sizes = np.array([total[x] for x in languages])
    prior = np.log(sizes / sizes.sum())
    below = np.log(np.bincount(k, n, len(languages)) + SMOOTHING * BUCKETS)
    if whole:
        counts = np.zeros((BUCKETS, len(languages)))
        counts[bucket, k] = n
        return LanguageModel(languages, (np.log(counts + SMOOTHING) - below).astype(np.float32), prior)
    order = np.lexsort((k, bucket))
    begins = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))))
    more = (np.log(n[order] + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32)
    return LanguageModel(languages, None, prior, np.log(SMOOTHING) - below, begins, k[order].astype(np.int32), more)


def is_held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder when divided by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, **columns: str) -> LanguageModel:
    """Learns from the documents that aren't held out."""
    return fit(docs.filter(~is_held_out(columns.get("id_column", "doc_id"))), **columns)


def identify(docs: DataFrame, model: LanguageModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row. Only the text is an input of the prediction; an empty text
    has no letter. Equal rows give equal rows, a null id stays null and isn't held out, an empty table gives no rows; other
    columns are not read. With a model that has seen no language everything is UNKNOWN."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), is_held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language of at least that probability. A null text, an empty one and
    one without a letter go; equal rows stay or go together; an empty table gives an empty one."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, schema)
