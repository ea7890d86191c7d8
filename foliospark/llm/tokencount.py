"""Token counts of whole texts by a two-tier lookup on the map side; pre-tokens are never shuffled.

Tier one is a compact hash table of frequent pre-tokens and their lengths in tokens, broadcast to all tasks: at most ``TABLE_WORDS``
pre-tokens of at most ``TABLE_BYTES`` bytes, the most frequent of about ``SAMPLE_DOCUMENTS`` documents, counted where they are read. It is
probed for all pre-tokens of many texts at once. Tier two encodes what the table lacks through the library and keeps it in a bounded
cache of the Python worker. The table only saves time: keys are compared in full, so counts are the library's whatever it holds.

A pre-token of a SentencePiece model is a run of spaces with the characters up to the next space, or a line feed: no piece
of more than one character holds a line feed, or a space after another character, so no merge crosses these borders (checked
when the model is loaded; a model that has such pieces gets whole texts). Of a ``tokenizers`` file that drops white space it is a
word; other files get whole texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, vocabulary
from foliospark.llm.tokens import TextEncoder, WordCache

TABLE_WORDS, TABLE_BYTES, SAMPLE_DOCUMENTS = 32_768, 32, 2_000
#: The driver gets at most so many pre-tokens for each document of the sample, whatever the number of tasks and the length of texts.
WORDS_A_DOCUMENT = 64
#: Texts are split in blocks of so many bytes, so that the arrays of a very long one stay small.
BLOCK_BYTES = 1 << 20
SPACE = "▁"
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")
_MIX = np.uint64(0x9E3779B97F4A7C15)

_counters: dict[str, "Counting"] = {}


class LengthTable:
    """Open addressing over the keys' bytes, held as four words each: half of the slots or fewer are taken."""

    def __init__(self, lengths: dict[bytes, int]):
        self.bits = max(4, (2 * len(lengths)).bit_length())
        self.words = np.zeros((1 << self.bits, TABLE_BYTES // 8), "u8")
        self.sizes, self.lengths = np.zeros(1 << self.bits, "u1"), np.full(1 << self.bits, -1, "i2")
        for key, n in lengths.items():
            words = np.frombuffer(key.ljust(TABLE_BYTES, b"\0"), "<u8")
            at = int(self.slots(words[None])[0])
            while self.lengths[at] >= 0:
                at = (at + 1) % len(self.lengths)
            self.words[at], self.sizes[at], self.lengths[at] = words, len(key), n

    def slots(self, words: np.ndarray) -> np.ndarray:
        h = words[:, 0] * _MIX
        for w in words.T[1:]:
            h = ((h ^ (h >> np.uint64(32))) + w) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return (h >> np.uint64(64 - self.bits)).astype("i8")

    def find(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lengths in tokens, -1 where the table lacks a key. Keys still looked for advance together by a slot."""
        at, out = self.slots(words), np.full(len(sizes), -1, "i8")
        left = np.arange(len(sizes))
        while left.size:
            held = self.lengths[at]
            same = (self.sizes[at] == sizes) & (self.words[at] == words).all(axis=1) & (held >= 0)
            out[left[same]] = held[same]
            on = (held >= 0) & ~same
            left, at, words, sizes = left[on], (at[on] + 1) % len(self.lengths), words[on], sizes[on]
        return out


def _leading_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of each span (of TABLE_BYTES at most) as words with zeros behind; ``raw`` holds the buffer's aligned words."""
    out = np.zeros((len(starts), TABLE_BYTES // 8), "u8")
    rows = np.arange(len(starts))
    for j in range(TABLE_BYTES // 8):
        if j:
            rows = rows[sizes[rows] > 8 * j]
        at, shift = (starts[rows] >> 3) + j, ((starts[rows] & 7) * 8).astype("u8")
        both = (raw[at] >> shift) | (raw[at + 1] << np.uint64(1) << (np.uint64(63) - shift))
        out[rows, j] = both & _FIRST_BYTES[np.minimum(sizes[rows] - 8 * j, 8)]
    return out


class Counting:
    """Splits texts into pre-tokens and counts tokens of pre-tokens."""

    def __init__(self, model: bytes):
        self.cache: WordCache | None = None
        self.pieces = model[:1] != b"{"
        if not self.pieces:
            self.text = TextEncoder(model)
            self.separable = self.text.by_words
            return
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        names = [p.piece for p in spec.pieces]
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in names)
        norm = spec.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        own = any(p.type == 4 for p in spec.pieces)  # user-defined symbols are cut out of the text first
        self.separable = plain and not crosses and not own and spec.trainer_spec.model_type in (1, 2)
        norm.add_dummy_prefix = False
        self.inside = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def plain(self, text: str) -> bytes:
        """What is split: white space of a SentencePiece text as spaces, with the one that the model puts in front."""
        if not self.pieces:
            return text.encode()
        return (" " + text.replace(SPACE, " ")).encode() if text else b""

    def length(self, pre_token: bytes) -> int:
        if self.pieces:
            return len(self.inside.encode(pre_token.decode().replace(" ", SPACE), num_threads=1))
        return len(self.text.cache[pre_token]) // 4

    def spans(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """A buffer, starts and ends of pre-tokens in it, and the text that each is of, block by block."""
        sizes = np.array([len(t) for t in texts], "i8")
        begins = np.cumsum(sizes) - sizes + 1
        raw = b"\n" + b"".join(texts)
        end = len(raw)
        raw += bytes(TABLE_BYTES + 16 - end % 8)
        held, last = np.frombuffer(raw, "u1"), None
        for a in range(1, end, BLOCK_BYTES):
            b = min(end, a + BLOCK_BYTES)
            own, before = held[a:b], held[a - 1 : b - 1]
            if self.pieces:
                edge = (own == 10) | (before == 10) | ((own == 32) & (before != 32))
            else:
                edge = _BLANK[own] != _BLANK[before]
            edge[begins[(begins >= a) & (begins < b)] - a] = True
            edges = np.concatenate([[] if last is None else [last], np.flatnonzero(edge) + a, [end] if b == end else []]).astype("i8")
            last = edges[-1]
            starts, ends = edges[:-1], edges[1:]
            if not self.pieces:
                words = ~_BLANK[held[starts]]
                starts, ends = starts[words], ends[words]
            yield raw, starts, ends, np.searchsorted(begins, starts, "right") - 1

    def split(self, text: str) -> Iterator[bytes]:
        for raw, starts, ends, _ in self.spans([self.plain(text)]):
            yield from (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))

    def count(self, texts: list[str], frequent: LengthTable) -> list[int]:
        if not self.separable:
            if not self.pieces:
                return [len(ids) // 4 for ids in self.text.encode(texts)]
            return [len(x) for a, b in slices(texts) for x in self.whole.encode(texts[a:b], num_threads=1)]
        if self.cache is None:
            self.cache = WordCache(self.length)
        return [n for a, b in slices(texts, BLOCK_BYTES) for n in self._count([self.plain(t) for t in texts[a:b]], frequent)]

    def _count(self, texts: list[bytes], frequent: LengthTable) -> list[int]:
        totals = np.zeros(len(texts), "i8")
        for raw, starts, ends, of in self.spans(texts):
            sizes = ends - starts
            found = np.full(len(starts), -1, "i8")
            short = np.flatnonzero(sizes <= TABLE_BYTES)
            found[short] = frequent.find(_leading_words(np.frombuffer(raw, "<u8"), starts[short], sizes[short]), sizes[short])
            missed = np.flatnonzero(found < 0)
            look = self.cache.__getitem__
            found[missed] = [look(raw[a:b]) for a, b in zip(starts[missed].tolist(), ends[missed].tolist())]
            np.add.at(totals, of, found)
        return totals.tolist()


#: The same borders over characters, for one text.
_PRE_TOKEN = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def counting(model: bytes) -> Counting:
    key = hashlib.sha256(model).hexdigest()
    if key not in _counters:
        _counters[key] = Counting(model)
    return _counters[key]


def frequent_lengths(texts: DataFrame, model: bytes, *, words: int = TABLE_WORDS, sample: int = SAMPLE_DOCUMENTS) -> dict[bytes, int]:
    """The most frequent pre-tokens of about ``sample`` documents, drawn row by row, with their lengths: at most ``words`` entries of at
    most TABLE_BYTES bytes, which is the bound of what is broadcast. Tasks count what they read and send the driver WORDS_A_DOCUMENT
    pre-tokens at most for each document that they drew; nothing is shuffled."""
    known = counting(model)
    if not known.separable:
        return {}
    sent = texts.sparkSession.sparkContext.broadcast(model)
    share = min(1.0, sample / max(texts.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, documents = counting(sent.value), Counter(), 0
        for batch in batches:
            documents += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(w for w in own.split(text) if len(w) <= TABLE_BYTES)
                if len(seen) > 16 * words:
                    seen = Counter(dict(seen.most_common(8 * words)))
        found = seen.most_common(min(2 * words, WORDS_A_DOCUMENT * documents))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["w", "n"])

    sums = Counter()
    found = texts.sample(share, 1).mapInArrow(count, "w binary, n long").toArrow()
    for w, n in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        sums[w] += n
    return {w: known.length(w) for w, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:words]}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (of the whole text, as the library encodes it without added tokens), over_limit. A
    null text counts as an empty one, which has no tokens. One row for each row, repeated ones too; a null id stays null. An
    empty table gives no rows; other columns are not read."""
    model = vocabulary(model_path)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast((model, LengthTable(frequent_lengths(rows.select("text"), model))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = counting(table.value[0]), table.value[1]
        for batch in batches:
            tokens = own.count(batch.column(2).to_pylist(), frequent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
