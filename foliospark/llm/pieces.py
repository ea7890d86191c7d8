"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words of equal length advance together. At each place all substrings that end there are hashed (differences of rolling hashes)
and probed in the sorted keys of the pieces; the best way into each place is kept as a vectorised maximum with its backpointer,
and the backpointers give the pieces.

For a unigram model the value of a way is its score, the sum of its pieces' scores, as the model defines it. For a BPE model the
segmentation that merging gives isn't the one of the largest sum; it is the only one in which every piece is what its own
characters merge to and no merge crosses the border of two neighbours. So a way into a place is admitted if its last two pieces stand
beside each other (``beside`` undoes the merges on both sides of the border, latest first), and of the admitted ways the longest last
piece is taken; there is one. Either way the ids are those of the library.

Words are those of ``tokencount``: no piece crosses their borders. A word of more than ``WINDOW`` characters advances in windows that are
joined where no merge crosses; of a BPE model a word with a run of spaces, whose pieces tie, and one whose windows don't join are merged
by a heap, best pair first. So no word's cost grows with the square of its length. Characters without a piece become bytes, if the model has them, else the unknown piece."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, vocabulary
from foliospark.llm.tokencount import SPACE, _PRE_TOKEN

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words of one length that advance together, entries of each generation of a worker's cache, and the longest word that it takes.
WORDS_AT_ONCE, CACHE_WORDS, CACHE_CHARS = 1 << 14, 700_000, 64
#: Characters of a window of a long word, of what two windows share, and windows that advance together.
WINDOW, OVERLAP, WINDOWS_AT_ONCE = 256, 96, 1 << 10
_FILTER_SHIFT = np.uint64(42)
#: Places of the table of pairs of pieces that were looked at: 2 to this power.
VERDICT_BITS = 20
_RUN = re.compile(f"{SPACE}{SPACE}")


def _hash(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of rows of code points: column i is that of the first i characters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


class Pieces:
    """A model's pieces, and the Viterbi over them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.kind = spec.trainer_spec.model_type
        norm = spec.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models without normalization rules, which keep spaces")
        if any(p.type == USER for p in spec.pieces):
            raise ValueError("a model with user-defined symbols")
        self.prefix = norm.add_dummy_prefix
        self.names = [p.piece for p in spec.pieces]
        self.types = np.array([p.type for p in spec.pieces])
        self.scores = np.array([p.score for p in spec.pieces], np.float32)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.unk_surface = spec.trainer_spec.unk_surface
        named = {n: i for i, n in enumerate(self.names)}
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)] if (self.types == BYTE).any() else []
        used = np.flatnonzero(self.types == NORMAL)
        if any(re.search(f"[^{SPACE}]{SPACE}", self.names[i]) or ("\n" in self.names[i] and len(self.names[i]) > 1) for i in used):
            raise ValueError("a model with pieces that cross words")
        self.longest = max(len(self.names[i]) for i in used)
        self.powers = np.array([pow(int(_BASE), n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        self.lengths = np.array([len(n) for n in self.names])
        self.hashes = np.zeros(len(self.names), np.uint64)
        for n in np.unique(self.lengths[used]):
            own = used[self.lengths[used] == n]
            self.hashes[own] = _hash(self._codes([self.names[i] for i in own], n))[:, n]
        order = used[np.argsort(self.hashes[used])]
        self.keys, self.ids = self.hashes[order], order.astype(np.int32)
        self.filter = np.zeros(1 << 22, bool)  # whether any key has these leading bits: most substrings are no pieces
        self.filter[self.keys >> _FILTER_SHIFT] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces with one hash")
        self.unk_score = np.float32(self.scores[used].min() - 10)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.kind == BPE:
            self.named = {self.names[i]: int(i) for i in used}
            self.score_of = {self.names[i]: float(self.scores[i]) for i in used}
            self._undo()
            self.verdicts = np.full(1 << VERDICT_BITS, -1, np.int64)

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)

    def probe(self, hashes: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(self.filter[hashes >> _FILTER_SHIFT])
        own = hashes[maybe]
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        found = self.ids[at]
        same = (self.keys[at] == own) & (self.lengths[found] == np.broadcast_to(lengths, hashes.shape)[maybe])
        out[maybe] = np.where(same, found, -1)
        return out

    # BPE

    def merge(self, word: str) -> list[tuple[str, tuple | None]]:
        """The symbols that merging leaves, each with the two that it was merged from: best score first, leftmost of equals. Pairs
        wait in a heap, so the cost grows with the length times its logarithm."""
        own: list[tuple[str, tuple | None] | None] = [(c, None) for c in word]
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        waiting: list[tuple[float, int, str]] = []
        scores = self.score_of

        def meet(i: int) -> None:
            if 0 <= i and after[i] < len(own):
                both = own[i][0] + own[after[i]][0]
                if both in scores:
                    heapq.heappush(waiting, (-scores[both], i, both))

        for i in range(len(own) - 1):
            meet(i)
        while waiting:
            _, i, both = heapq.heappop(waiting)
            if own[i] is None or after[i] >= len(own):
                continue
            j = after[i]
            if len(own[i][0]) + len(own[j][0]) != len(both):  # one of the two has been merged since
                continue
            own[i], own[j] = (both, (own[i][0], own[j][0])), None
            after[i] = after[j]
            if after[j] < len(own):
                before[after[j]] = i
            meet(before[i])
            meet(i)
        return [x for x in own if x is not None]

    def _undo(self) -> None:
        """For each piece: the rank of its merge (-1: a character), the pieces it was merged from, and whether its characters
        merge to it at all."""
        n = len(self.names)
        self.rank, self.left, self.right = np.full(n, -1.0), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.reached = np.zeros(n, bool)
        for name, i in self.named.items():
            if len(name) == 1:
                self.reached[i] = True
                continue
            if any(c not in self.named for c in name):
                raise ValueError(f"the piece {name!r} has a character that is no piece")
            parts = self.merge(name)
            if len(parts) == 1:
                self.reached[i] = True
                self.left[i], self.right[i] = (self.named[p] for p in parts[0][1])
                self.rank[i] = -float(self.scores[i])

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces leaves the two."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), np.inf)
        a, b, strict = a.copy(), b.copy(), np.ones(len(a), bool)
        while len(live):
            size = self.lengths[a] + self.lengths[b]
            fits = size <= self.longest
            both = self.probe(self.hashes[a] * self.powers[np.minimum(self.lengths[b], self.longest)] + self.hashes[b], size)
            both[~fits] = -1
            rank = np.where(both >= 0, -self.scores[both].astype(np.float64), np.inf)
            crosses = (both >= 0) & np.where(strict, rank < limit, rank <= limit)
            out[live[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crosses & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            of_a = ra > rb  # undone first: the later merge; of equal ones the right one came later
            limit, strict = np.where(of_a, ra, rb), of_a
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return out

    def known_beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``beside``, by a table of verdicts: a pair's place is a hash of it, and a pair takes the place of an earlier one."""
        key = a.astype(np.int64) << 32 | b
        place = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - VERDICT_BITS)
        held = self.verdicts[place]
        out, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != key)
        if len(new):
            distinct, at = np.unique(key[new], return_inverse=True)
            out[new] = self.beside((distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32))[at]
            self.verdicts[place[new]] = key[new] << 1 | out[new]
        return out

    # Viterbi

    def _viterbi(self, words: list[str], n: int) -> list[list[int]]:
        """Pieces of words of ``n`` characters; -1 stands for a character without a piece."""
        hashes, w = _hash(self._codes(words, n)), len(words)
        back, piece = np.zeros((w, n + 1), np.int32), np.full((w, n + 1), -1, np.int32)
        value = np.zeros((w, n + 1), np.float32)
        for j in range(1, n + 1):
            lengths = np.arange(min(j, self.longest), 0, -1)
            subs = hashes[:, j, None] - hashes[:, j - lengths] * self.powers[lengths]
            found = self.probe(subs, lengths)
            if self.kind == UNIGRAM:
                ways = np.where(found >= 0, value[:, j - lengths] + self.scores[found], -np.inf).astype(np.float32)
                lone = found[:, -1] < 0
                ways[lone, -1] = value[lone, j - 1] + self.unk_score
                best = ways.argmax(axis=1)
                rows = np.arange(w)
                value[:, j], back[:, j], piece[:, j] = ways[rows, best], lengths[best], found[rows, best]
                continue
            back[:, j] = 1
            open_rows = np.ones(w, bool)
            for c, length in enumerate(lengths):
                own = np.flatnonzero(open_rows & (found[:, c] >= 0))
                own = own[self.reached[found[own, c]]]
                before = piece[own, j - length]
                pairs = (before >= 0) if j > length else np.zeros(len(own), bool)
                fine = np.ones(len(own), bool)
                if pairs.any():
                    fine[pairs] = self.known_beside(before[pairs], found[own[pairs], c])
                own = own[fine]
                back[own, j], piece[own, j] = length, found[own, c]
                open_rows[own] = False
        out: list[list[int]] = [[] for _ in range(w)]
        at = np.full(w, n)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            for i, p in zip(live.tolist(), piece[live, at[live]].tolist()):
                out[i].append(p)
            at[live] -= back[live, at[live]]
        return [o[::-1] for o in out]

    def _merged(self, word: str) -> list[int]:
        return [self.named.get(x, -1) for x, _ in self.merge(word)]

    def _windows(self, word: str) -> list[int]:
        """Pieces of a long word by windows of one length that advance together. Two neighbours are joined at a border that both have in
        their overlap, if the pieces on its sides stand beside each other: then all neighbouring pieces of the whole do, and only one
        segmentation is like that. A word with windows that don't join is merged by the heap."""
        step = WINDOW - OVERLAP
        begins = [*range(0, len(word) - WINDOW, step), len(word) - WINDOW]
        found = []
        for i in range(0, len(begins), WINDOWS_AT_ONCE):
            found += self._viterbi([word[b : b + WINDOW] for b in begins[i : i + WINDOWS_AT_ONCE]], WINDOW)
        borders = []
        for b, own in zip(begins, found):
            sizes = np.where(np.array(own) >= 0, self.lengths[own], 1)
            borders.append(b + np.concatenate(([0], np.cumsum(sizes))))
        out, at = [], 0  # ``at``: where the window's part begins
        for k, own in enumerate(found[:-1]):
            shared, left, right = np.intersect1d(borders[k], borders[k + 1], assume_unique=True, return_indices=True)
            inside = (shared > max(at, begins[k + 1])) & (shared < begins[k] + WINDOW)
            a, b = np.array(own)[left[inside] - 1], np.array(found[k + 1])[right[inside]]
            fine = (a < 0) | (b < 0)
            fine[~fine] = self.beside(a[~fine], b[~fine])
            if not fine.any():
                return self._merged(word)
            middle = np.flatnonzero(fine)[fine.sum() // 2]
            end = shared[inside][middle]
            first = int(np.searchsorted(borders[k], at))
            out += own[first : left[inside][middle]]
            at = end
        return out + found[-1][int(np.searchsorted(borders[-1], at)) :]

    def _ids(self, word: str, found: list[int]) -> bytes:
        if -1 not in found:
            return array("I", found).tobytes()
        out, at = array("I"), 0
        for k, p in enumerate(found):
            if p >= 0:
                out.append(p)
                at += len(self.names[p])
                continue
            if self.bytes:
                out.extend(self.bytes[x] for x in word[at].encode())
            elif not k or found[k - 1] >= 0:  # a run of unknown characters is one piece
                out.append(self.unknown)
            at += 1
        return out.tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        out: dict[str, bytes] = {}
        for w in words:
            if self.kind == BPE and _RUN.search(w):
                out[w] = self._ids(w, self._merged(w))
            elif self.kind == BPE and len(w) > WINDOW:
                out[w] = self._ids(w, self._windows(w))
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            most = max(1, WORDS_AT_ONCE * 16 // (n + 15))
            for i in range(0, len(own), most):
                part = own[i : i + most]
                out.update((w, self._ids(w, found)) for w, found in zip(part, self._viterbi(part, n)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        for a, b in slices(texts):
            split = [_PRE_TOKEN.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            seen: set[str] = set()
            for s in split:
                seen.update(s)
            missing = [w for w in seen if w not in self.cache]
            if len(self.cache) + len(missing) > CACHE_WORDS:  # words still in use move on to the young generation
                self.old, self.cache = self.cache, {w: self.cache[w] for w in seen if w in self.cache}
            new = self.encode_words([w for w in missing if w not in self.old])
            self.cache.update((w, self.old[w]) for w in missing if w in self.old)
            self.cache.update(new)
            out += [b"".join(map(self.cache.__getitem__, s)) for s in split]
            for w in new:
                if len(w) > CACHE_CHARS:
                    del self.cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: runs of bytes as UTF-8, the space in front taken off, control pieces left out."""
        if not hasattr(self, "surfaces"):
            by_byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
            special = {UNKNOWN: self.unk_surface.encode(), CONTROL: b""}
            self.surfaces = [by_byte.get(i) or special.get(int(t)) if i in by_byte or int(t) in special else n.replace(SPACE, " ").encode() for i, (n, t) in enumerate(zip(self.names, self.types))]
        raw = b"".join(map(self.surfaces.__getitem__, memoryview(ids).cast("I")))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode(errors="replace")


_models: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The worker's model, kept between tasks with its cache."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models[key] = Pieces(model)
    return _models[key]


def encode_documents(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array) of every whole text, as the library encodes it without added tokens. Null: an empty text, which
    has no ids. A map over rows; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(i, "<i4") for i in pieces(sent.value).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if i is None else pieces(sent.value).decode(array("I", i).tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_chars (code points of the decoded text) and
    restored: whether decoding gives the text back. A text's own U+2581 comes back as a space, which counts as restored."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, ids in zip(texts, own.encode(texts)):
                decoded = own.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), len(decoded), decoded == text.replace(SPACE, " ")))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]], names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "restored"])

    return rows.mapInArrow(both, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, restored boolean")
