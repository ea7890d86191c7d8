"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of words in each Python worker.

A tokenizer that drops white space (its words never hold any) gives the same ids for a text as for the words between the
spaces one after the other, so only words that the cache lacks go through the library. Any other tokenizer gets whole texts."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable

from foliospark.llm.common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Marks behind a word that are tokens of their own.
_MARKS = ".,;:!?|"
#: Entries of each generation of the cache, and the longest word that it takes.
CACHE_WORDS, CACHE_CHARS = 500_000, 64

#: Byte-level models name a byte by a visible character: its own if it has one, else the next after U+0100.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

_codecs: dict[str, "TextEncoder"] = {}


def drops_spaces(spec: dict) -> bool:
    """Whether words alone make the ids: the first split keeps only matches, and the pattern can't match white space."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    if not kept or spec.get("post_processor"):
        return False
    import regex

    return not any(regex.search(f"(?:{pattern})", c) for c in " \t\n\r\x0b\f")


def folds_latin(spec: dict) -> bool:
    """Whether the pattern splits a run of letters from marks behind it, and lower case is the only change to Latin letters."""
    pre, norm = spec["pre_tokenizer"], spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    kinds = [n["type"] for n in norm.get("normalizers", [norm])]
    import regex

    pattern = first["pattern"]["Regex"]
    fine = all(regex.findall(f"(?:{pattern})", f"abé{m}") == ["abé", m] for m in (*_MARKS, ".,", "||"))
    steps = pre.get("pretokenizers") or []
    bytes_only = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
    return fine and bytes_only and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}


def words_of(text: str) -> list[bytes]:
    """UTF-8 of the words between ASCII white space."""
    return text.encode().split()


class WordCache(dict):
    """Values of words (text or bytes), made by ``make`` where they lack. Two generations of at most ``most`` entries each: a word that is still
    in use moves to the young one, so frequent words stay when rare ones make it overflow."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > CACHE_CHARS:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        parsed = json.loads(spec)
        self.by_words = drops_spaces(parsed)
        self.folds = self.by_words and folds_latin(parsed)
        self.model = self.tokenizer.model
        self.cache = WordCache(self._word)

    def _ids(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, raw: bytes) -> bytes:
        """Of a Latin word with marks behind it, those of the word in lower case and of the marks."""
        word = raw.decode()
        if self.folds:
            bare = word.rstrip(_MARKS)
            if bare and bare.isalpha() and max(bare) < "\u0130":
                low = bare.lower()
                if low == word:  # nothing is left to normalize or to split
                    return array("I", [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
                marks = word[len(bare) :].encode()
                return self.cache[low.encode()] + self.cache[marks] if marks else self.cache[low.encode()]
        return self._ids(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            found = (self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False) for a, b in slices(texts))
            return [array("I", e.ids).tobytes() for own in found for e in own]
        look = self.cache.__getitem__
        return [b"".join(map(look, words_of(t))) for t in texts]


def encoder(spec: bytes) -> TextEncoder:
    """The worker's encoder for this vocabulary: kept between tasks, so the cache stays warm."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _codecs:
        _codecs[key] = TextEncoder(spec)
    return _codecs[key]
