"""License scans: short notices are found in whole texts, exactly and with a few errors.

A text is reduced to its words (letters and digits, A-Z in lower case) with one space between them. A notice that may differ by k edits is
split into k + 1 pieces (pigeonhole): wherever it occurs with k edits or fewer, at least one piece stands there unchanged. An automaton over
the pieces of all notices finds those places in one pass; around each, the regex library's matching with a bounded number of errors decides
whether the notice is there, and gives the span and its edits. Spans of different notices that overlap are settled in favour of the one with the
smaller share of edits, then the longer one, so that a version or a variant of a license isn't taken for another.

Phrases of another list count wherever their words stand one after another without any edit. They are patterns of the same automaton."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that count exactly, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices that are searched with errors, and their labels.
NOTICES = [
    ("under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("apache license version 2", "apache-2"),
    ("under the apache license", "apache"),
    ("under the apache license version 2", "apache-2"),
    ("cc by", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("under the bsd license", "bsd"),
    ("under the isc license", "isc"),
    ("under the gpl license", "gpl"),
    ("under the mpl license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]
#: A notice has an edit for so many of its characters, none if it is shorter, and no more than so many.
CHARS_PER_EDIT, MOST_EDITS = 10, 3
#: Windows whose matches a worker remembers.
WINDOWS = 1 << 15
#: What the automaton is built from is broadcast with the code: at most so many characters of phrases and notices.
MAX_NOTICE_CHARS = 1 << 20

#: Each byte of a text as it stands in its words: letters in lower case, digits, and bytes above 127 (letters that aren't ASCII); a space otherwise.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SPAN = "struct<label:string,notice:string,first_word:long,last_word:long,begin:long,end:long,edits:int>"


def reduced(text: bytes) -> bytes:
    """The words of a text, with a space before, between and after them."""
    words = text.translate(_WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def edits_of(notice: str) -> int:
    return min(len(notice) // CHARS_PER_EDIT, MOST_EDITS)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of about even length that make up ``notice``, and where each begins."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Found:
    """What a text holds: its number of words, for each place of a phrase the word it starts with and its label, and the spans of notices
    (label, notice, first and last word, first code point and the one after the last, edits)."""

    n_words: int
    places: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[str, str, int, int, int, int, int]] = field(default_factory=list)


class Scanner:
    """Searches texts for ``phrases`` without and for ``notices`` with errors; both as they stand in reduced texts."""

    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]):
        import ahocorasick
        import regex

        given = [(reduced(text.encode()).decode("latin-1"), text, label) for text, label in notices]
        if sum(len(text) for text, _ in [*phrases, *notices]) > MAX_NOTICE_CHARS:
            raise ValueError(f"phrases and notices have more than {MAX_NOTICE_CHARS} characters")
        if any(not own.strip() for own, _, _ in given) or any(not reduced(text.encode()).strip() for text, _ in phrases):
            raise ValueError("a phrase or notice without words")
        self.notices = [(own, text, label, edits_of(text), regex.compile(f"(?e)(?:{regex.escape(own, literal_spaces=True)}){{e<={edits_of(text)}}}")) for own, text, label in given]
        at: dict[str, list[tuple[int, int, str]]] = {}
        for text, label in phrases:
            own = reduced(text.encode()).decode("latin-1")
            at.setdefault(own, []).append((-1, 0, label))
        for i, (own, _, _, edits, _) in enumerate(self.notices):
            for begin, piece in seeds(own, edits):
                at.setdefault(piece, []).append((i, begin, ""))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        # Notices are boilerplate: most windows have been seen before.
        self.verify = lru_cache(WINDOWS)(self._verify)

    def scan(self, text: bytes) -> Found:
        own = reduced(text)
        words = own.count(b" ") - 1
        found, own_text = Found(words), own.decode("latin-1")
        places: list[tuple[int, str]] = []
        candidates: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(own_text):
            for notice, begin, label in uses:
                if notice < 0:
                    places.append((end + 1 - size, label))
                    continue
                text_of, edits = self.notices[notice][0], self.notices[notice][3]
                start = end + 1 - size - begin
                low, high = max(0, start - edits), start + len(text_of) + edits
                candidates.setdefault(notice, set()).add((low, high))
        if not places and not candidates:
            return found
        spaces = np.flatnonzero(np.frombuffer(own, np.uint8) == 32)
        found.places = [(int(np.searchsorted(spaces, at)), label) for at, label in places]
        verified = [
            (edits / len(self.notices[notice][0]), low + begin, low + end, notice, edits)
            for notice, windows in candidates.items() for low, high in windows for begin, end, edits in self.verify(notice, own_text[low:high])
        ]
        chosen = _settled(verified)
        if chosen:
            found.spans = self._spans(text, own_text, chosen, spaces)
        return found

    def _verify(self, notice: int, window: str) -> list[tuple[int, int, int]]:
        """The places in ``window`` where the notice stands: begin, end, edits."""
        out, at = [], 0
        while m := self.notices[notice][4].search(window, at):
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            # The space after a notice may be the one before the next.
            at = max(m.end() - 1, m.start() + 1)
        return out

    def _spans(self, text: bytes, own: str, chosen: list[tuple[float, int, int, int, int]], spaces: np.ndarray) -> list[tuple[str, str, int, int, int, int, int]]:
        first, last = [], []
        for _, begin, end, _, _ in chosen:
            inside = own[begin:end]
            first.append(int(np.searchsorted(spaces, begin + len(inside) - len(inside.lstrip(" ")))) - 1)
            last.append(int(np.searchsorted(spaces, begin + len(inside.rstrip(" ")) - 1)) - 1)
        raw = np.frombuffer(text, np.uint8)
        is_word = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
        begins = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))[first]
        ends = np.flatnonzero(is_word & ~np.concatenate((is_word[1:], [False])))[last] + 1
        # Code points before a byte: the bytes before it that don't continue one.
        every = np.unique(np.concatenate((begins, ends)))
        points = np.cumsum(np.add.reduceat((raw[: every[-1]] & 0xC0) != 0x80, np.concatenate(([0], every[:-1])), dtype=np.int64) * (np.diff(every, prepend=0) > 0))
        b, e = points[np.searchsorted(every, begins)], points[np.searchsorted(every, ends)]
        return [(self.notices[n][2], self.notices[n][1], first[i], last[i], int(b[i]), int(e[i]), edits) for i, (_, _, _, n, edits) in enumerate(chosen)]


def _settled(verified: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Of overlapping spans those that come first by share of edits, length (longest first), place and notice; in order of place."""
    begins: list[int] = []
    kept: list[tuple[float, int, int, int, int]] = []
    for v in sorted(set(verified), key=lambda v: (v[0], v[1] - v[2], v[1], v[3])):
        # Neighbouring notices share the space between them.
        begin, end = v[1] + 1, v[2] - 1
        i = bisect_left(begins, begin)
        if (i < len(begins) and begins[i] < end) or (i and kept[i - 1][2] - 1 > begin):
            continue
        begins.insert(i, begin)
        kept.insert(i, v)
    return kept


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, ``places`` (the word that a phrase starts with, its label; in order of place) and ``spans``
    of notices (see SPAN; words and code points count from 0, ``end`` is the code point after the last).

    A null text is an empty one: no words, nothing found. Equal rows give equal rows, an empty table none; other columns aren't read. A map
    over rows, each whole text in one piece, nothing shuffled."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    span_names = [span.value_type.field(i).name for i in range(span.value_type.num_fields)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column(1)]
            places = [[{"word": w, "label": label} for w, label in f.places] for f in found]
            spans = [[dict(zip(span_names, s)) for s in f.spans] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.n_words for f in found], pa.int64()), pa.array(places, place), pa.array(spans, span)], names=["doc_id", "n_words", "places", "spans"])

    return rows.mapInArrow(search, f"doc_id {id_type}, n_words long, places array<struct<word:long,label:string>>, spans array<{SPAN}>")


def license_digest(found: DataFrame) -> DataFrame:
    """``found`` of scan_licenses as labels and counts: ``score`` is 1 for a phrase, else the largest share of a notice that has no edit, 0 if
    nothing was found."""
    base = F.array_distinct(F.col("places.label"))
    shares = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"), "spans",
    )
