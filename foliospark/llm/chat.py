"""Chat formatting: a visitor flattens typed content parts, and a template marks turns.

A message has a role and parts; a part is text, an image, audio or a document. The visitor takes the parts in order: text is
escaped, any other part becomes a placeholder that carries its number in the conversation's message, and is recorded as an
attachment with its reference and the tokens that it expands to (image: tiles; audio: seconds; document: pages).

A turn is ``### <role>: <content></turn>`` and a line feed. In roles and texts a backslash, and the first character of each
control string, gets a backslash before it, so control strings occur only where the template put them and the original comes back
whole. Turns are formatted one by one and a conversation is its turns' concatenation: no conversation has to fit into one row or
one task's memory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import shuffle_partitions, written

BEGIN, COLON, END, OPEN, CLOSE = "### ", ": ", "</turn>", "<|", "|>"
LEARNED = "assistant"
#: Tokens of a placeholder: for each tile of an image of 512 x 512 pixels, second of audio, page of a document.
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 512, 256, 25, 600

_CONTROL = re.compile(r"\\|### |</turn>|<\||: ")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"(\\.)|<\|(?:image|audio|document):\d+\|>", re.S)
_SCAN = re.compile(r"\\.|</turn>\n|<\|(image|audio|document):(\d+)\|>|: |### ", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Text:
    text: str


@dataclass
class Image:
    ref: str
    width: int = TILE
    height: int = TILE


@dataclass
class Audio:
    ref: str
    seconds: float = 1.0


@dataclass
class Document:
    ref: str
    pages: int = 1


@dataclass
class Flat:
    """What a visit gives: content, attachments (number, kind, reference, expanded tokens)."""

    content: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)


class Flattener:
    """Visits parts in order. A kind of part has a method of its name; an unknown kind is an error."""

    def visit(self, part: object, into: Flat) -> None:
        method = getattr(self, f"visit_{type(part).__name__.lower()}", None)
        if method is None:
            raise TypeError(f"no content part: {part!r}")
        method(part, into)

    def visit_text(self, part: Text, into: Flat) -> None:
        into.content.append(escape(part.text))

    def visit_image(self, part: Image, into: Flat) -> None:
        self._attach("image", part.ref, -(-part.width // TILE) * -(-part.height // TILE) * TOKENS_PER_TILE, into)

    def visit_audio(self, part: Audio, into: Flat) -> None:
        self._attach("audio", part.ref, int(-(-part.seconds * TOKENS_PER_SECOND // 1)), into)

    def visit_document(self, part: Document, into: Flat) -> None:
        self._attach("document", part.ref, part.pages * TOKENS_PER_PAGE, into)

    def _attach(self, kind: str, ref: str, tokens: int, into: Flat) -> None:
        number = len(into.attachments)
        into.attachments.append((number, kind, ref, tokens))
        into.content.append(f"{OPEN}{kind}:{number}{CLOSE}")


def part_of(row: dict) -> object:
    """A part from a row of the column ``parts``: type, text, ref, width, height, seconds, pages."""
    kind = row.get("type")
    given = {k: row[k] for k in ("width", "height", "seconds", "pages") if row.get(k) is not None}
    if kind == "text":
        return Text(row.get("text") or "")
    makers = {"image": (Image, ("width", "height")), "audio": (Audio, ("seconds",)), "document": (Document, ("pages",))}
    if kind not in makers:
        raise TypeError(f"no content part: {kind!r}")
    make, takes = makers[kind]
    return make(row.get("ref") or "", **{k: v for k, v in given.items() if k in takes})


def format_turn(role: str | None, parts: list[object]) -> tuple[str, int, int, list]:
    """The formatted turn, where its content begins and ends there, and its attachments."""
    flat = Flat()
    for part in parts:
        Flattener().visit(part, flat)
    head = f"{BEGIN}{escape(role or '')}{COLON}"
    content = "".join(flat.content)
    return f"{head}{content}{END}\n", len(head), len(head) + len(content), flat.attachments


def parse(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """The turns of a formatted conversation: role, and segments (``text`` with its text unescaped, or a kind of attachment
    with its number). Raises ValueError on what the template can't have written."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn at {at}")
        role, begin, segments = None, at + len(BEGIN), []
        for m in _SCAN.finditer(formatted, begin):
            if m[0][0] == "\\":
                continue
            if role is None:
                if m[0] != COLON:
                    raise ValueError(f"a role without an end at {at}")
                role, begin = unescape(formatted[begin : m.start()]), m.end()
                continue
            if m[0] == COLON or m[0] == BEGIN:
                raise ValueError(f"a control string inside a text at {m.start()}")
            if m.start() > begin:
                segments.append(("text", unescape(formatted[begin : m.start()])))
            begin = m.end()
            if m[1]:
                segments.append((m[1], m[2]))
                continue
            at = m.end()
            yield role, segments
            break
        else:
            raise ValueError(f"a turn without an end at {at}")


TURN = "conv_id long, turn long, role string, formatted string, content_begin int, content_end int, in_loss boolean, expanded_tokens long, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>"


def format_turns(messages: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", parts_column: str | None = None) -> DataFrame:
    """One row for each message: its formatted turn, the place of its content there (code points), whether the loss covers that
    content (assistant turns), its attachments and the tokens they expand to. Null text or parts: no content; null
    role: an empty one. With ``parts_column`` (array of structs, see part_of) parts count and text doesn't. A map over rows:
    nothing is shuffled, and other columns are not read."""
    parts = F.col(parts_column) if parts_column else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    rows = messages.select(F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), F.col(role_column).alias("role"), parts.alias("parts"))
    attachment = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "formatted", "content_begin", "content_end", "in_loss", "expanded_tokens", "attachments"]
        for batch in batches:
            roles = batch.column(2).to_pylist()
            done = [format_turn(role, [part_of(p) for p in own or [] if p]) for role, own in zip(roles, batch.column(3).to_pylist())]
            text, begin, end, attached = zip(*done) if done else ((), (), (), ())
            rows = [[dict(zip(("number", "kind", "ref", "tokens"), x)) for x in own] for own in attached]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(text, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array([r == LEARNED for r in roles], pa.bool_()), pa.array([sum(x[3] for x in own) for own in attached], pa.int64()), pa.array(rows, pa.list_(attachment))], names=names)

    return rows.mapInArrow(form, TURN)


def write_turns(turns: DataFrame) -> DataFrame:
    """``turns`` of ``format_turns`` as a table in the shared folder, read back from there."""
    return written(turns, "turns")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Reads formatted turns: for each conversation n_turns, turns_sha256 (of role, line feed, text, line feed for each turn, all
    unescaped), loss_chars and loss_sha256 (code points and digest of the text under the loss), formatted_chars, expanded_tokens and
    n_attachments, both of which count placeholders as they were parsed.

    Turns come in order of turn (nulls first), equal ones in order of their formatted text. A conversation streams through one task
    in sorted order and only digests are held, so a very long one needs no memory, though its digest is sequential."""
    dealt = turns.select("conv_id", "turn", "formatted", "content_begin", "content_end", "in_loss", "expanded_tokens")
    dealt = dealt.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens", "n_attachments"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None

        def row() -> tuple:
            conv, n, whole, chars, loss, size, tokens, attached = own
            return conv, n, whole.hexdigest(), chars, loss.hexdigest(), size, tokens, attached

        for batch in batches:
            out = []
            for conv, _, formatted, begin, end, in_loss, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own[0] != conv:
                    if own:
                        out.append(row())
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, segments in parse(formatted):
                    text = "".join(t for kind, t in segments if kind == "text")
                    own[1] += 1
                    own[7] += sum(kind != "text" for kind, _ in segments)
                    own[2].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    under = unescape(_PLACEHOLDER.sub(lambda m: m[1] or "", formatted[begin:end]))
                    own[3] += len(under)
                    own[4].update(under.encode())
                own[5] += len(formatted)
                own[6] += tokens
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds)], names=names)

    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long, n_attachments long")
