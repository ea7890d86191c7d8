"""PDFs as rows: ``spark.read.format("foliospark_pdf").load(folder)``, registered by ``sink.register``.

A partition is a file; a row is one thing that a page has: itself (``page``: its size in points, the file's title and author, the number of its
pages), a link annotation (``link``: kind, uri, bbox), an image's name (``image``: name, pixels, bytes, and in ``rects`` each place where the page draws
it, in order). Boxes are in points from the top left. ``pages``, ``links`` and ``images`` give the relations that ingest takes. A file that can't
be read is one row of kind ``broken`` with a message.

Read are cross-reference tables and streams, object streams, attributes that pages inherit from the page tree, and the drawing of images; streams
that are compressed in another way than by Flate are left as they are, and encrypted files are broken."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMA = f"path string, kind string, page int, ord int, n_pages int, width double, height double, title string, author string, link string, uri string, name string, width_px int, height_px int, n_bytes long, bbox {BOX}, rects array<{BOX}>, error string"
_FIELDS = [f.split()[0] for f in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", SCHEMA)).split(", ")]
#: Levels of page tree and of references that are followed; pages may have a parent that names them again.
DEEPEST = 64


class Name(str):
    """A name such as /Type, without the slash."""


class Ref(int):
    """A reference to the object of that number."""


class Stream(dict):
    data: bytes = b""


_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[^\s()<>\[\]{}/%]+|[{}])")
_REFERENCE = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after the bracket before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            following = data[at + 1 : at + 2]
            out += _ESCAPES.get(following, b"" if following in b"\r\n" else following)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    raise ValueError("a string without an end")


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value that begins at ``at``, and where it ends. Operators come as bytes, the ends of arrays and dictionaries too."""
    m = _TOKEN.match(data, at)
    if not m or depth > DEEPEST:
        raise ValueError(f"no value at {at}")
    token, at = m[1], m.end()
    if token == b"(":
        return _literal(data, at)
    if token == b"<<" or token == b"[":
        items = []
        while True:
            item, at = value(data, at, depth + 1)
            if isinstance(item, _End):
                break
            items.append(item)
        return (items if token == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}), at
    if token in (b">>", b"]"):
        return _End(token), at
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1")), at
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if re.fullmatch(rb"\d+", token) and (r := _REFERENCE.match(data, at)):
        return Ref(token), r.end()
    if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", token):
        return (float(token) if b"." in token else int(token)), at
    return {b"true": True, b"false": False, b"null": None}.get(token, _Operator(token)), at


class _End(bytes):
    pass


class _Operator(bytes):
    pass


def _unpredicted(data: bytes, parameters: dict) -> bytes:
    """Rows of a stream whose bytes are differences from those to the left or above."""
    if parameters.get("Predictor", 1) < 10:
        return data
    size = max(1, parameters.get("Colors", 1) * parameters.get("BitsPerComponent", 8) // 8)
    row = (parameters.get("Columns", 1) * parameters.get("Colors", 1) * parameters.get("BitsPerComponent", 8) + 7) // 8
    out, before = bytearray(), bytes(row)
    for at in range(0, len(data), row + 1):
        kind, own = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(own)):
            left, up, corner = own[i - size] if i >= size else 0, before[i], before[i - size] if i >= size else 0
            if kind == 4:
                near = sorted((abs(left + up - corner - c), k) for k, c in enumerate((left, up, corner)))[0][1]
            own[i] = (own[i] + (0, left, up, (left + up) // 2, (left, up, corner)[near] if kind == 4 else 0)[kind]) & 255
        out += own
        before = bytes(own.ljust(row, b"\0"))
    return bytes(out)


class File:
    """A PDF's objects by number, read when they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.places, self.known = data, {}, {}
        self.trailer: dict = {}
        starts = re.findall(rb"startxref\s+(\d+)", data)
        at, seen = int(starts[-1]) if starts else None, set()
        while at is not None and at not in seen:
            seen.add(at)
            at = self._section(at)
        if "Root" not in self.trailer:
            raise ValueError("no catalog")
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def _section(self, at: int) -> int | None:
        """Takes the places of a cross-reference section; earlier ones taken stay. Where the one before it begins."""
        table = re.compile(rb"\s*xref\b").match(self.data, at)
        if not table:
            own = self._object_at(at)
            if not isinstance(own, Stream):
                raise ValueError("no cross-reference section")
            self._take_stream(own)
            return own.get("Prev")
        at = table.end()
        while head := re.compile(rb"\s*(\d+)\s+(\d+)\s").match(self.data, at):
            at = head.end()
            for i in range(int(head[2])):
                entry = re.compile(rb"\s*(\d{10})\s+(\d{5})\s+([nf])").match(self.data, at)
                if not entry:
                    raise ValueError("a damaged cross-reference table")
                at = entry.end()
                if entry[3] == b"n":
                    self.places.setdefault(int(head[1]) + i, (1, int(entry[1])))
        trailer, _ = value(self.data, re.compile(rb"\s*trailer").match(self.data, at).end())
        self.trailer = {**trailer, **self.trailer}
        if "XRefStm" in trailer:
            self._take_stream(self._object_at(trailer["XRefStm"]))
        return trailer.get("Prev")

    def _take_stream(self, own: Stream) -> None:
        self.trailer = {**own, **self.trailer}
        data, (a, b, c) = self.decoded(own), own["W"]
        ranges, at = own.get("Index") or [0, own["Size"]], 0
        for first, n in zip(ranges[::2], ranges[1::2]):
            for number in range(first, first + n):
                row = data[at : at + a + b + c]
                at += a + b + c
                kind = int.from_bytes(row[:a]) if a else 1
                if kind in (1, 2):
                    self.places.setdefault(number, (kind, int.from_bytes(row[a : a + b]), int.from_bytes(row[a + b :])))

    def _object_at(self, at: int) -> object:
        head = re.compile(rb"\s*\d+\s+\d+\s+obj\b").match(self.data, at)
        if not head:
            raise ValueError(f"no object at {at}")
        own, at = value(self.data, head.end())
        begin = re.compile(rb"\s*stream(\r\n|\n)").match(self.data, at)
        if not begin or not isinstance(own, dict):
            return own
        out, size = Stream(own), self.get(own.get("Length"))
        out.data = self.data[begin.end() : begin.end() + size] if isinstance(size, int) else self.data[begin.end() : self.data.index(b"endstream", begin.end())]
        return out

    def get(self, given: object) -> object:
        """``given``, or what it refers to; null for an object that isn't there."""
        for _ in range(DEEPEST):
            if not isinstance(given, Ref):
                return given
            number = int(given)
            if number not in self.known:
                self.known[number] = None  # an object that leads to itself is none
                place = self.places.get(number)
                self.known[number] = None if place is None else self._object_at(place[1]) if place[0] == 1 else self._packed(place[1], number)
            given = self.known[number]
        return None

    def _packed(self, holder: int, number: int) -> object:
        own = self.get(Ref(holder))
        data = self.decoded(own)
        numbers = [int(x) for x in data[: own["First"]].split()]
        places = dict(zip(numbers[::2], numbers[1::2]))
        return value(data, own["First"] + places[number])[0] if number in places else None

    def decoded(self, own: Stream) -> bytes:
        data = own.data
        filters, parameters = ([x] if not isinstance(x, list) else x for x in (self.get(own.get("Filter")) or [], self.get(own.get("DecodeParms")) or []))
        for i, name in enumerate(filters):
            if self.get(name) not in ("FlateDecode", "Fl"):
                return data
            d = zlib.decompressobj()
            data = _unpredicted(d.decompress(data), self.get(parameters[i]) or {} if i < len(parameters) else {})
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with what it inherits."""
        seen: set[int] = set()
        root = self.get(self.trailer["Root"])
        waiting = [(root.get("Pages"), {}, 0)]
        while waiting:
            ref, inherited, depth = waiting.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > DEEPEST or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            own = {**inherited, **{k: node[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in node}}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(k, own, depth + 1) for k in reversed(kids)]
            else:
                yield {**node, **own}

    def text(self, given: object) -> str | None:
        own = self.get(given)
        if not isinstance(own, bytes):
            return None
        return own[2:].decode("utf-16-be", "replace") if own[:2] == b"\xfe\xff" else own.decode("latin-1")


def _numbers(file: File, given: object, n: int) -> list[float] | None:
    own = file.get(given)
    own = [file.get(x) for x in own] if isinstance(own, list) else []
    return [float(x) for x in own] if len(own) == n and all(isinstance(x, (int, float)) for x in own) else None


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def _drawn(content: bytes) -> Iterator[tuple[str, list[float]]]:
    """The names that a page's content draws, and the matrix that each is drawn by."""
    at, operands, matrix, saved = 0, [], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], []
    while at < len(content):
        try:
            token, at = value(content, at)
        except ValueError:
            return
        if not isinstance(token, _Operator):
            operands.append(token)
            continue
        if token == b"q":
            saved.append(matrix)
        elif token == b"Q" and saved:
            matrix = saved.pop()
        elif token == b"cm" and len(operands) >= 6 and all(isinstance(x, (int, float)) for x in operands[-6:]):
            matrix = _times([float(x) for x in operands[-6:]], matrix)
        elif token == b"Do" and operands and isinstance(operands[-1], Name):
            yield str(operands[-1]), matrix
        elif token == b"ID":  # an inline image: bytes up to its end
            end = re.compile(rb"\sEI\b").search(content, at)
            at = end.end() if end else len(content)
        operands = []


def rows_of(path: str, data: bytes) -> Iterator[dict]:
    """The rows of one file."""
    try:
        file = File(data)
        pages = list(file.pages())
        info = file.get(file.trailer.get("Info")) or {}
        title, author = (file.text(info.get(k)) for k in ("Title", "Author")) if isinstance(info, dict) else (None, None)
        out = []
        for n, page in enumerate(pages):
            x0, y0, x1, y1 = _numbers(file, page.get("MediaBox"), 4) or (0.0, 0.0, 612.0, 792.0)
            left, right, bottom, top = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)

            def box(a: float, b: float, c: float, d: float) -> dict:
                return {"x0": min(a, c) - left, "y0": top - max(b, d), "x1": max(a, c) - left, "y1": top - min(b, d)}

            out.append({"kind": "page", "page": n, "ord": 0, "n_pages": len(pages), "width": right - left, "height": top - bottom, "title": title, "author": author})
            for i, ref in enumerate(file.get(page.get("Annots")) or []):
                own = file.get(ref)
                if isinstance(own, dict) and own.get("Subtype") == "Link":
                    action = file.get(own.get("A")) or {}
                    rect = _numbers(file, own.get("Rect"), 4)
                    out.append({"kind": "link", "page": n, "ord": i, "link": str(action.get("S") or "GoTo").lower(), "uri": file.text(action.get("URI")), "bbox": box(*rect) if rect else None})
            resources = file.get(page.get("Resources")) or {}
            images = {k: file.get(v) for k, v in (file.get(resources.get("XObject")) or {}).items()}
            images = {k: v for k, v in images.items() if isinstance(v, Stream) and v.get("Subtype") == "Image"}
            contents = file.get(page.get("Contents"))
            parts = [file.get(x) for x in (contents if isinstance(contents, list) else [contents])]
            places: dict[str, list[dict]] = {k: [] for k in images}
            for name, (a, b, c, d, e, f) in _drawn(b"\n".join(file.decoded(x) for x in parts if isinstance(x, Stream))) if images else ():
                if name in places:
                    xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
                    places[name].append(box(min(xs), min(ys), max(xs), max(ys)))
            for i, (name, own) in enumerate(sorted(images.items())):
                out.append({"kind": "image", "page": n, "ord": i, "name": str(name), "width_px": file.get(own.get("Width")), "height_px": file.get(own.get("Height")), "n_bytes": len(own.data), "rects": places[name]})
        yield from ({"path": path, **r} for r in out)
    except Exception as e:  # a file that can't be read is a row, and no page
        yield {"path": path, "kind": "broken", "error": str(e)[:500]}


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PdfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        from pyarrow.fs import FileSelector, FileType

        from foliospark.sources.sink import opened

        fs, root = opened(self.path)
        found = fs.get_file_info(root)
        every = [found] if found.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        return [OneFile(x.path) for x in sorted(every, key=lambda x: x.path) if x.type == FileType.File and x.base_name.lower().endswith(".pdf")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        from foliospark.sources.sink import opened

        fs, _ = opened(self.path)
        with fs.open_input_stream(partition.path) as f:
            data = f.read()
        for row in rows_of(partition.path, data):
            yield tuple(row.get(name) for name in _FIELDS)


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliospark_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"])


def pages(found: DataFrame) -> DataFrame:
    """path, page, n_pages, width, height, title (metadata's, else the file's stem), author (empty if missing)."""
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*\z", 0), r"(?<=.)\.[^.]*\z", "")
    own = [F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"), F.coalesce("author", F.lit("")).alias("author")]
    return found.filter("kind = 'page'").select("path", "page", "n_pages", "width", "height", *own)


def links(found: DataFrame) -> DataFrame:
    """Annotations for ``pages.hyperlinks``: path, page, ord, kind, uri, bbox."""
    return found.filter("kind = 'link'").select("path", "page", "ord", F.col("link").alias("kind"), "uri", "bbox")


def images(found: DataFrame) -> DataFrame:
    """Images for ``pages.embedded_images``: path, page, ord, name, width_px, height_px, n_bytes, rects, error."""
    return found.filter("kind = 'image'").select("path", "page", "ord", "name", "width_px", "height_px", "n_bytes", "rects", "error")
