"""Files in and out: uploads by Spark's binary reader, and documents put together as PDFs by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foliospark.functions.metrics import advances
from foliospark.sources import pdf as PDF
from foliospark.sources.pdf_source import File


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, kind (pdf, jpg), size, page_count, content. A PDF's pages are counted in its page tree, which may be in compressed
    object streams; a damaged one has 0."""
    read = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"[^/]+\z", 0)
    kind = F.when(F.lower(name).endswith(".pdf"), "pdf").when(F.lower(name).rlike(r"\.jpe?g\z"), "jpg")
    return read.select("path", F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"), kind.alias("kind"), F.col("length").alias("size"), page_count("content", kind).alias("page_count"), "content")


@F.pandas_udf(IntegerType())
def _pages_of(content: pd.Series) -> pd.Series:
    def count(data: bytes | None) -> int:
        try:
            return sum(1 for _ in File(bytes(data or b"")).pages())
        except Exception:  # unreadable: no page, as for an upload
            return 0

    return content.map(count).astype("int32")


def page_count(content: str, kind: Column) -> Column:
    return F.when(kind == "jpg", 1).otherwise(_pages_of(F.when(kind == "pdf", F.col(content))))


def title(metadata_title: Column, upload_name: Column, path: Column) -> Column:
    """An empty string counts as missing."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"[^/]*\z", 0), r"(?<=.)\.[^.]*\z", "")
    return F.coalesce(F.nullif(metadata_title, F.lit("")), F.nullif(stem(upload_name), F.lit("")), stem(path))


#: Kinds of rows that make up a document, in the order in which a task reads them: the document's own row, a page's scan, a line of it.
_OWN, _SCAN, _LINE = 0, 1, 2
_ROW = "doc_id long, page int, kind int, sheet int, y double, x double, size double, text string, href string, content binary, font string"


def _rows(df: DataFrame, kind: int, **given: Column | str) -> DataFrame:
    """``df`` in the form of _ROW; columns that aren't given are null."""
    fields = [f.split() for f in _ROW.split(", ")]
    values = {"doc_id": "doc_id", "kind": F.lit(kind), **given}
    return df.select(*[(F.col(v) if isinstance(v := values.get(n, F.lit(None)), str) else v).cast(t).alias(n) for n, t in fields])


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _assembled(rows: DataFrame, assemble: Callable[[_Document], tuple[bytes, str]]) -> DataFrame:
    """doc_id, content, how: ``assemble`` of each document. Rows are dealt out by document and stream through a task in order of page, kind,
    sheet and place; one document at a time is in memory."""
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "kind", "sheet", "y", "x", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Document | None = None

        def done() -> pa.RecordBatch:
            content, how = assemble(own)
            return pa.RecordBatch.from_arrays([pa.array([own.doc_id], pa.int64()), pa.array([content], pa.binary()), pa.array([how], pa.string())], names=["doc_id", "content", "how"])

        for batch in batches:
            for row in batch.to_pylist():
                if own is None or row["doc_id"] != own.doc_id:
                    if own is not None:
                        yield done()
                    own = _Document(row["doc_id"])
                own.take(row)
        if own is not None:
            yield done()

    return dealt.mapInArrow(run, "doc_id long, content binary, how string")


@dataclass
class _Document:
    """What is known of a document: its own row's content, text (a title) and font, scans by page, lines by page and sheet in order."""

    doc_id: int | None
    content: bytes | None = None
    title: str | None = None
    font: str = "Helvetica"
    scans: dict[int, bytes | None] = field(default_factory=dict)
    lines: dict[tuple[int, int], list[dict]] = field(default_factory=dict)

    def take(self, row: dict) -> None:
        if row["kind"] == _OWN:
            self.content, self.title = row["content"], row["text"]
            self.font = row["font"] or self.font
        elif row["kind"] == _SCAN:
            self.scans[row["page"]] = row["content"]
        else:
            self.font = row["font"] or self.font
            self.lines.setdefault((row["page"], row["sheet"] or 0), []).append(row)


MARGIN, TITLE_SIZE = 50.0, 22.0


def _clean(own: _Document) -> tuple[bytes, str]:
    """Title, then for each page its scan and its sheets of text; without scans and links if that fails; else a minimal file."""

    def text(rows: list[dict], links: bool) -> PDF.Page:
        texts = [(MARGIN, r["y"], r["size"], r["text"]) for r in rows]
        found = [(MARGIN, r["y"] - r["size"], MARGIN + advances(r["text"]).sum() * r["size"] / 1000, r["y"] + 0.2 * r["size"], r["href"]) for r in rows if links and r["href"]]
        return PDF.Page(texts, links=found)

    def pages(whole: bool) -> list[PDF.Page]:
        out = [PDF.Page([(MARGIN, 160.0, TITLE_SIZE, own.title)])] if own.title else []
        places = sorted({*own.lines, *((p, -1) for p, s in own.scans.items() if whole and s is not None)})
        for place in places:
            out.append(text(own.lines[place], whole) if place in own.lines else PDF.Page([], own.scans[place[0]], PDF.scan_size(own.scans[place[0]])))
        return out

    for whole, how in ((True, "whole"), (False, "text")):
        try:
            return PDF.pdf(pages(whole), own.font), how
        except Exception as e:  # a document that can't be assembled still has a file
            failed = e
    return PDF.minimal_pdf(str(own.title or own.doc_id), str(failed)), "minimal"


def _searchable(own: _Document) -> tuple[bytes, str]:
    """The scans, each a page of its own size, under their lines; else a copy of the original; else a minimal file."""
    try:
        if not own.scans or any(s is None for s in own.scans.values()):
            raise ValueError("a page without a scan")
        pages = [PDF.Page([(r["x"], r["y"], r["size"], r["text"]) for r in own.lines.get((p, 0), [])], own.scans[p], PDF.scan_size(own.scans[p])) for p in sorted(own.scans)]
        return PDF.pdf(pages, own.font), "overlay"
    except Exception as e:  # a document that can't be assembled still has a file
        return (own.content, "original") if own.content else (PDF.minimal_pdf(str(own.doc_id), str(e)), "minimal")


def clean_pdfs(lines: DataFrame, titles: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """doc_id, content, how (whole, text, minimal): one PDF for each document of placed ``lines`` (doc_id, page, sheet, y, size, line; also
    href, font), with ``titles`` (doc_id, title; also font) and ``scans`` (doc_id, page, jpeg) of those that have one."""
    rows = _rows(lines, _LINE, page="page", sheet="sheet", y="y", size="size", text="line", href=_optional(lines, "href"), font=_optional(lines, "font"))
    if titles is not None:
        rows = rows.unionByName(_rows(titles, _OWN, page=F.lit(-1), text="title", font=_optional(titles, "font")))
    if scans is not None:
        rows = rows.unionByName(_rows(scans, _SCAN, page="page", content="jpeg"))
    return _assembled(rows, _clean)


def searchable_pdfs(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, content, how (overlay, original, minimal): for each source (doc_id, content: the original, scans: JPEG of each page; also font) its
    scans with the placed ``lines`` (doc_id, page, x, y, size, text) over them, invisible; if that fails a copy of the original, else a
    minimal file. A page has its scan's size at 300 dpi. Lines of documents that aren't among the sources are left out."""
    known = lines.join(sources.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = _rows(known, _LINE, page="page", x="x", y="y", size="size", text="text")
    rows = rows.unionByName(_rows(sources, _OWN, page=F.lit(-1), content="content", font=_optional(sources, "font")))
    scans = sources.select("doc_id", F.posexplode("scans").alias("page", "jpeg"))
    return _assembled(rows.unionByName(_rows(scans, _SCAN, page="page", content="jpeg")), _searchable)
