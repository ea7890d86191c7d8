"""Small PDFs: pages of placed text, scans and links, written as bytes.

Text goes out in the standard font Helvetica where that has its characters, else, or if it is asked for, in a composite font of the reader's
(CID fonts aren't embedded): its strings are UTF-16, which a predefined CMap takes, and a ToUnicode map of the characters in use says what they
are."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from foliospark.functions.images import jpeg_size
from foliospark.functions.metrics import LATIN

A4 = (595.0, 842.0)
# For each font its predefined CMap, its character collection and the supplement of that.
COMPOSITE = {
    "STSong-Light": ("UniGB-UTF16-H", "GB1", 4),
    "MSung-Light": ("UniCNS-UTF16-H", "CNS1", 4),
    "HeiseiMin-W3": ("UniJIS-UTF16-H", "Japan1", 4),
    "HYSMyeongJo-Medium": ("UniKS-UTF16-H", "Korea1", 2),
}
#: The composite font for text that Helvetica lacks, where none is asked for.
FALLBACK = "MSung-Light"


@dataclass
class Page:
    """Texts (x, y from the top, font size, text), an optional JPEG under them, the page's size in points, links (x0, y0, x1, y1 from the
    top, address). Text over a JPEG is invisible, but can be searched and selected."""

    texts: list[tuple[float, float, float, str]] = field(default_factory=list)
    jpeg: bytes | None = None
    size: tuple[float, float] = A4
    links: list[tuple[float, float, float, float, str]] = field(default_factory=list)


def scan_size(jpeg: bytes, dpi: float = 300.0) -> tuple[float, float]:
    """The page that a scan makes: its pixels at ``dpi``, in points. ValueError if it is no JPEG."""
    w, h = jpeg_size(jpeg)
    if not w or not h:
        raise ValueError("a scan that is no JPEG")
    return w * 72 / dpi, h * 72 / dpi


def _string(text: str) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1")) + b")"


def _wide(text: str) -> bytes:
    return b"<" + text.encode("utf-16-be", "replace").hex().upper().encode() + b">"


def _is_plain(text: str) -> bool:
    return all(32 <= ord(c) < 127 or 160 <= ord(c) < 256 for c in text)


def _to_unicode(characters: set[str]) -> bytes:
    codes = [_wide(c) for c in sorted(characters)]
    body = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(b"%s %s" % (c, c) for c in part)) for part in (codes[i : i + 100] for i in range(0, len(codes), 100)))
    return (
        b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Own-UTF16 def\n/CMapType 2 def\n"
        b"3 begincodespacerange\n<0000> <D7FF>\n<D800DC00> <DBFFDFFF>\n<E000> <FFFF>\nendcodespacerange\n" + body + b"endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend"
    )


def pdf(pages: list[Page], font: str = "Helvetica") -> bytes:
    """A PDF of ``pages``, of one A4 page without any. ``font``: Helvetica or one of COMPOSITE (any other counts as Helvetica)."""
    # 1 catalog, 2 page tree, 3 Helvetica, 4 to 7 the composite font
    objects: list[bytes] = [b""] * 2 + [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"] + [b"null"] * 4
    chosen = font if font in COMPOSITE else None
    wide: set[str] = set()
    kids = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(content: bytes, entries: bytes = b"") -> bytes:
        packed = zlib.compress(content)
        return b"<< %s/Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (entries, len(packed), packed)

    for page in pages or [Page()]:
        body, extra = [], b""
        width, height = page.size
        if page.jpeg is not None:
            w, h = jpeg_size(page.jpeg)
            image = add(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, len(page.jpeg), page.jpeg))
            extra = b" /XObject << /I %d 0 R >>" % image
            body.append(b"q %.2f 0 0 %.2f 0 0 cm /I Do Q" % (width, height))
        mode = 0 if page.jpeg is None else 3
        for x, y, size, text in page.texts:
            plain = chosen is None and _is_plain(text)
            if not plain:
                wide.update(text)
            body.append(b"BT %d Tr /%s %.2f Tf %.2f %.2f Td %s Tj ET" % (mode, b"F" if plain else b"C", size, x, height - y, _string(text) if plain else _wide(text)))
        links = [
            b"<< /Type /Annot /Subtype /Link /Rect [%.2f %.2f %.2f %.2f] /Border [0 0 0] /A << /S /URI /URI %s >> >>" % (x0, height - y1, x1, height - y0, _string(uri.encode("utf-8").decode("latin-1")))
            for x0, y0, x1, y1, uri in page.links
        ]
        annotations = b" /Annots [%s]" % b" ".join(links) if links else b""
        contents = add(stream(b"\n".join(body)))
        own = add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F 3 0 R /C 4 0 R >>%s >> /Contents %d 0 R%s >>" % (width, height, extra, contents, annotations))
        kids.append(b"%d 0 R" % own)
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    if wide:
        name = chosen or FALLBACK
        cmap, ordering, supplement = COMPOSITE[name]
        base, widths = name.encode(), b" ".join(b"%d" % w for w in LATIN)
        objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /%s-%s /Encoding /%s /DescendantFonts [5 0 R] /ToUnicode 7 0 R >>" % (base, cmap.encode(), cmap.encode())
        # in these collections the first 95 characters are those of printable ASCII
        objects[4] = b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /%s /CIDSystemInfo << /Registry (Adobe) /Ordering (%s) /Supplement %d >> /DW 1000 /W [1 [%s]] /FontDescriptor 6 0 R >>" % (base, ordering.encode(), supplement, widths)
        objects[5] = b"<< /Type /FontDescriptor /FontName /%s /Flags 6 /FontBBox [-200 -250 1100 950] /ItalicAngle 0 /Ascent 880 /Descent -120 /CapHeight 880 /StemV 93 >>" % base
        objects[6] = stream(_to_unicode(wide))
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def minimal_pdf(title: str, message: str) -> bytes:
    return pdf([Page([(72, 200, 16, title[:100]), (72, 240, 10, message[:500])])])
