"""Boxes on a grid, the streaming merge, widths, PDFs out and in, the file sink."""

import os
import random
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import metrics as M
from foliospark.functions.names import free
from foliospark.operators import limits as L
from foliospark.operators import overlay as O
from foliospark.operators import pages as P
from foliospark.operators import structure as S
from foliospark.operators import tiling as TI
from foliospark.sources import files, pdf, pdf_source, sink

CORNERS = "a double, b double, c double, d double"


def boxed(df):
    return df.withColumn("bbox", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).drop("a", "b", "c", "d")


def iou(a, b, clamped=False):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (size(a) + size(b) - w * h)


def some_boxes(rng, n, side):
    for i in range(n):
        x, y = rng.uniform(-100, side), rng.uniform(-100, side)
        yield (x, y, x + rng.choice([5, 40, 300, side]), y + rng.choice([5, 40, 300]))


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(1)
    own = [(d, 0, i, *b) for d in (1, 2) for i, b in enumerate(some_boxes(rng, 120, 5000))] + [(1, 0, 500, 1e12, 0.0, 1e13, 9.0), (1, 0, 501, 9.0, 9.0, 2.0, 2.0), (1, 0, 502, float("nan"), 0.0, 5.0, 5.0), (3, 0, 0, 0.0, 0.0, 9.0, 9.0)]
    other = [(d, 0, i, *b, f"t{i % 7}") for d in (1, 2) for i, b in enumerate(some_boxes(rng, 150, 5000))] + [(1, 0, 900, -1e12, -1e12, 1e13, 1e13, "all"), (1, 0, 901, 1e12, 0.0, 1e13, 9.0, "far")]
    blocks = boxed(spark.createDataFrame(own, f"doc_id long, page int, ord int, {CORNERS}")).withColumn("home", F.lit("kept")).withColumn("same", F.col("ord") * 2).withColumn("cell", F.lit(None).cast("string"))
    others = boxed(spark.createDataFrame(other, f"doc_id long, page int, ord int, {CORNERS}, block_type string"))
    links = others.withColumn("url", F.col("block_type")).filter("ord % 2 = 0")
    got = S.last_matches(blocks, [(others, "block_type", lambda a, b: G.overlaps(a, b, 0.3), "kind"), (links, "url", lambda a, b: G.contains(a, b, 0.5), "href")])
    rows = {(r["doc_id"], r["ord"]): r for r in got.collect()}
    assert got.columns == [*blocks.columns, "kind", "href"] and len(rows) == len(own) and all(r["home"] == "kept" and r["same"] == 2 * r["ord"] for r in rows.values())

    def inside(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w > 0 and h > 0 and w * h / ((b[2] - b[0]) * (b[3] - b[1])) >= 0.5

    for d, _, i, *a in own:
        if a[0] == a[0]:
            met = [(o, v) for e, _, o, *b, v in other if e == d and iou(a, b) >= 0.3]
            linked = [(o, v) for e, _, o, *b, v in other if e == d and o % 2 == 0 and inside(a, b)]
            assert rows[d, i]["kind"] == (max(met)[1] if met else None) and rows[d, i]["href"] == (max(linked)[1] if linked else None), (d, i)
    assert rows[1, 500]["kind"] == "far"


def test_a_full_page_is_many_tasks_work(spark):
    n = 20_000
    page = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("ord"), G.box(F.col("id") % 150 * 16, F.floor(F.col("id") / 150) * 16, F.col("id") % 150 * 16 + 15, F.floor(F.col("id") / 150) * 16 + 15).alias("bbox"))
    cells = page.select(F.explode(G.cells(F.col("bbox"))).alias("cell")).groupBy("cell").count()
    most, parts = cells.agg(F.max("count"), F.count("*")).first()
    assert parts > 80 and most < n / 40
    assert S.layout_types(page, page.withColumn("block_type", F.col("ord").cast("string"))).filter("matched_type = cast(ord as string)").count() == n


boxes = st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(-2, 40), st.integers(-2, 20)).map(lambda t: (float(t[0]), float(t[1]), float(t[0] + t[2]), float(t[1] + t[3])))


@settings(max_examples=200, deadline=None)
@given(st.lists(boxes, max_size=40), st.sampled_from([0.0, 0.05, 0.3, 0.5, 1.0]))
def test_hash_of_cells_equals_a_list(own, least):
    kept, accepted = [], TI.AcceptedBoxes(least)
    for b in own:
        duplicate = any(iou(a, b) >= least if a[2] > a[0] and a[3] > a[1] and b[2] > b[0] and b[3] > b[1] else least <= 0 for a in kept)
        assert accepted.overlapped(b) == duplicate
        if not duplicate:
            kept.append(b)
            accepted.add(b)


def test_merge_looks_through_blanks_and_keeps_columns(spark):
    rows = [(1, 0, "a ", 0, 0, 0.0, 0.0, 10.0, 10.0, "x"), (1, 0, "a", 1, 0, 1.0, 0.0, 11.0, 10.0, "y"), (1, 0, "b", 1, 1, 1.0, 0.0, 11.0, 10.0, "z"), (1, 1, "a", 0, 0, 0.0, 0.0, 10.0, 10.0, "v"), (1, 1, None, 0, 1, 0.0, 0.0, 10.0, 10.0, "w"), (1, 1, " ", 1, 1, 0.0, 0.0, 10.0, 9.0, "u")]
    df = boxed(spark.createDataFrame(rows, f"doc_id long, page int, text string, tile int, ord int, {CORNERS}, key string"))
    got = TI.merge_tiles(df)
    assert got.columns == df.columns and sorted(r["key"] for r in got.collect()) == ["v", "w", "x", "z"]
    assert next(r["text"] for r in got.collect() if r["key"] == "x") == "a "


def test_names_of_a_callers_columns_stay(spark):
    calls = spark.createDataFrame([("k", 1, "kept"), ("k", 2, "kept")], "key string, s int, own string").withColumn("ts", F.timestamp_seconds("s")).withColumn("micros", F.lit(7)).withColumn("cut", F.lit("c"))
    got = L.sliding_counts(calls, "key", "ts").collect()
    assert sorted(r["in_window"] for r in got) == [1, 2] and all(r["own"] == "kept" and r["micros"] == 7 and r["cut"] == "c" for r in got)
    assert free(calls, "Own", "own", "new") == ["Own_", "own__", "new"]
    cache = spark.createDataFrame([("j", 0, "{}")], "job_id string, page int, result string")
    pages = spark.createDataFrame([("j", 0, "old"), ("j", 1, "old")], "job_id string, page int, result string")
    assert sorted((r["page"], r["hit"], r["result"]) for r in P.replayed(pages, cache).collect()) == [(0, True, "{}"), (1, False, None)]


# widths


def plain_wrap(text, size, width):
    out = []
    for line in text.split("\n"):
        if not line.strip():
            out.append("")
            continue
        now = ""
        for c in line:
            if M.advances(now + c).sum() * size / 1000 > width and now:
                out.append(now)
                now = c
            else:
                now += c
        out.append(now)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abWi \n漢あｱ한é́😀", max_size=60), st.sampled_from([(10.0, 24.0), (11.0, 495.0), (12.0, 3.0), (5.0, 30.0), (10.0, 10.0)]))
def test_lines_by_width_equal_a_plain_loop(text, at):
    assert M.wrapped_lines(text, *at) == plain_wrap(text, *at)


def test_widths_in_jvm_and_numpy_agree(spark):
    texts = ["", "abc WWW", "漢字かなｶﾅ한글", "é́😀\x07\x85€", None, "".join(map(chr, range(0x20, 0x7F)))]
    got = [r["w"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.text_width(F.col("t")).alias("w")).collect()]
    assert got == [int(M.advances(t or "").sum()) for t in texts]
    row = spark.createDataFrame([("漢" * 30,)], "t string").select(O.horizontal_overlay(G.box(F.lit(0), F.lit(0), F.lit(100), F.lit(10)), F.col("t")).alias("p"), O.block_overlay(G.box(F.lit(0), F.lit(0), F.lit(100), F.lit(60)), F.col("t")).alias("b")).first()
    assert abs(row["p"]["size"] * 30 - 100) < 1e-9 and all(M.advances(x).sum() * row["b"]["size"] / 1000 <= 100 for x in row["b"]["lines"])


# PDFs


def jpeg(w=620, h=877):
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01\xff\xd9"


def texts_of(content):
    """The texts of each page, through the fonts' maps."""
    file, out = pdf_source.File(content), []
    for page in file.pages():
        fonts = {k: file.get(v) for k, v in file.get(page["Resources"])["Font"].items()}
        known = {}
        for name, font in fonts.items():
            if font and "ToUnicode" in font:
                cmap = file.decoded(file.get(font["ToUnicode"])).decode()
                known[name] = {a: bytes.fromhex(b).decode("utf-16-be") for a, b in re.findall(r"<([0-9A-F]+)> <([0-9A-F]+)>\n", cmap[cmap.index("beginbfchar") :])}
        rows = []
        for font, shown in re.findall(rb"/(\w) [\d.]+ Tf [-\d.]+ [-\d.]+ Td (<[0-9A-F]*>|\(.*?\)) Tj", file.decoded(file.get(page["Contents"])), re.S):
            if shown[:1] == b"<":
                code, own = shown[1:-1].decode(), ""
                while code:
                    n = 8 if "D8" <= code[:2] <= "DB" else 4
                    own, code = own + known[font.decode()][code[:n]], code[n:]
                rows.append(own)
            else:
                rows.append(pdf_source.value(shown, 0)[0].decode("cp1252"))
        out.append(rows)
    return out


def test_texts_of_all_scripts_come_back():
    texts = ["Plain (with) \\ brackets é", "臺灣文字 mixed Latin", "日本語かな", "한국어", "emoji 😀 and 𠀀", "™ €"]
    for font in ("Helvetica", *pdf.COMPOSITE, "Unknown"):
        content = pdf.pdf([pdf.Page([(10, 20, 9, t) for t in texts]), pdf.Page([(10, 20, 9, "two")])], font)
        assert texts_of(content) == [texts, ["two"]]
        if font in pdf.COMPOSITE:
            assert f"/Encoding /{pdf.COMPOSITE[font][0]}".encode() in content and font.encode() in content


def test_searchable_file_of_chinese_lines(spark):
    long = [f"第{i}行文字" for i in range(300)]
    lines = spark.createDataFrame([(1, 0, 10.0, 20.0 + i, 9.0, t) for i, t in enumerate(long)] + [(1, 1, 5.0, 9.0, 9.0, "末頁"), (9, 0, 1.0, 1.0, 1.0, "unknown")], "doc_id long, page int, x double, y double, size double, text string").repartition(4)
    sources = spark.createDataFrame([(1, b"%PDF-", [jpeg(620, 877), jpeg(300, 600)], "MSung-Light"), (2, b"%PDF-b", [jpeg(), b"no jpeg"], None), (3, None, [], None)], "doc_id long, content binary, scans array<binary>, font string")
    got = {r["doc_id"]: r for r in files.searchable_pdfs(lines, sources).collect()}
    assert set(got) == {1, 2, 3} and [got[i]["how"] for i in (1, 2, 3)] == ["overlay", "original", "minimal"]
    content = bytes(got[1]["content"])
    assert texts_of(content) == [long, ["末頁"]]
    found = list(pdf_source.rows_of("a.pdf", content))
    assert [(round(r["width"], 2), round(r["height"], 2)) for r in found if r["kind"] == "page"] == [(148.8, 210.48), (72.0, 144.0)]
    assert [r["width_px"] for r in found if r["kind"] == "image"] == [620, 300]


def test_clean_file_has_title_scans_texts_and_links(spark):
    lines = spark.createDataFrame([(1, 0, 0, 60.0, 11.0, "first", "http://a/"), (1, 0, 1, 60.0, 11.0, "second", None), (1, 1, 0, 60.0, 11.0, "第三", None), (2, 0, 0, 60.0, 11.0, "x", None)], "doc_id long, page int, sheet int, y double, size double, line string, href string")
    titles = spark.createDataFrame([(1, "題目", "HYSMyeongJo-Medium"), (3, "only a title", None)], "doc_id long, title string, font string")
    scans = spark.createDataFrame([(1, 0, jpeg()), (1, 1, None), (2, 0, b"damaged")], "doc_id long, page int, jpeg binary")
    got = {r["doc_id"]: r for r in files.clean_pdfs(lines, titles, scans).collect()}
    assert {i: got[i]["how"] for i in got} == {1: "whole", 2: "text", 3: "whole"}
    assert texts_of(bytes(got[1]["content"])) == [["題目"], [], ["first"], ["second"], ["第三"]]
    links = [r for r in pdf_source.rows_of("a", bytes(got[1]["content"])) if r["kind"] == "link"]
    assert [(r["page"], r["uri"]) for r in links] == [(2, "http://a/")] and b"HYSMyeongJo-Medium" in got[1]["content"]
    assert texts_of(bytes(got[2]["content"])) == [["x"]] and texts_of(bytes(got[3]["content"])) == [["only a title"]]


def modern_pdf():
    """A file whose objects are in an object stream, under a cross-reference stream with a predictor; size and resources are inherited."""
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [10 10 210 310] /Resources << /XObject << /Im#31 7 0 R >> >> >>", 3: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 50 60] >>",
              5: b"<< /Type /Page /Parent 3 0 R /Contents 8 0 R /Annots [<< /Subtype /Link /Rect [20 20 60 40] /A << /S /URI /URI (http://x/\\(1\\)) >> >> << /Subtype /Link /Rect [1 2 3 4] /Dest [4 0 R /Fit] >> << /Subtype /Text >>] >>", 6: b"<< /Type /Page /Parent 3 0 R >>", 10: b"<< /Title <FEFF984C> /Author () >>"}
    body, heads = b"", b""
    for n, o in packed.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    content = zlib.compress(b"q 100 0 0 50 20 30 cm /Im1 Do Q q 2 0 0 2 0 0 cm 10 0 0 10 50 50 cm /Im1 Do Q BT (no Do) Tj ET")
    objects = {7: (b"/Type /XObject /Subtype /Image /Width 4 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8", b"12345678"), 8: (b"/Filter /FlateDecode", content), 9: (b"/Type /ObjStm /N %d /First %d /Filter [/FlateDecode]" % (len(packed), len(heads)), zlib.compress(heads + body))}
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, (entries, data) in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (n, entries, len(data), data)
    start, rows = len(out), [b"\0\0\0\0\0"]
    order = list(packed)
    for n in range(1, 12):
        rows.append(bytes([2]) + (9).to_bytes(3) + bytes([order.index(n)]) if n in packed else bytes([1]) + (start if n == 11 else places[n]).to_bytes(3) + b"\0")
    before, predicted = bytes(5), b""
    for r in rows:
        predicted += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before))
        before = r
    data = zlib.compress(predicted)
    out += b"11 0 obj << /Type /XRef /Size 12 /Root 1 0 R /Info 10 0 R /W [1 3 1] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >> stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (len(data), data, start)
    return bytes(out)


def test_ingest_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "new.PDF").write_bytes(modern_pdf())
    (tmp_path / "old.pdf").write_bytes(pdf.pdf([pdf.Page([(1, 2, 3, "x")], jpeg(), (100, 200), [(1, 2, 3, 4, "http://y/")])]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "cut.pdf").write_bytes(modern_pdf()[:-400])
    (tmp_path / "x.txt").write_bytes(b"")
    found = sink.register(spark).read.format("foliospark_pdf").load(str(tmp_path)).cache()
    name = lambda r: os.path.basename(r["path"])
    assert sorted(name(r) for r in found.filter("kind = 'broken'").collect()) == ["bad.pdf", "cut.pdf"]
    pages = {(name(r), r["page"]): (r["width"], r["height"], r["n_pages"], r["title"], r["author"]) for r in pdf_source.pages(found).collect()}
    assert pages == {("new.PDF", 0): (200, 300, 3, "題", ""), ("new.PDF", 1): (200, 300, 3, "題", ""), ("new.PDF", 2): (50, 60, 3, "題", ""), ("old.pdf", 0): (100, 200, 1, "old", "")}
    links = {(name(r), r["uri"]): tuple(r["bbox"]) for r in P.hyperlinks(pdf_source.links(found)).collect()}
    assert links == {("new.PDF", "http://x/(1)"): (10, 270, 50, 290), ("old.pdf", "http://y/"): (1, 2, 3, 4)}
    images = {(name(r), r["page"], r["name"]): (r["width_px"], r["n_bytes"], tuple(r["bbox"])) for r in P.embedded_images(pdf_source.images(found)).collect()}
    assert images == {("new.PDF", 0, "Im1"): (4, 8, (10, 230, 110, 280)), ("old.pdf", 0, "I"): (620, len(jpeg()), (0, 0, 100, 200))}
    assert {r["stem"]: r["page_count"] for r in files.uploads(spark, f"{tmp_path}/*").collect() if r["kind"] == "pdf"} == {"old": 1, "bad": 0, "cut": 0, "new": 3}
    assert files.uploads(spark, f"{tmp_path}/in/*").first()["page_count"] == 3


# sink


def listed(folder):
    return sorted((f, (p / f).read_bytes()) for d, _, fs in os.walk(folder) for f in fs for p in [__import__("pathlib").Path(d)] if not f.startswith("."))


def test_files_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}.txt", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    sink.register(spark)
    out = str(tmp_path / "out")
    df.write.format("foliospark_files").mode("append").save(out)
    assert listed(out) == sorted((f"f{i}.txt", bytes([i])) for i in range(20)) and not os.listdir(f"{out}/_temporary") and all(d.startswith(("part-", "_temporary")) for d in os.listdir(out))
    df.limit(3).write.format("foliospark_files").mode("overwrite").save(out)
    assert len(listed(out)) == 3
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("ok", b""), ("../x", b"")], "name string, content binary").coalesce(1).write.format("foliospark_files").mode("append").save(out)
    assert len(listed(out)) == 3 and not os.listdir(f"{out}/_temporary")
    with pytest.raises(Exception, match="need a name"):
        spark.range(3).write.format("foliospark_files").mode("append").save(out)


def test_a_task_that_ran_twice_leaves_its_files_once(tmp_path, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)})))
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    writer = sink.FileWriter(str(tmp_path), StructType([StructField("name", StringType()), StructField("content", BinaryType())]), False)
    rows = [{"name": "a", "content": b"1"}, {"name": "b", "content": b"2"}]
    broken = iter([rows[0], {"name": "", "content": b""}])
    with pytest.raises(ValueError):
        writer.write(broken)
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.folder != second.folder
    writer.commit([second])
    assert listed(tmp_path) == [("a", b"1"), ("b", b"2")]
    writer.abort([first])
    assert listed(tmp_path) == [("a", b"1"), ("b", b"2")]
