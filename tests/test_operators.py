"""Vectors derived by hand, and models in plain Python."""

import struct
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import images as I
from foliospark.functions import ocr_json as J
from foliospark.functions import text as T
from foliospark.operators import jobs as Q
from foliospark.operators import limits as L
from foliospark.operators import overlay as O
from foliospark.operators import pages as P
from foliospark.operators import structure as S
from foliospark.operators import tiling as TI
from foliospark.sources import files, ocr, pdf
from foliospark.sources.settings import client_settings
from foliospark.sources.settings import settings as read_settings
from foliospark.streaming import control


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return G.box(*[F.lit(float(x)) for x in v])


def test_overlap_and_containment(spark):
    page = box(0, 0, 10, 10)
    assert one(spark, G.overlaps(page, box(0, 0, 10, 3))) and not one(spark, G.overlaps(page, box(0, 0, 10, 2.9)))
    assert not one(spark, G.overlaps(page, box(10, 0, 20, 10))) and not one(spark, G.overlaps(box(0, 0, 0, 0), box(0, 0, 0, 0)))
    assert one(spark, G.contains(page, box(8, 0, 12, 10))) and not one(spark, G.contains(page, box(9, 0, 12, 10)))
    assert one(spark, G.area(box(5, 5, 0, 0))) == 25 and one(spark, G.clamped_area(box(5, 5, 0, 0))) == 0


def test_last_match_wins_and_greedy_merge(spark):
    text = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page int, ord int, a double, b double, c double, d double").withColumn("bbox", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    two = text.crossJoin(spark.createDataFrame([(0, "heading"), (1, "caption")], "o int, block_type string")).drop("ord").withColumnRenamed("o", "ord")
    assert S.layout_types(text, two).first()["matched_type"] == "caption"
    row = [(1, 0, "t", 0, i, float(4 * i), 0.0, 4.0 * i + 10, 10.0) for i in range(3)]
    tiles = spark.createDataFrame(row, "doc_id long, page int, text string, tile int, ord int, a double, b double, c double, d double").withColumn("bbox", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert sorted(r["ord"] for r in TI.merge_tiles(tiles).collect()) == [0, 2]


def largest_method(spark, df):
    """Bytes of the largest method that Spark generates for a plan; the JVM compiles none of more than 8,000."""
    seq = df._jdf.queryExecution().debug().codegenToSeq()
    return max(seq.apply(i)._3().maxMethodCodeSize() for i in range(seq.length()))


def test_matching_boxes_is_compiled(spark):
    rows = "doc_id long, page int, ord int, text string, size double, v string, a double, b double, c double, d double"
    blocks = spark.createDataFrame([(1, 0, 0, "t", 1.0, "k", 0.0, 0.0, 10.0, None)], rows).withColumn("bbox", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).select("doc_id", "page", "ord", "text", "size", "v", "bbox")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = S.last_matches(blocks, [(blocks, "v", lambda a, b: G.overlaps(a, b, 0.3), "kind"), (blocks, "v", lambda a, b: G.contains(a, b, 0.5), "href")])
        assert largest_method(spark, found) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # a box without a corner stays, and meets nothing
    assert [(r["v"], r["kind"], r["href"]) for r in found.collect()] == [("k", None, None)]


def test_vertical_layout_places_once(spark):
    from foliospark.plans.catalogue import QUERIES

    plan = QUERIES["vertical_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(") == 1
    rect, size = (5.0, 30.0, 25.0, 70.0), 3.0
    for text in (None, "", " \u3000\n", "a b", "𠀀 é\u0301x", "abc " * 50):
        chars = "".join((text or "").split())
        step = 40.0 / len(chars) if chars else 0.0
        size = max(3.0, min(20.0, step, 48.0))
        want = [(i, c, 5.0, 30.0 + size + i * step, size) for i, c in enumerate(chars) if 30.0 + size + i * step <= 60.0]
        assert [tuple(r) for r in one(spark, O.vertical_overlay(box(*rect), F.lit(text).cast("string"), 60.0)) or []] == want


@pytest.mark.parametrize("text", [None, "", "a", "\n", "ab\n \ncd", "abcdefghij" * 7, "x\n\n" * 9])
def test_counted_lines_are_wraps(spark, text):
    for size, width in ((12.0, 30.0), (3.0, 1.0), (11.0, 495.0)):
        given = F.lit(text).cast("string"), F.lit(size), F.lit(width)
        assert one(spark, O.wrapped(*given)) == len(one(spark, O.wrap(*given)))


def test_blanks_are_looked_for_not_cut(spark):
    texts = [None, "", " ", "\u3000\n\x1c\x85", " a ", "\u200b", "a" * 99]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.is_blank(F.col("t")).alias("b"))
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["b"] for r in df.orderBy("i").collect()] == [not (t or "").strip() for t in texts]


@pytest.mark.parametrize("sizes, median", [([1, 2, 3, 4], 3), ([0, -1], 12), ([5], 5)])
def test_upper_median(spark, sizes, median):
    assert spark.createDataFrame([(float(s),) for s in sizes], "s double").agg(S.upper_median(F.col("s"))).first()[0] == median


@pytest.mark.parametrize("text, size, middle, kind", [("12", 10, 50, "page-number"), ("12", 10, 500, "paragraph"), ("12345", 10, 50, "paragraph"), ("x", 14.1, 500, "heading"), ("x", 14.0, 500, "paragraph"), ("x", 7, 900, "footnote"), ("x", 7, 800, "paragraph"), ("• a", 10, 500, "list-item"), ("1. a", 10, 500, "list-item"), ("3)x", 10, 500, "paragraph"), ("１. b", 10, 500, "list-item")])
def test_inferred_type(spark, text, size, middle, kind):
    assert one(spark, S.infer_type(F.lit(text), F.lit(float(size)), box(0, middle, 1, middle), F.lit(10.0), F.lit(1000))) == kind


def test_heading_levels(spark):
    assert [one(spark, S.heading_level(F.lit(s), F.lit(1.0))) for s in (2.01, 2.0, 1.61, 1.6)] == [1, 2, 2, 3]


@pytest.mark.parametrize("text, lang", [("", "en"), (None, "en"), ("abc", "en"), ("这个", "ch_sim"), ("臺灣", "ch_tra"), ("カナ漢", "japan"), ("한漢", "korean")])
def test_block_language(spark, text, lang):
    assert one(spark, T.block_language(F.lit(text).cast("string"))) == lang


@pytest.mark.parametrize("texts, lang", [([""], "ch_tra"), (["漢"], "ch_tra"), (["书学", "臺"], "ch_tra"), (["书学们", "臺"], "ch_sim"), (["abc", "한"], "korean")])
def test_document_language(spark, texts, lang):
    assert spark.createDataFrame([(t,) for t in texts], "t string").agg(T.language_of(F.col("t"))).first()[0] == lang


def test_document_language_of_long_texts(spark):
    """Flags and counts against plain Python, and 20 MB in a few seconds: each character isn't compared with all of a list."""
    texts = [None, "", "a\x00é书", "书学们臺 x" * 3, "𠀀", "\u2fff\u3000", "\u30ff", "\ud7af", "臺灣 a", "豈"]
    within = lambda t, *ranges: any(a <= ord(c) <= b for c in t or "" for a, b in ranges)
    for t in texts:
        trad, simp = (sum(c in cs for c in t or "") for cs in (T.TRADITIONAL, T.SIMPLIFIED))
        cjk = within(t, (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x3000, 0x303F))
        want = "ch_tra" if not t else "korean" if within(t, (0xAC00, 0xD7AF)) else "japan" if within(t, (0x3040, 0x30FF)) else "en" if not cjk else "ch_sim" if simp > 2 * trad else "ch_tra"
        assert spark.createDataFrame([(t,)], "t string").agg(T.language_of(F.col("t"))).first()[0] == want, t
    long = spark.range(0, 200, 1, 4).select(F.repeat(F.concat(F.lit("plain words é "), F.col("id").cast("string")), 6000).alias("t"))
    began = time.perf_counter()
    assert long.agg(T.language_of(F.col("t"))).first()[0] == "en"
    assert time.perf_counter() - began < 8


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="a \t\x1c\x85　\n​", max_size=6))
def test_strip_is_pythons(spark, text):
    assert one(spark, T.strip(F.lit(text))) == text.strip()


def test_recognition_json(spark):
    texts = [None, "", "no json", '```json\n{"direction":"VERTICAL","blocks":[{"text":["a","b"],"type":"Heading","bbox":[1,"2",3,4,9],"lines":[{"text":"l"},{"text":""},3]},5]}\n```', 'note {"blocks":[{"bbox":{"x0":1,"y1":2}}]} end', "[1]", '{"blocks":7}']
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = {r["i"]: r["page_result"] for r in J.parse_pages(raw).collect()}
    assert all(got[i]["blocks"] == [] and got[i]["direction"] == "horizontal" for i in (0, 1, 2, 5, 6))
    b = got[3]["blocks"]
    assert got[3]["direction"] == "vertical" and len(b) == 1 and b[0]["text"] == "a" and tuple(b[0]["bbox"]) == (1, 2, 3, 4) and [x["text"] for x in b[0]["lines"]] == ["l"]
    assert tuple(got[4]["blocks"][0]["bbox"]) == (1, 0, 0, 2) and got[4]["blocks"][0]["text"] == ""


def test_tiles_sizes_and_images(spark):
    grid = one(spark, G.tile_grid(F.lit(2480), F.lit(3508)))
    assert [tuple(t)[1:] for t in grid] == [(0, 0, 1488, 2104), (992, 0, 2480, 2104), (0, 1404, 1488, 3508), (992, 1404, 2480, 3508)]
    small = one(spark, G.downscale(F.lit(2480), F.lit(3508)))
    assert (small["width"], small["height"]) == (1447, 2048)
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 150, 149) + b"\0" * 9
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x0b\x08" + struct.pack(">HH", 70, 90) + b"\0" * 20
    sizes = spark.createDataFrame([(png,), (jpg,), (b"x",), (None,)], "c binary").select(I.image_sizes("c").alias("s")).collect()
    assert [tuple(r["s"]) for r in sizes] == [(150, 149), (90, 70), (0, 0), (0, 0)]
    assert [one(spark, I.is_significant(F.lit(w), F.lit(h), F.lit(n))) for w, h, n in ((150, 150, 0), (149, 900, 0), (0, 0, 5000), (0, 0, 5001))] == [True, False, False, True]


def test_jobs(spark):
    pages = spark.createDataFrame([(1, p) for p in (0, 1, 2, 5, 7, 8, 9, 9)], "k int, page int")
    assert Q.page_ranges(pages, "k").first()["ranges"] == "1–3, 6, 8–10"
    assert [one(spark, Q.progress(F.lit(p), F.lit(7))) for p in range(7)] == [5, 16, 27, 39, 50, 62, 73]
    commands = spark.createDataFrame([("j", i, c) for i, c in enumerate(["pause", "stop", "start", "tick", "stop", "pause", "tick", "finish_ok"])], "job_id string, seq long, command string")
    got = sorted(Q.transitions(commands).collect(), key=lambda r: r["seq"])
    assert [(r["after"], r["accepted"], r["stop_flag"]) for r in got] == [("paused", True, False), ("paused", True, True), ("queued", True, False), ("processing", True, False), ("processing", True, True), ("processing", True, True), ("stopped", True, False), ("stopped", False, False)]
    files_ = spark.sql("SELECT * FROM VALUES ('upload','a',timestamp'2024-01-01'),('upload','b',timestamp'2024-01-01'),('upload','c',timestamp'2024-01-01') t(kind, stem, mtime)")
    jobs_ = spark.createDataFrame([("a", "done"), ("b", "failed")], "job_id string, status string")
    assert sorted(r["stem"] for r in Q.retention(files_, jobs_, F.expr("timestamp'2024-01-02 01:00:00'")).collect()) == ["a", "c"]
    assert [one(spark, F.array_join(T.formats(F.lit(f).cast("array<string>") if f is None else F.array(*map(F.lit, f)).cast("array<string>")), ",")) for f in (None, [], ["x"], ["searchable", "clean"])] == ["clean", "clean", "clean", "searchable,clean"]


def test_limits(spark):
    calls = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 100, 86399, 86400, 100000, 172799, 172800))], "key long, seq long, seconds double")
    assert [r["used"] for r in sorted(L.daily_quota(calls, 10).collect(), key=lambda r: r["seq"])] == [1, 2, 3, 1, 2, 3, 1]
    stamps = spark.createDataFrame([(1, t) for t in (0.0, 60.0, 120.5)], "k int, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["in_window"] for r in sorted(L.sliding_counts(stamps, "k", "ts").collect(), key=lambda r: r["s"])] == [1, 2, 1]
    times = [None, None, -0.5, -5000.0] + [x * 3840.0 + d for x in range(-2, 3) for d in (-60.000001, -60.0, -59.5, -1.0, 0.0, 0.0, 1.0, 59.5, 60.0, 61.0)]
    stamps = spark.createDataFrame([(k, t) for k in (1, 2) for t in times[: len(times) // k]], "k int, s double").withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")))
    got = sorted(L.sliding_counts(stamps, "k", "ts", oldest=True).collect(), key=lambda r: (r["k"], r["s"] is not None, r["s"]))
    for k in (1, 2):
        own = sorted(round(t * 1e6) for t in times[: len(times) // k] if t is not None)
        seen = [[u for u in own if t - 60_000_000 <= u <= t] for t in own]
        assert [r["in_window"] for r in got if r["k"] == k] == [2, 2] + [len(x) for x in seen]
        assert [r["oldest_age"] for r in got if r["k"] == k and r["s"] is not None] == [(t - x[0]) / 1e6 for t, x in zip(own, seen)]
    assert [one(spark, L.backoff_ceiling(F.lit(n))) for n in range(1, 9)] == [4, 8, 16, 32, 64, 120, 120, 120]
    assert one(spark, L.retry_hint(F.lit('{"a":[{"retryDelay":"30s"}]}'), F.lit(""))) == 30 and one(spark, L.retry_hint(F.lit("{}"), F.lit("x"))) is None


def wrapped(text, size, width, widths=None):
    widths = widths or (lambda t: len(t) * 600)
    out = []
    for line in text.split("\n"):
        if not line.strip():
            out.append("")
            continue
        now = ""
        for c in line:
            if widths(now + c) * size / 1000 > width and now:
                out.append(now)
                now = c
            else:
                now += c
        if now:
            out.append(now)
    return out or [""]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n漢", max_size=30), st.sampled_from([(10.0, 24.0), (11.0, 495.0), (12.0, 3.0), (5.0, 30.0)]))
def test_wrap(spark, text, at):
    assert one(spark, O.wrap(F.lit(text), F.lit(at[0]), F.lit(at[1]))) == wrapped(text, *at)


def test_overlay_and_markup(spark):
    assert one(spark, T.escape_markup(F.lit("\x01<&\"'"))) == "&lt;&amp;&quot;&apos;"
    v = one(spark, O.vertical_overlay(box(0, 0, 10, 30), F.lit("a b"), 100))
    assert [(p["c"], p["y"]) for p in v] == [("a", 10.0), ("b", 25.0)]
    assert one(spark, O.horizontal_overlay(box(0, 0, 1, 10), F.lit("　"))) is None
    assert one(spark, O.body_markup(F.lit("list-item"), F.lit(" a<b "), F.lit("u"))) == '<a href="u" color="blue">• a&lt;b</a>'
    assert one(spark, O.block_overlay(box(0, 0, 100, 50), F.lit("abc"), uniform=True))["lines"] == one(spark, O.block_overlay(box(0, 0, 100, 50), F.lit("abc")))["lines"] == ["abc"]


def test_recognition_uses_the_cache_and_isolates_pages(spark):
    class Flaky:
        def __init__(self, config):
            pass

        def analyse(self, image, prompt):
            if image == b"bad":
                raise ValueError("no page")
            return image.decode()

    ocr.register("Flaky", Flaky)
    pages = spark.createDataFrame([("j", 0, b"cached"), ("j", 1, b"fresh"), ("j", 2, b"bad")], "job_id string, page int, image binary")
    cache = spark.createDataFrame([("j", 0, '{"text": "from cache"}'), ("j", 1, "corrupt")], "job_id string, page int, result string")
    got = {r["page"]: (r["result"], r["error"]) for r in ocr.recognize(pages, cache, "FLAKY", {}, "p", tasks=2).collect()}
    assert got == {0: ('{"text": "from cache"}', None), 1: ("fresh", None), 2: (None, "ValueError: no page")}
    with pytest.raises(ValueError, match="flaky"):
        ocr.provider("other", {})


def test_all_calls_a_minute_are_used():
    now, made = [0.0], []
    paces = [ocr.Pace(15, 8, t, 0.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)) for t in range(8)]
    for _ in range(6):
        for pace in paces:
            pace.wait()
            made.append(now[0])
    for i, t in enumerate(made):
        inside = [x for x in made if t - 60 <= x <= t]
        assert len(inside) <= 15 and (i < 20 or len(inside) >= 14)
    assert sum(x < 60 for x in made) == 15
    again = ocr.Pace(15, 8, 0, 0.0, again=True, clock=lambda: 500.0, sleep=made.append)
    again.wait()
    assert made[-1] == pytest.approx(8 * 60.1 / 15)


def test_calls_that_take_too_long():
    timed = ocr.Timed(0.2)
    with pytest.raises(TimeoutError):
        timed.call(time.sleep, 1.0)
    assert timed.call(int, "3") == 3 and ocr.Timed(None).call(int, "4") == 4


def test_pauses_between_attempts():
    assert ocr.pause(3, None, True, 4, 120, draw=lambda a, b: b) == 16 and ocr.pause(9, None, True, 4, 120, draw=lambda a, b: b) == 120
    assert ocr.pause(1, 0.1, True, 4, 120) == 0.5 and ocr.pause(2, None, False, 4, 120) == 8 and ocr.pause(1, 500, True, 4, 120) == 120


def test_recognition_into_a_cache(spark, tmp_path):
    class Counting:
        def __init__(self, config):
            self.folder = config["folder"]

        def analyse(self, image, prompt):
            import uuid

            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            if image == b"bad":
                raise ValueError("no page")
            return '{"blocks": [{"text": "' + image.decode() + '"}]}'

    ocr.register("Counting", Counting)
    folder = tmp_path / "calls"
    folder.mkdir()
    pages = spark.createDataFrame([("j", i, x) for i, x in enumerate((b"a", b"b", b"bad", b"d"))], "job_id string, page int, image binary")
    path = f"file://{tmp_path}/cache"
    for run, (most, made, known) in enumerate([(2, 2, [0, 1]), (None, 2, [0, 1, 3]), (None, 1, [0, 1, 3])]):
        before = len(list(folder.iterdir()))
        got = ocr.recognize_into(path, run, pages, "counting", {"folder": str(folder)}, "p", per_day=most, tasks=2, attempts=1)
        assert sorted(r["page"] for r in got.collect()) == known and len(list(folder.iterdir())) - before == made
    corrupt = spark.createDataFrame([("j", 0, 9, "{broken"), ("j", 1, 9, "[1]"), ("j", 3, 9, None)], "job_id string, page int, seq long, result string")
    assert P.replayed(pages.select("job_id", "page"), corrupt).filter("hit").count() == 0


def test_pagination_is_a_plain_fold(spark):
    rows = [(1, 0, 0, "heading", "A title"), (1, 0, 1, "paragraph", "word " * 1500), (1, 0, 2, "heading", "Another"), (1, 0, 3, "footnote", "x\n\ny"), (1, 1, 0, "paragraph", "  "), (1, 2, 0, "paragraph", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, page int, ord int, element_type string, text string, level int")
    got = sorted((r["doc_id"], r["page"], r["sheet"], round(r["y"], 6), r["size"], r["line"]) for r in O.paginate(O.styled(df), uniform=True).collect())
    sizes, want = {"heading": 16.0, "paragraph": 11.0, "footnote": 9.0}, []
    for page in (0, 1, 2):
        sheet, y = 0, 60.0
        for _, p, _, kind, text in rows:
            if p != page or not text.strip():
                continue
            size = sizes[kind]
            most = max(n for n in range(1, 200) if n * size * 0.6 <= 495.0)
            lines = [x for line in text.strip().split("\n") for x in ([line[i : i + most] for i in range(0, len(line), most)] or [""])]
            for i, line in enumerate(lines):
                y += 8.0 if i == 0 and kind == "heading" else 0.0
                if y > 790.0:
                    sheet, y = sheet + 1, 60.0
                want.append((1, p, sheet, round(y, 6), size, line))
                y += size * 1.5 + (4.0 if i == len(lines) - 1 else 0.0)
    assert got == sorted(want)


def test_searchable_files_fall_back(spark):
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01\xff\xd9"
    sources = spark.createDataFrame([(1, b"%PDF-a", [jpeg, jpeg]), (2, b"%PDF-b", [jpeg, None]), (3, None, None)], "doc_id long, content binary, scans array<binary>")
    lines = spark.createDataFrame([(1, 0, 10.0, 20.0, 9.0, "one"), (1, 1, 10.0, 20.0, 9.0, "two"), (2, 0, 1.0, 2.0, 3.0, "x")], "doc_id long, page int, x double, y double, size double, text string")
    got = {r["doc_id"]: (r["how"], bytes(r["content"])) for r in files.searchable_pdfs(lines, sources).collect()}
    assert got[1][0] == "overlay" and got[1][1].count(b"/Type /Page ") == 2 and got[2] == ("original", b"%PDF-b") and got[3][0] == "minimal"


def test_delays_in_details():
    assert L.delay_of('{"a":[{"x":{"retry_delay":"1.5 s"}}],"retryAfter":9}') == 1.5 and L.delay_of('[{"Retry-After":"7"},{"retryDelay":1}]') == 7
    assert [L.delay_of(x) for x in (None, "", "no", "{}", '{"retryDelay":null}', '{"retryDelay":"soon"}', '{"retryDelay":"1e3"}', '{"retryDelay":"-5s"}', '{"retryDelay":"inf"}', '[[{"retryDelay":1}]]', "7")] == [None] * 11
    assert L.delay_of('{"retryDelay":{"retryDelay":"2s"}}') is None and L.delay_of('{"retryDelay":"soon","a":{"retryAfter":3}}') == 3
    assert [L.delay_said(x) for x in ("Retry-Delay: 7s", "retry delay = '7.5 s'", 'x "retryDelay": "12s"', "retry_delay:3 m, retry_delay:4s", "delay: 5s", None, "retry_delay: s")] == [None, 7.5, 12, 4, None, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.pdf([pdf.Page([(72, 200, 16, "one (1)")]), pdf.Page([(72, 200, 16, "two")])]))
    (tmp_path / "b.JPG").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"damaged")
    got = {r["stem"]: (r["kind"], r["page_count"]) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a": ("pdf", 2), "b": ("jpg", 1), "c": ("pdf", 0)}
    lines = spark.createDataFrame([(1, 0, 0, 60.0, 11.0, "x"), (1, 1, 0, 60.0, 11.0, "y"), (2, 0, 0, 60.0, 11.0, "z")], "doc_id long, page int, sheet int, y double, size double, line string")
    made = {r["doc_id"]: bytes(r["content"]) for r in files.clean_pdfs(lines).collect()}
    assert made[1].count(b"/Type /Page ") == 2 and made[2].startswith(b"%PDF")
    assert one(spark, files.title(F.lit(""), F.lit("Book.v2.pdf"), F.lit("/x/y.pdf"))) == "Book.v2"


def test_settings():
    own = read_settings("ocr:\n  rpm: 15  # free\n  engine: other\npipeline:\n  max_pdf_size_mb: 7\n")
    assert own["ocr"]["rpm"] == 15 and own["ocr"]["dpi"] == 300 and client_settings(own) == {"max_pdf_size_mb": 7}


def stream(spark, df, tmp_path, parts):
    path = str(tmp_path / "in")
    rows = df.collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(streamed, name, tmp_path):
    q = streamed.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_streaming_machine_equals_batch(spark, tmp_path):
    from foliospark.plans.relations import commands, read

    c = commands(read(spark, "/root/testdata/sf0.001", "events")).orderBy("seq").limit(300)
    run(control.transitions(stream(spark, c, tmp_path, 3)), "machine", tmp_path)
    key = lambda r: (r["job_id"], r["seq"])
    assert sorted(spark.table("machine").collect(), key=key) == sorted(Q.transitions(c).collect(), key=key)


def test_streaming_quota_equals_batch(spark, tmp_path):
    calls = spark.createDataFrame([(i % 3, i, i * 9000.0) for i in range(90)], "key long, seq long, seconds double")
    run(control.daily_quota(stream(spark, calls, tmp_path, 2), 4), "quota", tmp_path)
    key = lambda r: (r["key"], r["seq"])
    assert sorted(spark.table("quota").collect(), key=key) == sorted(L.daily_quota(calls, 4).collect(), key=key)


def test_queue_runs_what_is_still_queued(spark, tmp_path):
    queue = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, seq long")
    ran = []
    jobs_ = lambda: spark.createDataFrame([("a", "queued"), ("b", "stopped")], "job_id string, status string")
    writer = control.consume_queue(stream(spark, queue, tmp_path, 1), jobs_, lambda df: ran.extend(r["job_id"] for r in df.collect()), str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination(120)
    assert ran == ["a"]
