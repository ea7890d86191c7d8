"""Tiled recognition as a flow: whole pages first, tiles of large pages without a text, merged on the page."""

import json
import os
import random

import __spark_entry__ as entry
from foliospark.operators import tiling
from foliospark.sources import ocr, tiled

PAGES = "job_id string, page int, image binary, width_px int, height_px int"


def cutter():
    """A function of its own, which tasks needn't import."""

    def cut(image, part, sides):
        if image == b"torn" and part[0] > 0:
            raise ValueError("no such part")
        return b"|".join([image, *(str(n).encode() for n in (*part, *sides))])

    return cut


def provider():
    class Seer:
        """Sees a word at (2500, 1100) to (2700, 1200) of a page ``dots`` in its parts alone; logs its calls."""

        def __init__(self, config):
            self.folder, self.down = config["folder"], config.get("down")

        def analyse(self, image, prompt):
            name, x0, y0, x1, y1, w, h = image.decode().split("|")
            with open(os.path.join(self.folder, f"{name}-{x0}-{y0}-{x1}-{y1}-{prompt}"), "a") as f:
                f.write("x")
            if prompt == "tile" and self.down == f"{x0},{y0}":
                raise RuntimeError("down")
            by = int(w) / (int(x1) - int(x0))
            if name == "text":
                return json.dumps({"blocks": [{"text": "whole", "bbox": [0, 0, 512, 256], "lines": [{"text": "whole", "bbox": [0, 0, 512, 256]}]}]})
            if name == "blank" or prompt == "whole":
                return json.dumps({"direction": "horizontal", "blocks": [{"text": " ", "bbox": [0, 0, 1, 1]}] if name == "dots" else []})
            box = [(2500 - int(x0)) * by, (1100 - int(y0)) * by, (2700 - int(x0)) * by, (1200 - int(y0)) * by]
            side = "vertical" if int(x0) > 0 else "horizontal"
            return json.dumps({"direction": side, "blocks": [{"text": " word ", "type": "Caption", "bbox": box, "lines": [{"text": "word", "bbox": box}]}, {"text": "", "bbox": box}]})

    return Seer


def calls(folder):
    return {f: os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)}


def test_tiles_of_large_pages_without_text(spark, tmp_path):
    ocr.register("seer", provider())
    folder = tmp_path / "calls"
    folder.mkdir()
    pages = spark.createDataFrame([("j", 0, b"text", 4096, 2048), ("j", 1, b"dots", 4096, 2048), ("j", 2, b"blank", 4096, 2048), ("j", 3, b"dots", 1400, 1499), ("j", 4, b"torn", 4096, 2048)], PAGES)

    def run(n, **more):
        out = tiled.recognize_pages(str(tmp_path / "cache"), n, pages, "seer", {"folder": str(folder)} | more, "whole", "tile", cutter(), tasks=2, rpm=60000)
        return {r["page"]: r for r in out.collect()}

    got = run(1, down="0,0")
    assert {p: r["tiled"] for p, r in got.items()} == {0: False, 1: True, 2: False, 3: False, 4: True}
    assert {p: r["direction"] for p, r in got.items()} == {0: "horizontal", 1: "vertical", 2: "horizontal", 3: "horizontal", 4: "horizontal"}
    # seen at half the size, given in the page's pixels
    assert [tuple(b["bbox"]) for b in got[0]["blocks"]] == [(0, 0, 1024, 512)] and tuple(got[0]["blocks"][0]["lines"][0]["bbox"]) == (0, 0, 1024, 512)
    for page in (1, 4):
        (block,) = got[page]["blocks"]  # seen by several tiles, there once
        assert (block["text"], block["type"]) == ("word", "Caption")
        assert all(abs(a - b) < 1 for a, b in zip(block["bbox"], (2500, 1100, 2700, 1200)))
        assert all(abs(a - b) < 1 for a, b in zip(block["lines"][0]["bbox"], (2500, 1100, 2700, 1200)))
    assert got[2]["blocks"] == [] and [b["text"] for b in got[3]["blocks"]] == [" "]
    before = calls(folder)
    assert sum(k.endswith("whole") for k in before) == 5 and sum(k.startswith("blank") and k.endswith("tile") for k in before) == 4
    assert not any(k.startswith("text") and k.endswith("tile") for k in before)

    again = run(2)  # what failed is tried again, nothing else is
    more = {k: n - before.get(k, 0) for k, n in calls(folder).items() if n > before.get(k, 0)}
    assert set(more) == {f"{name}-0-0-{2048 + 409}-{1024 + 204}-tile" for name in ("dots", "blank", "torn")}
    assert {p: r["tiled"] for p, r in again.items()} == {p: r["tiled"] for p, r in got.items()}


def test_daily_limit_holds_for_pages_and_tiles(spark, tmp_path):
    ocr.register("seer", provider())
    folder = tmp_path / "calls"
    folder.mkdir()
    pages = spark.createDataFrame([("j", p, b"dots", 4096, 2048) for p in range(2)], PAGES)

    def run(n, most):
        return tiled.recognize_pages(str(tmp_path / "cache"), n, pages, "seer", {"folder": str(folder)}, "whole", "tile", cutter(), tasks=2, rpm=60000, per_day=most).collect()

    assert len(run(1, 1)) == 1 and sum(calls(folder).values()) == 1
    assert len(run(2, 4)) == 2 and sum(calls(folder).values()) == 5
    run(3, 100)
    assert sum(calls(folder).values()) == 10
    assert all(r["tiled"] for r in run(4, 0)) and sum(calls(folder).values()) == 10


def test_no_pages(spark, tmp_path):
    ocr.register("seer", provider())
    assert tiled.recognize_pages(str(tmp_path / "cache"), 1, spark.createDataFrame([], PAGES), "seer", {"folder": str(tmp_path)}, "whole", "tile", cutter(), tasks=2).count() == 0


def test_pages_are_read_and_dealt_out_once(spark):
    plan = entry.queries()["tiled_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def merged(tiles, least=0.3):
    """Blocks of the tiles of one page (tile, scale, x0, y0, direction, blocks), in plain Python."""
    kept, corners = [], lambda b: [v or 0.0 for v in b]
    for _, scale, x0, y0, _, blocks in sorted(tiles, key=lambda t: t[0]):
        by = 1 / scale if scale < 1 else 1.0
        for b in blocks or []:
            text = (b[0] or "").strip() if b else ""
            if text:
                box = [None if v is None else v * by + d for v, d in zip(b[2], (x0, y0, x0, y0))] if b[2] else [None] * 4
                if not any(text == k[0] and tiling._shared(corners(k[2]), corners(box)) >= least for k in kept):
                    kept.append((text, b[1], box))
    return kept


def test_merge_within_a_page_equals_a_plain_fold(spark):
    rng = random.Random(3)
    texts, bbox = ["a", " a", "b　", "c", " ", "", None], "struct<x0:double,y0:double,x1:double,y1:double>"
    kind = f"array<struct<text:string,type:string,bbox:{bbox},lines:array<struct<text:string,bbox:{bbox}>>>>"

    def block():
        x, y = rng.randrange(60) * 1.0, rng.randrange(60) * 1.0
        box = rng.choice([(x, y, x + rng.randrange(40), y + rng.randrange(20)), (x, y, x + 25, y + 12), (x, y, x + 24, y + 13)]) if rng.random() < 0.95 else rng.choice([None, (x, None, x + 5, y)])
        return (rng.choice(texts), rng.choice(["x", None]), box, [("l", box)]) if rng.random() < 0.98 else None

    tiles, whole = {}, []
    for page in range(60):
        own = [(tile, rng.choice([1.0, 0.5]), rng.randrange(9), rng.randrange(9), rng.choice(["vertical", "horizontal", "horizontal", None]), [block() for _ in range(rng.choice([0, 3, 80]))] if rng.random() < 0.9 else None) for tile in range(4) if rng.random() < 0.8]
        rng.shuffle(own)
        tiles[page] = own if page % 5 else [(t[0], t[1], t[2], t[3], "vertical", [(" ", None, (0.0, 0.0, 1.0, 1.0), None)]) for t in own]  # blanks alone
        whole.append((7, page, "horizontal", [("own", "x", (0.0, 0.0, 1.0, 1.0), [])]))
    rows = [(7, page, *t) for page, own in tiles.items() for t in own]
    answers = spark.createDataFrame(rows, f"doc_id long, page int, tile int, scale double, x0 int, y0 int, direction string, blocks {kind}")
    got = tiling.tiled_pages(spark.createDataFrame(whole, f"doc_id long, page int, direction string, blocks {kind}"), answers).collect()
    assert len(got) == len(whole) and sum(r["tiled"] for r in got) > 40
    for r in got:
        want = merged(tiles[r["page"]])
        assert r["tiled"] == bool(want)
        assert r["direction"] == ("vertical" if want and any(t[4] == "vertical" for t in tiles[r["page"]]) else "horizontal")
        assert [(b["text"], b["type"], list(b["bbox"])) for b in r["blocks"]] == (want or [("own", "x", [0.0, 0.0, 1.0, 1.0])])
    assert max(len(r["blocks"]) for r in got) > 3 * tiling.FEW
