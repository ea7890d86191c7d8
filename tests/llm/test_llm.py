"""The training-data operators against brute force, the libraries and exact round trips, and on awkward rows."""

import hashlib
import os
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import ann, chat, fingerprints, langid, packing, pieces, records, simhash, tokencount, tokens, toxicity
from foliospark.llm import common
from foliospark.llm.common import Scratch, by_size, default_vocabulary, discard, range_bounds, range_of, shared_folder, written
from foliospark.sources.ship import ship

SF = "/root/testdata/sf0.001"
WORDS, PIECES = default_vocabulary("word_bpe_49k.json"), default_vocabulary("piece_bpe_32k.model")
LONG = "Und sichs Wort, " * 40_000
AWKWARD = [None, "", " \t\n", "...", "é", "Ab c", "Ab c", "a  b ▁ c\n\nd", "<|endoftext|> x", "日本語 😀\x00", "it's  ſtra\x1cße İx ΣΑΣ", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and very long texts, a null id, an id twice, and columns with names that operators use inside."""
    ship(spark)
    rows = [(i, t, "en", i) for i, t in enumerate(AWKWARD)] + [(None, "no id", None, 1), (5, "Ab c", "en", 2), (5, "other text", "de", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, part int")
    return df.withColumns({c: F.lit(1) for c in ("fp", "n", "key", "piece", "open", "id", "score", "hash", "__folio_id")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def word_ids(text):
    from tokenizers import Tokenizer

    own = word_ids.__dict__.setdefault("t", Tokenizer.from_file(WORDS))
    return own.encode(text, add_special_tokens=False).ids


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def key(r):
    return (r is not None, r or 0)


# 1


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_records_round_trip(request, table):
    df = request.getfixturevalue(table)
    got = records.token_records(df, WORDS, 1).collect()
    want, start = [], 0
    for doc_id, text in sorted(texts_of(df), key=lambda r: (key(r[0]), r[1].encode())):
        ids = word_ids(text) + [1]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


def test_records_empty_table_random_access_and_damage(spark, empty, docs, tmp_path):
    assert records.token_records(empty, WORDS).count() == 0
    path = f"file://{tmp_path}"
    manifest = records.write_records(docs, path, open(WORDS, "rb").read(), 1, parts=3)
    doc_id, ids = records.record_at(path, manifest[1]["part"], 4)
    text = docs.filter(F.col("doc_id") == doc_id).first()["text"]
    assert np.frombuffer(ids, "<u4").tolist() == word_ids(text) + [1]
    file = next(tmp_path.glob("*.rec"))
    data = bytearray(file.read_bytes())
    data[40] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="CorruptRecord"):
        records.read_records(spark, path, manifest).collect()
    for at in (0, 9, 13, len(records.frame(b"abc")) - 1):
        broken = bytearray(records.frame(b"abc"))
        broken[at] ^= 4
        with pytest.raises(records.CorruptRecord):
            records.unframe(bytes(broken))


def test_records_paths(spark, tmp_path, monkeypatch):
    assert records.worker_path(spark, str(tmp_path)) == records.worker_path(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    with pytest.raises(Exception, match="No FileSystem|workers have no file system"):
        records.worker_path(spark, "ftpx://host/a")

    class Cluster:
        def __init__(self, shared):
            self.sparkContext = type("Context", (), {"_jvm": spark.sparkContext._jvm, "master": "spark://host:1", "getCheckpointDir": lambda self: None})()
            self._jsparkSession, self.conf = spark._jsparkSession, type("Conf", (), {"get": lambda self, key, other=None: shared})()

    with pytest.raises(ValueError, match="one machine"):
        records.worker_path(Cluster(None), str(tmp_path))
    assert records.worker_path(Cluster(f"file://{tmp_path}/shared"), f"{tmp_path}/shared/x") == f"file://{tmp_path}/shared/x"
    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(Cluster(None), "x")


def test_tables_are_deleted(spark, tmp_path):
    with Scratch() as scratch:
        gone, kept = written(spark.range(3), "gone"), scratch.keep(written(spark.range(4), "kept"))
        discard(gone)
        discard(gone)
        other = written(spark.range(5), "other")
    exists = [os.path.exists(x.written_to.removeprefix("file://")) for x in (gone, kept, other)]
    assert exists == [False, True, False] and kept.count() == 4


@pytest.mark.parametrize("heavy, least", [(10_000, 64), (3, 1), (1, 1)])
def test_join_by_size(spark, monkeypatch, heavy, least):
    monkeypatch.setattr(common, "HEAVY_KEYS", heavy)
    monkeypatch.setattr(common, "LEAST_HEAVY", least)
    rows = spark.createDataFrame([(min(i, 40) % 7, i) for i in range(200)], "k int, x int")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most"))
    got = sorted(map(tuple, by_size(rows, sizes, "k", 200).select("k", "x", "n", "most").collect()))
    assert got == sorted(map(tuple, rows.join(sizes, "k").select("k", "x", "n", "most").collect())) and len(got) == 200


def test_ranges_keep_order(spark):
    df = spark.createDataFrame([(i * i,) for i in range(200)] + [(None,)], "v long")
    bounds = range_bounds(df, "v", 12)
    got = df.select("v", range_of(F.col("v"), bounds).alias("p")).collect()
    assert all(r["p"] == sum(b <= r["v"] for b in bounds) if r["v"] is not None else r["p"] == 0 for r in got)


# 2


def test_chat_escapes_and_parses():
    random.seed(1)
    alphabet = ["\\", "### ", "</turn>", "\n", ": ", "a", "<|", "|>", "<|image:0|>", "é"]
    turns = [("".join(random.choices(alphabet, k=3)), "".join(random.choices(alphabet, k=8))) for _ in range(300)]
    whole = "".join(chat.format_turn(r, [chat.Text(t)])[0] for r, t in turns)
    assert [(r, "".join(t for _, t in s)) for r, s in chat.parse(whole)] == turns
    with pytest.raises(ValueError):
        list(chat.parse("### user: cut"))


def test_chat_parts_become_placeholders(spark):
    formatted, begin, end, attached = chat.format_turn("user", [chat.Text("see <|image:0|> "), chat.Image("a.png", 1000, 512), chat.Audio("b.wav", 1.5), chat.Document("c.pdf", 3)])
    assert formatted[begin:end] == "see \\<|image:0|> <|image:0|><|audio:1|><|document:2|>"
    assert attached == [(0, "image", "a.png", 512), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1800)]
    assert list(chat.parse(formatted)) == [("user", [("text", "see <|image:0|> "), ("image", "0"), ("audio", "1"), ("document", "2")])]
    with pytest.raises(TypeError):
        chat.format_turn("user", [object()])
    df = spark.createDataFrame([(1, 0, "user", [("text", "x", None), ("image", None, "p")])], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string>>")
    r = chat.format_turns(df, parts_column="parts").first()
    assert r["expanded_tokens"] == 256 and [a["ref"] for a in r["attachments"]] == ["p"]


def test_chat_parts_are_written_and_read_back(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [
        (1, 0, "user", [text("look: <|image:0|> "), ("image", None, "a.png", 1024, 600, None, None), text("\\ and"), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 1, "assistant", [text("fine "), ("document", None, "c.pdf", None, None, None, 4), text("<|audio:7|></turn>")]),
        (2, 0, "assistant", None),
        (3, 0, "assistant", [("image", None, None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    turns = chat.write_turns(chat.format_turns(df, parts_column="parts"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(turns).collect()}
    assert (got[1]["expanded_tokens"], got[1]["n_attachments"]) == (4 * 256 + 63 + 2400, 3)
    learned = "fine <|audio:7|></turn>"
    assert got[1]["loss_chars"] == len(learned) and got[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    whole = "user\nlook: <|image:0|> \\ and\nassistant\n" + learned + "\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[2]["loss_chars"] == got[3]["loss_chars"] == 0 and got[3]["expanded_tokens"] == 256
    kinds = [[(a["number"], a["kind"], a["ref"]) for a in r["attachments"]] for r in turns.orderBy("conv_id", "turn").collect()]
    assert kinds == [[(0, "image", "a.png"), (1, "audio", "b.wav")], [(0, "document", "c.pdf")], [], [(0, "image", "")]]


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "z"), (1, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"zz").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nx\nassistant\n\nassistant\nz\nassistant\nz\n").hexdigest() and got[None]["loss_chars"] == 1
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


# 3


def neighbours(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            own = sorted(((-float((v * w).sum()), j) for j, w in good if j != i))[:k]
            out[i] = [j for _, j in own]
    return out


def test_neighbours_small_table_is_exact(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, list(rows[20][1])) for i in range(30)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (500, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("list", F.lit(2)).repartition(3)
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, exact=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is None or len(r["embedding"]) == 8]
    assert {q: [v[i] for i in range(1, len(v) + 1)] for q, v in got.items()} == neighbours(stored, 20)
    probed = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).collect():
        probed.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(x) == 20 for x in probed.values()) and np.mean([len(probed[q] & set(got[q].values())) / 20 for q in got]) >= 0.9
    few = ann.nearest_neighbours(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 4 and ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall_with_probes(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    v = np.concatenate([centers[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16)), centers[:1] + 0.01 * rng.standard_normal((800, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = neighbours(rows, 20)
    assert all(len(x) == 20 for x in got.values()) and len(got) == len(want)
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("n, copies", [(300, 60), (3000, 1500)])
def test_neighbours_of_repeated_ids(spark, n, copies):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((n, 8))
    hot = 3 * v[20] / np.linalg.norm(v[20])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n + 1, hot.tolist())] * copies + [(n + 2, (hot + 0.01 * i).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = {}, {}
    for r in ann.nearest_neighbours(df, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < n), 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, n, 20):
        best = {}
        for i, s in zip((i for i, _ in rows), np.array([x for _, x in rows]) @ v[q]):
            best[i] = max(s, best.get(i, -np.inf))
        want[q] = sorted((i for i in best if i != q), key=lambda i: (-best[i], i))[:20]
    assert got.keys() == want.keys() and all(sorted(x) == list(range(1, 21)) and len(set(x.values())) == 20 for x in got.values())
    assert np.mean([len(set(got[q].values()) & set(w)) / 20 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("equal", [True, False])
def test_neighbours_of_ids_with_many_rows(spark, equal):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((200, 8))
    rows = [(i, (x if equal else x + 0.3 * rng.standard_normal(8)).tolist()) for i, x in enumerate(v) for _ in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    own, sums = {}, {}
    for i, x in rows:
        own.setdefault(i, []).append(x)
    for q in range(0, 200, 20):
        best = {i: (np.array(x) @ np.array(own[q]).T).max() for i, x in own.items() if i != q}
        sums[q] = sorted(best, key=lambda i: (-best[i], i))[:20]
    for exact in (True, False):
        got = {}
        for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, exact=exact).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        got = {q: [x[i] for i in range(1, 21)] for q, x in got.items()}
        assert got == sums if exact else np.mean([len(set(got[q]) & set(sums[q])) / 20 for q in sums]) >= 0.9


# 4


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_fingerprints_of_edits(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(texts_of(df), key=lambda r: (key(r[0]), r[1].encode()))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = (fingerprints.text_vector(x) for x in (text, edited, following))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encode(a), fingerprints.encode(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = fingerprints.compare_with_edit(df).collect()
    order = lambda r: (key(r[0]), r[2], r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def plain_vector(text):
    """The vector lane by lane: SHAKE-128 of each paragraph, and a sum of signs over its shingles of three words."""
    import xxhash

    total = [0] * (fingerprints.IDENTITY + fingerprints.SIGNS)
    for paragraph in text.split("\n"):
        digest = hashlib.shake_128(b"\x01" + paragraph.encode()).digest(2 * fingerprints.IDENTITY)
        for k in range(fingerprints.IDENTITY):
            total[k] = (total[k] + digest[2 * k] + 256 * digest[2 * k + 1]) % 65536
        words = [w[i : i + 16] for w in paragraph.split() for i in range(0, len(w), 16)]
        if len(words) >= 3:
            units = [" ".join(words[i : i + 3]).encode() for i in range(len(words) - 2)]
        else:
            units = [" ".join(words).encode() if words else b"\x02" + paragraph.encode()]
        for unit in units:
            for m, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
                h = xxhash.xxh3_64_intdigest(unit) * factor % 2**64
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                h ^= h >> 32
                for b, byte in enumerate(h.to_bytes(8, "little")):
                    for place in range(8):
                        sign = 1 if byte >> 7 - place & 1 else -1
                        at = fingerprints.IDENTITY + 64 * m + 8 * b + place
                        total[at] = (total[at] + sign) % 65536
    return total


def test_fingerprints_equal_plain_sums_and_exact_likeness(docs, odd):
    from collections import Counter

    texts = [r["text"] or "" for r in docs.limit(60).collect()] + [r["text"] for r in odd.collect() if r["text"] and r["text"] != LONG]
    for text in texts[::4] + texts[-6:]:
        assert fingerprints.text_vector(text).tolist() == plain_vector(text)
    same = {}
    for text in texts:
        same.setdefault(fingerprints.encode(fingerprints.text_vector(text)), set()).add(tuple(sorted(text.split("\n"))))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({tuple(sorted(t.split("\n"))) for t in texts})
    errors = []
    for a, b in zip(texts, texts[1:] + texts[:1]):
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        for other in (edited, b):
            x, y = (Counter(u for p in t.split("\n") for u in fingerprints._units(p)) for t in (a, other))
            exact = 1 - sum((x[u] - y[u]) ** 2 for u in x | y) / (sum(n * n for n in x.values()) + sum(n * n for n in y.values()))
            errors.append(abs(max(0.0, exact) - fingerprints.likeness(fingerprints.text_vector(a), fingerprints.text_vector(other))))
    assert np.quantile(errors, 0.95) < 0.2 and np.mean(errors) < 0.07  # 256 signs: a standard deviation of at most 1 / 11


def test_fingerprints_are_multisets(empty, odd):
    f = lambda t: fingerprints.encode(fingerprints.text_vector(t))
    assert f("a b\nc\nd e f") == f("d e f\na b\nc") != f("d e f\na b")
    assert fingerprints.insert(f("x y"), ["z w", ""]) == f("x y\nz w\n") and fingerprints.delete(f("x\ny\nx"), ["x"]) == f("x\ny")
    assert f("a\na") != f("a") and fingerprints.compare_with_edit(empty).count() == 0
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    text = " ".join(f"w{i}" for i in range(400))
    near = fingerprints.likeness(fingerprints.text_vector(text), fingerprints.text_vector(text[:-200] + " other words here"))
    far = fingerprints.likeness(fingerprints.text_vector(text), fingerprints.text_vector(text[::-1]))
    assert near > 0.7 and far < 0.3


# 5


def test_pieces_are_the_librarys(docs, odd):
    own, lib = pieces.Pieces(open(PIECES, "rb").read()), library()
    random.seed(2)
    texts = [t for t in AWKWARD if t is not None] + ["".join(random.choices("abe ▁éß漢\n.,1\t", k=random.randint(0, 40))) for _ in range(400)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")
    for df in (docs, odd):
        want = sorted((key(i), len(lib.encode(t)), crc(lib.encode(t))) for i, t in texts_of(df))
        got = pieces.round_trip(df, PIECES).collect()
        assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want and all(r["restored"] for r in got)
    back = {(key(r["doc_id"]), r["text"]) for r in pieces.decode_documents(pieces.encode_documents(odd, PIECES), PIECES).collect()}
    assert back == {(key(i), t.replace("▁", " ")) for i, t in texts_of(odd)} and pieces.round_trip(odd.limit(0), PIECES).count() == 0


def test_pieces_of_very_long_words():
    """Runs of spaces and unbroken words cost about their length, and give the library's ids."""
    import time

    own, lib = pieces.Pieces(open(PIECES, "rb").read()), library()
    random.seed(13)
    syllables = ["on", "the", "er", "ing", "ou", "ß", "ción", "x", "7", "漢", "éa", "st", "ent", "ation", "QZ"]
    letters = "".join(random.choices(syllables, k=40_000))[:100_000]
    words = [" " * 100_000, letters, "a" * 100_000, "ab" * 50_000, "x" + " " * 30_000 + "y" * 30_000, "".join(random.choices("eationrsh", k=100_000)), "ha" * 300 + "漢" * 700, "_" * 5000 + "-" * 5000, "=" * 3001]
    for n in (255, 256, 257, 400, 416, 417, 900, 3000):
        words += [letters[n : 2 * n], "".join(random.choices("eationrsh .", k=n))]
    begin = time.monotonic()
    got = own.encode(words)
    assert time.monotonic() - begin < 60
    for word, ids in zip(words, got):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(word), word[:50]
        assert own.decode(ids) == word


def test_unigram_viterbi_is_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PIECES, "rb").read())
    spec.trainer_spec.model_type = 1
    for i, p in enumerate(spec.pieces):  # scores as of a unigram model, no two sums alike
        if p.type == 1:
            p.score = -5 - (i % 7919) / 1000 - i / 1e5
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString()), pieces.Pieces(spec.SerializeToString())
    score = lambda ids: sum(lib.get_score(i) for i in ids)
    for word in ("thntion", "Ouwhea", "ciónmente", "heitzukeit", "a漢b😀", "x" * 50, "straße"):
        got, want = np.frombuffer(own.encode([word])[0], "<u4").tolist(), lib.encode(word)
        assert got == want or abs(score(got) - score(want)) < 1e-3


# 6


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_packing_is_whole(request, table):
    df = request.getfixturevalue(table)
    got = packing.pack_documents(df, WORDS, 1, 512, open_bins=8).collect()
    want = []
    for doc_id, text in texts_of(df):
        ids = word_ids(text) + [1]
        want += [(key(doc_id), p, a, len(ids[a : a + 512]), crc(ids[a : a + 512])) for p, a in enumerate(range(0, len(ids), 512))]
    assert sorted((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 512) * 1.05 + 1


def test_best_fit_and_empty(empty):
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 8, 3)] == [0, 1, 2, 0]  # the bin of seven, the fullest, was closed
    with pytest.raises(ValueError):
        bins.place(11)
    assert packing.pack_documents(empty, WORDS).count() == 0


# 7


def brute(rows):
    ids = [(i, simhash.fingerprint(t)) for i, t in rows]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(ids[a][1] ^ ids[b][1]).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((key(i), f"{f:016x}", key(least.get(find(x)))) for x, (i, f) in enumerate(ids))


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(odd, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for _, text in rows[:60]:
            assert simhash.fingerprint(text) == (plain_fingerprint(text) if text is not LONG else simhash.fingerprint(text))
        got = simhash.near_duplicates(df).collect()
        assert sorted((key(r["doc_id"]), r["fingerprint"], key(r["component_id"])) for r in got) == brute(rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_large_buckets(spark):
    random.seed(4)
    seeds = [random.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for s in seeds for _ in range(30)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    for bucket in (8192, 16):  # the second cuts buckets into chunks
        got = {}
        for r in simhash.components(simhash.fingerprint_links(df, bucket)).collect():
            got.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
        assert sorted(sorted(g) for g in got.values()) == want


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_simhash_keeps_one(spark, odd):
    kept = simhash.keep_one(odd).collect()
    assert len(kept) == len({shingles(r["text"]) for r in odd.collect()}) == len({shingles(r["text"]) for r in kept})
    assert kept[0].__fields__ == odd.columns and simhash.keep_one(odd.limit(0)).count() == 0
    random.seed(5)
    word = lambda: f"w{random.randrange(3000)}"
    passage, rows = [word() for _ in range(60)], []
    for group in range(30):  # a text, near copies of it, a text that only shares a passage with all others, one that shares half
        text = [word() for _ in range(300)]
        rows += [text, *[[word() if random.random() < 0.01 else w for w in text] for _ in range(4)]]
        rows += [[word() for _ in range(240)] + passage, text[:150] + [word() for _ in range(150)]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    sets = [shingles(" ".join(t)) for t in rows]
    want = stars_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert set(want) - {7 * g + k for g in range(30) for k in (0, 5, 6)} == {44, 116}  # copies that chance made less alike than 0.8
    assert sorted(r["doc_id"] for r in simhash.keep_one(table).collect()) == sorted(set(want))


def test_simhash_keeps_one_of_repeated_rows(spark):
    """Rows that hold a large share of the table, ids that come twice with one text or with two, null ids."""
    words = lambda i: " ".join(f"w{i * 40 + k}" for k in range(40))
    rows = [(i, words(i)) for i in range(200)] + [(i, words(i)) for i in range(0, 60, 2)] + [(7, words(7))] * 300
    rows += [(None, words(900))] * 200 + [(None, None)] * 150 + [(300, words(7))] * 120 + [(5, words(901))] * 2 + [(None, words(902))]
    df = spark.createDataFrame([(*r, {"a": 1}) for r in rows], "doc_id long, text string, other map<string,int>").repartition(5)
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    want = {(i, words(i)) for i in range(200)} | {(None, words(900)), (None, None), (5, words(901)), (None, words(902))}
    assert len(got) == len(want) and set(got) == want
    plain = df.filter("doc_id < 4 and doc_id % 2 = 1")
    assert sorted(r["doc_id"] for r in simhash.keep_one(plain).collect()) == [1, 3]


def test_simhash_keeps_one_by_exact_likeness(spark):
    random.seed(8)
    word, rows = lambda: f"w{random.randrange(5000)}", []
    for group in range(40):  # copies alike by 0.65 to 0.95
        text = [word() for _ in range(200)]
        rows += [text, *[[word() if random.random() < share else w for w in text] for share in (0.01, 0.02, 0.025, 0.03, 0.035, 0.04)]]
    for group in range(20):  # four shingles of five
        text = [word() for _ in range(9)]
        rows += [text, text[:-1]]
    sets, root = [shingles(" ".join(t)) for t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    likely = [(jaccard(a, b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if not a.isdisjoint(b)]
    for like, i, j in likely:
        if like >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert sum(0.7 < x < 0.8 for x, _, _ in likely) > 100
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(table).collect()) == sorted({find(i) for i in range(len(rows))})


@pytest.mark.parametrize("bucket, block, few", [(2048, 16, 0), (2048, 1024, 32), (2048, 16, 32), (16, 8, 2)])
def test_simhash_likeness_components_equal_brute_force(spark, docs, bucket, block, few):
    """Small buckets and blocks take the ways of large groups: whole buckets as candidates, chunks with hubs, pairs of chunks."""
    rng = random.Random(6)
    texts = [r["text"] for r in docs.collect()] + ["a b", "a b", "", None]
    text = [f"w{rng.randrange(9)}{i}" for i in range(400)]
    texts += [" ".join(text[:i] + text[i + 1 :]) for i in range(0, 400, 5)]  # a large group of near copies
    loose = [f"v{i}" for i in range(200)]
    texts += [" ".join(w if rng.random() > 0.02 else f"z{rng.randrange(9999)}" for w in loose) for _ in range(120)]  # one that links in part
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = df.withColumn("hash", F.xxhash64("text")).select("doc_id", "hash", "text")
    least = simhash.with_likeness(rows, "text", "doc_id long, hash long").withColumn("node", F.col("doc_id") + 1000)
    least = least.withColumn("first", F.struct(F.lit(False).alias("none"), "doc_id", "hash"))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard(a, b) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["node"] - 1000: r["root"] - 1000 for r in simhash.alike_components(least, rows, bucket, block, few).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert len({find(i) for i in range(len(texts) - 120, len(texts))}) > 1


def test_simhash_star_and_bucket_with_a_large_share(spark):
    """No key of a join has more than a bounded share of the rows, whatever its degree."""
    star = spark.range(1, 200_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(300_000, 300_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(star.unionByName(chain)).groupBy("root").count().collect()
    assert sorted((r["root"], r["count"]) for r in got) == [(0, 200_001), (300_000, 41)]
    rng = np.random.default_rng(3)  # all agree in two blocks of bits, some link
    fps = (rng.integers(0, 1 << 38, 4000).astype(np.uint64) << np.uint64(26)) | np.uint64(5)
    fps = np.unique(np.concatenate((fps, fps[:500] ^ np.uint64(1 << 40 | 1 << 50 | 1 << 3))))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    close = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist()]
    assert len(close) >= 500
    want = stars_of(len(fps), close)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_links(df, 64)).collect()}
    signed = fps.view(np.int64).tolist()
    groups, expected = {}, {}
    for i, f in enumerate(signed):
        groups.setdefault(got.get(f, f), set()).add(f)
        expected.setdefault(want[i], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def stars_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("radius", [8, 31, 93, 178])
def test_close_likenesses(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (3, 16), np.uint64).repeat(70, 0)
    flips = np.packbits(rng.random((210, 1024)) < radius / 2048, axis=1).view(np.uint64)
    fps, sizes = base ^ flips, np.array([120, 60, 30])
    pairs = {(int(i), int(j)) for own in simhash.close_likenesses(fps, sizes, radius, -np.arange(210) - 1) for i, j in zip(*own)}
    group, first = np.repeat([0, 1, 2], sizes), np.repeat([0, 120, 180], sizes)
    close = {(i, j) for i in range(210) for j in range(i + 1, 210) if group[i] == group[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius}
    near = np.array([np.bitwise_count(fps[i] ^ fps[first[i]]).sum() <= radius for i in range(210)])
    assert close and pairs == {(i, j) for i, j in close if not (near[i] and near[j])}  # the others are connected beforehand


# 8


def test_language(docs, odd, empty):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.95
    strange = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [strange[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in strange.values())
    assert langid.identify(empty, model).count() == 0 and {r["lang_pred"] for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("text is null or text = '...'").count() == 0


def plain_grams(text):
    """Letters of lower case, one space for what is between them and at the ends; all runs of one to three of these."""
    own = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    own = " " + " ".join(own.split(" ")).strip() + " " if own.strip() else ""
    while "  " in own:
        own = own.replace("  ", " ")
    return [own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def test_language_equals_plain_naive_bayes(docs, odd, monkeypatch):
    model = langid.train(docs)
    rows = docs.collect()
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"]]
    languages, bucket_of = sorted({r["lang"] for r in learned}), {}

    def bucket(gram):
        if gram not in bucket_of:
            value = 0
            for n, c in enumerate(gram, 1):
                value = (value * 1_000_003 + ord(c) + n) % 2**64
            value = value * int(langid._MULTIPLIER) % 2**64
            bucket_of[gram] = ((value ^ value >> 29) * int(langid._MULTIPLIER) % 2**64) >> 64 - 15
        return bucket_of[gram]

    counts = np.zeros((langid.BUCKETS, len(languages)))
    for r in learned:
        for g in plain_grams(r["text"] or ""):
            counts[bucket(g), languages.index(r["lang"])] += 1
    matrix = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * langid.BUCKETS))
    prior = np.log(np.array([sum(r["lang"] == x for r in learned) for x in languages]) / len(learned))
    assert model.languages == languages and np.allclose(model.matrix, matrix, atol=1e-5)
    texts = [r["text"] for r in rows] + [t for t in AWKWARD if t is not LONG] + [LONG[:3000]]
    for slice_size in (langid.TEXT_SLICE, 50):  # the second cuts texts in many windows
        monkeypatch.setattr(langid, "TEXT_SLICE", slice_size)
        some = texts if slice_size > 50 else texts[::9]
        for text, lang, score in zip(some, *model.score(some)):
            own = [bucket(g) for g in plain_grams(text or "")]
            if slice_size == 50 and text and len(text.lower()) != len(text):
                continue
            if not own:
                assert (lang, score) == ("und", 0.0)
                continue
            logs = prior + matrix[own].sum(axis=0) * min(1, 256 / len(own))
            chance = np.exp(logs - logs.max())
            assert lang == languages[int(chance.argmax())] and abs(score - chance.max() / chance.sum()) < 1e-3


def test_language_with_many_languages(spark):
    rows = [(i, f"w{i % 700} ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xyz{chr(97 + i // 676)}", f"l{i % 700:03d}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 700
    got = langid.identify(df, model).collect()
    assert len(got) == 1400 and sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) > 700


# 9


def test_toxicity(spark, odd, empty):
    docs, labels = (ship(spark).read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    chain = toxicity.fit(docs, fitted, toxicity.label_categories())
    assert chain.categories == ["low_quality", "toxic"] and len(chain.models[1].chain) == 1
    got = toxicity.score(docs, chain).join(labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 0), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"] and r["lang"] == "en"], [r for r in got if not r["toxic"]]
    assert sum(r["is_toxic"] for r in toxic) >= 0.7 * len(toxic) and sum(r["is_toxic"] for r in clean) <= 0.02 * len(clean)
    assert toxicity.score(odd, chain).count() == odd.count() and toxicity.score(empty, chain).count() == 0
    kept = toxicity.keep_clean(odd, chain)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    nobody = toxicity.fit(docs, labels.limit(0), toxicity.label_categories())
    assert toxicity.score(odd, nobody).filter("is_toxic").count() == 0


def test_toxicity_trains_on_one_row_an_id(spark, odd, empty):
    docs = spark.createDataFrame([(i, f"word{i % 7} bad{i % 2} x") for i in range(60)] + [(3, f"again {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 60, 1, i % 2) for i in range(90)] + [(None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    names = {"id_column": "doc_id", "text_column": "text", "label_id": "doc_id"}
    rows = toxicity.training_rows(docs, labels, toxicity.label_categories(), 5, **names).collect()
    assert len(rows) == 5 and len({r["id"] for r in rows}) == 5
    assert toxicity.training_rows(docs, labels, toxicity.label_categories(), 1000, **names).count() == 60
    chain = toxicity.fit(empty.select("doc_id", "text"), labels, toxicity.label_categories())
    assert toxicity.score(odd, chain).filter("is_toxic").count() == 0


def test_toxicity_chain_equals_plain_numpy(spark):
    """The whole chain with out-of-fold probabilities, dense and on one machine."""
    random.seed(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(400):
        low, bad = i % 3 == 0, i % 5 == 0
        text = random.choices(words, k=30) + ["zlow"] * (low and random.random() < 0.8) + ["zbad"] * (bad and random.random() < 0.9)
        rows.append((i, " ".join(text), int(not low), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(3)
    chain = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), toxicity.label_categories())
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(df, chain).collect()}
    fold = np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS for i in range(400)])
    x = np.zeros((400, toxicity.BUCKETS), np.float32)
    for i, (_, text, _, _) in enumerate(rows):
        b, v = toxicity.features(text)
        x[i, b] = v
    ys, before, after = [np.array([r[2] == 0 for r in rows], float), np.array([r[3] for r in rows], float)], np.zeros((400, 0)), np.zeros((400, 0))
    for c, y in enumerate(ys):
        def fitted(inside):
            own, label = x[inside].astype(float), y[inside]
            n = np.array([(label == 0).sum(), (label == 1).sum()])
            sums = np.stack([own[label == 0].sum(axis=0), own[label == 1].sum(axis=0)], axis=1)
            t = toxicity.telling(n, sums, (own * own).sum(axis=0), (own > 0).sum(axis=0))
            at = toxicity.chosen(t)
            row, bucket = np.nonzero(own)
            return toxicity.fit_linear(row, bucket, own[row, bucket], before[inside], label, (at, t[at]))

        def probability(model, chain):
            return 1 / (1 + np.exp(-(x[:, model.buckets].astype(float) @ model.weights + chain @ model.chain + model.bias)))

        held = np.zeros(400)
        for f in range(toxicity.FOLDS):  # no row's probability comes from a model that has seen it
            held[fold == f] = probability(fitted(fold != f), before)[fold == f]
        final = probability(fitted(np.ones(400, bool)), after)
        assert np.allclose([got[i][c] for i in range(400)], final, atol=2e-3)
        assert abs(chain.thresholds[c] - toxicity.threshold(held, y)) < 5e-3
        before, after = np.column_stack((before, held)), np.column_stack((after, final))
    caught = [got[i][1] > chain.thresholds[1] for i in range(400) if "zbad" in rows[i][1]]
    assert sum(caught) >= 0.9 * len(caught)


def test_toxicity_held_out_in_all_languages(spark):
    docs, labels = (ship(spark).read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    chain = toxicity.fit(docs, labels.filter(third != 0), toxicity.label_categories())
    held = labels.filter(third == 0).join(docs.select("doc_id", "lang"), "doc_id")
    rows = docs.join(held.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    got = {}
    for r in toxicity.score(rows, chain).join(held, "doc_id").collect():
        got.setdefault((r["toxic"], r["lang"]), []).append(r["is_toxic"])
    toxic = {lang: (sum(x), len(x)) for (own, lang), x in got.items() if own}
    clean = [r for (own, _), x in got.items() if not own for r in x]
    print(toxic, sum(clean), len(clean))
    assert len(toxic) == 4 and all(n >= 0.7 * of for n, of in toxic.values()) and sum(n for n, _ in toxic.values()) >= 0.85 * sum(of for _, of in toxic.values())
    assert sum(clean) <= 0.02 * len(clean)


# 10


@pytest.mark.parametrize("path", [PIECES, WORDS, default_vocabulary("byte_bpe_50k.json")])
def test_token_counts(docs, odd, empty, path):
    if path == PIECES:
        lib = library()
        n = lambda t: len(lib.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        n = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    for df in (docs, odd):
        want = sorted((key(i), len(t.encode()), n(t), n(t) > 4096) for i, t in texts_of(df))
        assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(df, path).collect()) == want
    assert tokencount.count_tokens(empty, path).count() == 0


def test_length_table_finds_its_keys_alone():
    rng = np.random.default_rng(5)
    keys = {bytes(rng.integers(0, 4, int(n), "u1")): i % 30 for i, n in enumerate(rng.integers(1, 33, 5_000))}
    table, others = tokencount.LengthTable(keys), [k + b"\0" for k in keys if len(k) < 32 and k + b"\0" not in keys]
    asked = [*keys, *others]
    raw = np.frombuffer(b"".join(asked) + bytes(48 - sum(map(len, asked)) % 8), "<u8")
    sizes = np.array([len(k) for k in asked])
    found = table.find(tokencount._leading_words(raw, np.cumsum(sizes) - sizes, sizes), sizes)
    assert found.tolist() == [*keys.values(), *[-1] * len(others)]
    assert tokencount.LengthTable({}).find(np.zeros((2, 4), "u8"), np.array([1, 2])).tolist() == [-1, -1]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_spans_are_the_patterns(monkeypatch, block):
    monkeypatch.setattr(tokencount, "BLOCK_BYTES", block)
    texts = ["", " ", "a", "  b c\n\n d▁ é \n", "", "\n", "x" * 40 + "  ", "\tk\r\n", ""]
    for path in (PIECES, WORDS):
        with open(path, "rb") as f:
            own = tokencount.counting(f.read())
        got = [[] for _ in texts]
        for raw, starts, ends, of in own.spans([own.plain(t) for t in texts]):
            for a, b, i in zip(starts, ends, of):
                got[i].append(raw[a:b])
        if own.pieces:
            want = [[w.replace("▁", " ").encode() for w in tokencount._PRE_TOKEN.findall("▁" + t.replace(" ", "▁"))] if t else [] for t in texts]
        else:
            want = [tokens.words_of(t) for t in texts]
        assert got == want
        assert own.count(texts, tokencount.LengthTable({})) == own.count(texts, tokencount.LengthTable({w: own.length(w) for ws in want for w in ws if len(w) <= 32}))


def test_word_cache_of_two_generations():
    own = tokens.WordCache(str.upper, 3)
    assert [own[w] for w in "abcabcdea"] == list("ABCABCDEA") and len(own) <= 3


# pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, names = ship(spark).read.parquet(f"{sf}/documents.parquet"), None
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before
        sizes.append(docs.count())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8]
    got = corpus_pipeline.run(spark, sf).collect()
    want = [(i, crc(word_ids(t) + [1])) for i, t in rows if len(word_ids(t)) < 4096]
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got if r["piece"] == 0 and r["start"] == 0 and r["length"] < 4096) == sorted(want)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
