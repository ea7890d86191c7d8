"""Conversation repair, license scans and the filter audit against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.llm import entry, filter_audit, licenses, repair
from foliospark.sources.ship import ship

# --- conversation repair


def exhaustive(codes):
    """The least (cost, audit) over every way to edit each turn, with up to two inserted turns in each gap."""
    found = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=len(codes)):
        cost, ok = 0, True
        for e, c in zip(edits, codes):
            ok &= not (c == "x" and e != "D") and not (e == "K" and c.lower() not in "sua")
            cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and c.isupper())
        if not ok:
            continue
        for inserted in itertools.product(gaps, repeat=len(codes) + 1):
            audit = inserted[0] + "".join(e + g for e, g in zip(edits, inserted[1:]))
            kept, at = [], 0
            for e in audit:
                if e == "I":
                    kept.append("?")
                    continue
                if e != "D":
                    kept.append(codes[at].lower() if e == "K" else "?")
                at += 1
            body = kept[1:] if kept[:1] == ["s"] else kept
            fits = not kept or (body and len(body) % 2 == 0 and all(k in ("?", "ua"[i % 2]) for i, k in enumerate(body)))
            if fits:
                own = (cost + 5 * audit.count("I"), audit)
                found = own if found is None else min(found, own)
    return found


def test_matrices_equal_exhaustive_search():
    rng = random.Random(3)
    some = ["".join(c) for n in (0, 1, 2) for c in itertools.product("xsuaoSUAO", repeat=n)] + ["".join(rng.choices("xsuaoSUAO", k=n)) for n in (3, 3, 4) for _ in range(40)]
    for codes in some:
        assert repair.best(repair.product(codes)) == exhaustive(codes), codes


def test_product_is_associative():
    rng = random.Random(5)
    for _ in range(200):
        codes = "".join(rng.choices("xsuaoSUAO", k=rng.randint(3, 40)))
        i, j = sorted(rng.sample(range(1, len(codes)), 2))
        a, b, c = repair.product(codes[:i]), repair.product(codes[i:j]), repair.product(codes[j:])
        left, right = repair.times(repair.times(a, b), c), repair.times(a, repair.times(b, c))
        assert left == right == repair.product(codes)


def conversations():
    rng = random.Random(7)
    words = ["Yes.", "No", "", " \t", "Why?", "x. ", "é!", None, "ok\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(words) or None) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(1000, t, "ua"[t % 2] == "u" and "user" or "assistant", f"line {t % 400}.") for t in range(3000)]
    rows += [(1001, 5, "user", "same.")] * 40 + [(1002, None, "user", "a."), (1002, None, "assistant", "b."), (1002, 3, "user", "c")]
    rows += [(None, 1, "user", "q?"), (None, 2, "user", "r."), (2000, None, None, None)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def compare_with_sql(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS + ", part string").repartition(5)
    got = sorted((tuple(r) for r in repair.repair_digest(df, repair.damaged(df)).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = sorted(con.sql(entry.OP11_SQL).fetchall(), key=str)
    assert got == want
    return got


def test_repair_equals_sql_on_odd_rows(spark):
    got = {r[0]: r for r in compare_with_sql(ship(spark), conversations())}
    assert got[1000][3] > 2000 and got[None]


def test_long_conversations_are_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 7)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = [r for r in conversations() if r[0] in (1, 2, 1000, 1001, None)]
    compare_with_sql(ship(spark), rows)


def test_repaired_turns_have_the_digest(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 5)
    df = ship(spark).createDataFrame([r for r in conversations() if r[0] != 1000 and r[0] is not None], COLUMNS)
    cut = repair.segments(repair.damaged(df))
    found = repair.repairs(cut)
    turns = {}
    for r in sorted(repair.repaired_turns(cut, found).collect(), key=lambda r: (r.conv_id, r.part, r.low, r.number)):
        turns.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(cut, found).collect()}
    audits = {r.conv_id: r.audit for r in found.collect()}
    assert set(turns) == set(digests)
    for conv, own in turns.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digests[conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert "".join(r.edit for r in own) == audits[conv].replace("D", "")


def test_repair_of_nothing(spark):
    empty = ship(spark).createDataFrame([], COLUMNS)
    assert repair.repair_digest(empty, repair.damaged(empty)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "gone.")], COLUMNS)
    assert [tuple(r) for r in repair.repair_digest(one, repair.damaged(one)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# --- license scans


def least_edits(text, notice):
    """The edits of the place in ``text`` that is most like ``notice``, by the plain recurrence."""
    column = list(range(len(notice) + 1))
    best = column[-1]
    for c in text:
        above, column[0] = column[0], 0
        for i, n in enumerate(notice, 1):
            above, column[i] = column[i], min(above + (c != n), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def garbled(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        kind = rng.choice("ids")
        letters[at : at + (kind != "i")] = [rng.choice("abc ")] if kind != "d" else []
    return "".join(letters)


def test_each_notice_is_found_within_its_edits_and_no_other():
    rng = random.Random(11)
    for notice, label in licenses.NOTICES:
        scanner, own = licenses.Scanner([], [(notice, label)]), licenses.reduced(notice.encode()).decode()
        for edits in (0, 1, 2, 3, 4, 6):
            for _ in range(6):
                text = f"{garbled(rng, 'nothing of the public license to see', 3)}, {garbled(rng, notice.title(), edits)}; under the end"
                near = least_edits(licenses.reduced(text.encode()).decode(), own) <= licenses.edits_of(notice)
                assert bool(scanner.scan(text.encode()).spans) == near, (notice, text)


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), places


ODD_TEXTS = [
    None, "", " -- ", "Under the MIT License", "under the mit license under the mit license", "CC BY-NC cc by nc CC-BY-NC-SA", "ÜNDER the mıt lıcense, Apache License, Version 2.0; CC  BY\nNC",
    "Relased undr the MIT Lisense", "apache license version 20", "\x00under\x00the\x00mit\x00license\x7f", "ſunder the mit license", "ünder — ééé 日本 under the mit license 日本", "x " * 200_000 + "cc by nc " * 3,
]


def test_scan_equals_brute_force_on_odd_rows(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3], 0)]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, places long").repartition(3)
    got = licenses.license_digest(licenses.scan_licenses(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        words, places = plain_base(ODD_TEXTS[r.doc_id])
        labels = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (words, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score == 1) >= bool(places)
        for s in r.spans:
            spoken = licenses.reduced(ODD_TEXTS[r.doc_id][s.begin : s.end].encode()).decode("latin-1").strip()
            assert least_edits(f" {spoken} ", f" {s.notice} ") <= licenses.edits_of(s.notice)
            assert len(spoken.split()) == s.last_word - s.first_word + 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].labels == "mit" and by_id[7].base_labels == "" and 0.8 < by_id[7].score < 1
    assert by_id[5].labels == "cc-by-nc,cc-by-nc-sa" and by_id[8].base_labels == ""
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_scan_equals_brute_force_on_documents(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in entry.op12_license_scan(spark, "/root/testdata/sf0.01").collect():
        words, places = plain_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (words, len(places), ",".join(sorted({label for _, label in places})))
        near = "licen" in texts[r.doc_id].lower() or "rights" in texts[r.doc_id].lower()
        assert bool(r.labels) == near or not near  # documents without any notice have none
        assert near or not r.labels


def test_a_repeated_notice_takes_linear_time():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    assert len(scanner.scan(b"Under the MIT License. " * 20_000).places) == 20_000


# --- filter audit


def plain_audit(docs, labels):
    texts = [t or "" for _, t, _ in docs]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for i, (doc, _, _) in enumerate(docs):
        t, words = texts[i], re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        repeated = doc is not None and any(texts[j] == t and docs[j][0] is not None and docs[j][0] < doc for j in range(len(docs)))
        fails.append({f for f, hit in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), repeated)) if hit})
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own, removals = [i for i, d in enumerate(docs) if (d[2] or "") == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                redundant = sum(f in fails[i] for i in own) - len(gone)
                left -= gone
                removals[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(fails[i] == {f} for i in own), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removals[order[step - 1]])
    return out


def test_audit_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(13)
    texts = [None, "", " \n", "A", "a b a", "x # y", " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 50}" for i in range(120)), "\n" + " ".join(f"W{i}" for i in range(150)) + "\x0b", "é|" * 30, "the same " * 3000]
    docs = [(rng.choice([i, i, 3, None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)] + [(7, texts[6], "en")] * 5
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 90, 2), 3, 7, None, 500]]
    df = ship(spark).createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, n long").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.audit(df, marks).collect()
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(rows) == len(got) == 3 * 600 and got == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).collect() == [] and filter_audit.audit(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_lattice_has_eighty_edges(spark):
    steps = filter_audit.permutation_steps(spark)
    assert steps.count() == 600 and steps.select("applied", "next").distinct().count() == 80


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_filter_audit"])
def test_sql_at_sf001(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df, want = entry.QUERIES[name](ship(spark), "/root/testdata/sf0.01"), con.sql(entry.ORACLES[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


# --- the language model's bounds


def test_language_sample_is_bounded_under_a_hot_id(spark, monkeypatch):
    from foliospark.llm import langid

    seen = spark.sparkContext.accumulator(0)
    plain = langid.counted_grams

    def counting(texts):
        seen.add(len(texts))
        return plain(texts)

    monkeypatch.setattr(langid, "counted_grams", counting)
    df = ship(spark).range(20_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    for id_column in ("doc_id", "n"):
        langid.fit(df.withColumn("n", F.lit(None).cast("long")), id_column=id_column, most=100)
        assert 0 < seen.value <= 200, id_column
        seen.value = 0


def test_many_languages_take_the_split_way(spark, monkeypatch):
    from foliospark.llm import langid

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.concat("lang", (F.col("doc_id") % 12).cast("string")))
    dense = langid.train(docs)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 1 << 20)
    split = langid.train(docs)
    assert dense.matrix is not None and split.matrix is None and split.languages == dense.languages
    texts = [r.text for r in docs.limit(300).collect()] + ["", None, "日本", "1"]
    (a, x), (b, y) = dense.score(texts), split.score(texts)
    assert all(abs(p - q) < 1e-3 for p, q in zip(x, y)) and sum(m != n for m, n in zip(a, b)) <= 2
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="more than 10 values"):
        langid.train(docs)
