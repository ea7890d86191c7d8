"""Conversation repair: the cheapest edits that make a conversation's roles alternate, found by a scan of min-plus matrices.

A repaired conversation's role initials are ``(s?(ua)+)?``: four states (nothing yet, after system, after user, after assistant). A turn is a
4 x 4 matrix: from each state to each, the cheapest edit of that turn followed by the cheapest inserted turns (the closure of insertion). An
element is (cost, audit), the audit being the edits' initials: Keep 0, Rerole to user or assistant 1, Delete 2, Insert 5, and 5 for a truncated
turn that stays. The sum of two elements is the lesser one, their product adds costs and joins audits. An audit gives its own cost, so of two
with equal cost, over the same turns, neither is a beginning of the other; so products keep the order, and the product of
matrices is associative. (An audit also gives the roles: states follow from it.)

Turns are sorted over all partitions by conversation and turn. Each partition cuts its conversations into segments of at most SEGMENT turns; a
segment's matrix comes from a tree of products with short runs of turns remembered. Segments of one conversation are multiplied FAN at a time,
first within a partition, then over partitions, so that a conversation of any length is many tasks' work; the few that cross the edge of a
partition are known from the partitions' first and last rows. Repeated turns are told apart by a digest within a partition; over its edge only the
first of each partition meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import shuffle_partitions, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
#: A segment ends after so many turns or characters; so many segments are multiplied by one row of a level.
SEGMENT, SEGMENT_CHARS, FAN = 1024, 4 << 20, 64
#: Runs of at most so many turns are remembered, as many as this; their matrices are small.
RUN, RUNS = 8, 1 << 15

#: States: nothing yet, after system, after user, after assistant. STEP: the state that a role's initial leads to, from which states.
START, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEP = {"s": (SYSTEM, (START,)), "u": (AFTER_USER, (START, SYSTEM, AFTER_ASSISTANT)), "a": (AFTER_ASSISTANT, (AFTER_USER,))}
Matrix = tuple[tuple[int, str] | None, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product: from i to j the least of what leads from i to k by ``a`` and from k to j by ``b``."""
    out = []
    for i in range(4):
        row = [(k, a[4 * i + k]) for k in range(4) if a[4 * i + k]]
        for j in range(4):
            best = None
            for k, left in row:
                right = b[4 * k + j]
                if right is not None and (best is None or left[0] + right[0] <= best[0]):
                    both = (left[0] + right[0], left[1] + right[1])
                    best = both if best is None else min(best, both)
            out.append(best)
    return tuple(out)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(x if y is None else y if x is None else min(x, y) for x, y in zip(a, b))


def _matrix(cells: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(cells.get((i, j)) for i in range(4) for j in range(4))


UNIT = _matrix({(i, i): (0, "") for i in range(4)})
_INSERTED = _matrix({(i, to): (INSERT_COST, INSERT) for role in "ua" for to, froms in (STEP[role],) for i in froms})
#: Any number of inserted turns, none included: two lead from any state to any that can be reached.
CLOSURE = plus(plus(UNIT, _INSERTED), times(_INSERTED, _INSERTED))


@lru_cache(64)
def turn_matrix(code: str) -> Matrix:
    """The matrix of one turn. ``code``: ``x`` must be deleted; otherwise the role's initial (``o``: none of s, u, a), a capital if truncated."""
    cells = {(i, i): (DELETE_COST, DELETE) for i in range(4)}
    if code != "x":
        stays = TRUNCATED_COST if code.isupper() else 0
        for role, (to, froms) in STEP.items():
            edit = (stays, KEEP) if role == code.lower() else (stays + REROLE_COST, REROLE) if role != "s" else None
            for i in froms if edit else ():
                cells[i, to] = min(cells.get((i, to), edit), edit)
    return times(_matrix(cells), CLOSURE)


@lru_cache(RUNS)
def _run(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 1 else times(_run(codes[: len(codes) // 2]), _run(codes[len(codes) // 2 :]))


def product(codes: str) -> Matrix:
    """The product over a run of turns, as a tree."""
    if not codes:
        return UNIT
    if len(codes) <= RUN:
        return _run(codes)
    half = (len(codes) // 2 + RUN - 1) // RUN * RUN
    return times(product(codes[:half]), product(codes[half:]))


def best(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: turns may be inserted before the first one; nothing or an assistant's turn comes last."""
    whole = times(CLOSURE, matrix)
    return min(x for x in (whole[START], whole[AFTER_ASSISTANT]) if x)


# --- faults, segments


def code_of(role: str, text: str) -> str:
    """A turn's code by its own text alone: blank ones are ``x``."""
    end = text.rstrip(_SPACE)
    if not end:
        return "x"
    initial = role[:1] if role[:1] in STEP else "o"
    return initial if end[-1] in ".!?" else initial.upper()


_SPACE = " \t\n\x0b\x0c\r"
#: Neighbouring roles' initials that may follow each other.
LEGAL = {"su", "ua", "au"}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation, turn (nulls first), role, the first 64 characters of the text, and then a hash of it. Equal rows
    may go to several partitions; which of them is which makes no difference."""
    keyed = rows.select("*", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    return keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select(*rows.columns)


def segments(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text without nulls) sorted, cut into segments and written: each row has its place (part, low: the
    segment's number within conversation and partition, pos), its code and a digest of role and text, null if it is blank or if its
    partition has the same before it. The last row of each segment has ``closing``: the codes of all its rows, counts, its first and last
    turn and initial, and whether the conversation has other segments in this partition."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    closing = pa.struct([("codes", pa.string()), ("more", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64())])
    names = ["conv_id", "part", "low", "pos", "role", "text", "digest", "closing"]
    own_names = [closing.field(i).name for i in range(closing.num_fields)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, low, chars, seen, held, started = None, 0, 0, set(), [], False
        last_batch_type = None

        def close(more: bool) -> pa.RecordBatch:
            codes, digests, duplicate, illegal, turns = [], [], 0, 0, 0
            for i, (_, turn, role, text) in enumerate(held):
                code, digest = code_of(role, text), None
                # Seen: the same role and text, in this turn or an earlier one.
                own = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if code != "x" and own in seen:
                    code, duplicate = "x", duplicate + 1
                elif code != "x":
                    digest = own
                    seen.add(own)
                codes.append(code)
                digests.append(digest)
                illegal += i > 0 and held[i - 1][2][:1] + role[:1] not in LEGAL
                turns += turn is not None and (i == 0 or held[i - 1][1] != turn)
            blank = sum(c == "x" for c in codes) - duplicate
            known = [h[1] for h in held if h[1] is not None]
            summary = dict(zip(own_names, ("".join(codes), more, blank, duplicate, illegal, held[0][2][:1], held[-1][2][:1], known[0] if known else None, known[-1] if known else None, turns)))
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], last_batch_type), pa.array([part] * n, pa.int32()), pa.array([low] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([h[2] for h in held], pa.string()), pa.array([h[3] for h in held], pa.string()), pa.array(digests, pa.binary()), pa.array([None] * (n - 1) + [summary], closing)],
                names=names,
            )

        for batch in batches:
            last_batch_type = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if started and row[0] != conv:
                    yield close(low > 0)
                    conv, low, chars, seen, held = row[0], 0, 0, set(), []
                elif held and (len(held) >= SEGMENT or chars >= SEGMENT_CHARS):
                    yield close(True)
                    low, chars, held = low + 1, 0, []
                conv, started = row[0], True
                held.append(row)
                chars += len(row[3])
        if held:
            yield close(low > 0)

    schema = f"conv_id {id_type}, part int, low int, pos int, role string, text string, digest binary, closing struct<codes:string,more:boolean,blank:long,duplicate:long,illegal:long,first:string,last:string,lo:long,hi:long,turns:long>"
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return written(_ordered(plain).mapInArrow(cut, schema), "segments")


def _crossing(cut: DataFrame) -> DataFrame:
    """The conversations that are in more than one partition: each is a partition's first or last, so there are fewer than partitions."""
    ends = cut.filter(F.col("closing").isNotNull()).groupBy("part").agg(F.min_by(F.struct("conv_id"), F.struct("conv_id", "low")).alias("first"), F.max_by(F.struct("conv_id"), F.struct("conv_id", "low")).alias("last"))
    either = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("own")).select("part", "own.conv_id")
    return either.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("crossing"))


def _repeats(cut: DataFrame, crossing: DataFrame) -> DataFrame:
    """Rows of crossing conversations that an earlier partition has already: for each segment their places. Each partition has a digest
    once, so a group has no more rows than there are partitions."""
    own = cut.filter(F.col("digest").isNotNull()).join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crossing")), "left_semi")
    met = own.groupBy("conv_id", "digest").agg(F.sort_array(F.collect_list(F.struct("part", "low", "pos"))).alias("at")).filter(F.size("at") > 1)
    return met.select("conv_id", F.explode(F.slice("at", 2, F.size("at"))).alias("p")).groupBy("conv_id", "p.part", "p.low").agg(F.collect_list("p.pos").alias("late"))


# --- matrices of segments and their products

_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_CELLS = "n long, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, lo long, hi long, codes array<struct<part:int,low:int,codes:string>>"
_ARROW = [
    ("n", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()),
    ("lo", pa.int64()), ("hi", pa.int64()), ("codes", pa.list_(pa.struct([("part", pa.int32()), ("low", pa.int32()), ("codes", pa.string())]))),
]


def _cells(m: Matrix) -> dict:
    return {"costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring segments as one: an associative product, counts included."""
    m = times(_cells_of(a), _cells_of(b))
    out = {c: a[c] + b[c] for c in [*_COUNTS, "n"]}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["hi"] is not None and a["hi"] == b["lo"]
    return {**out, **_cells(m), "first": a["first"], "last": b["last"], "lo": b["lo"] if a["lo"] is None else a["lo"], "hi": a["hi"] if b["hi"] is None else b["hi"], "codes": a["codes"] + b["codes"]}


def _cells_of(row: dict) -> Matrix:
    return tuple(None if c is None else (c, t) for c, t in zip(row["costs"], row["audits"]))


def _halves(rows: list[dict]) -> dict:
    return rows[0] if len(rows) == 1 else joined(_halves(rows[: len(rows) // 2]), _halves(rows[len(rows) // 2 :]))


def _mapped(df: DataFrame, function, keys: list[str], schema: str, arrow: list) -> DataFrame:
    """``function`` gives a dict (or several) for each row's dict; columns ``keys`` are taken along as they are."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [n for n, _ in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = [(i, d) for i, row in enumerate(some.to_pylist()) for d in function(row)]
                take = pa.array([i for i, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(k).take(take) for k in keys] + [pa.array([d[n] for _, d in out], t) for n, t in arrow], names=[*keys, *names])

    return df.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))


def _one(row: dict) -> list[dict]:
    codes, late = list(row["codes"]), [i for i in row["late"] or [] if row["codes"][i] != "x"]
    for i in late:
        codes[i] = "x"
    own = "".join(codes)
    counts = {"blank": row["blank"], "duplicate": row["duplicate"] + len(late), "truncated": sum(c.isupper() for c in own), "illegal": row["illegal"], "turns": row["turns"]}
    return [{"n": 1, **_cells(product(own)), **counts, **{k: row[k] for k in ("first", "last", "lo", "hi")}, "codes": [{"part": row["part"], "low": row["low"], "codes": own}]}]


def _level(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """Rows of a conversation with the same ``group`` (FAN or fewer, in order of part and low) as one."""
    fields = [f for f, _ in _ARROW]
    keys = ["part", "low"] if name == "low" else ["part"]
    met = rows.withColumn("group", group).groupBy("conv_id", *(["part"] if name == "low" else []), "group")
    met = met.agg(F.sort_array(F.collect_list(F.struct(*keys, *fields))).alias("own"), *([] if name == "low" else [F.lit(0).alias("low")]))
    met = met.withColumnRenamed("group", name)
    return _mapped(met.select("conv_id", "part", "low", "own"), lambda row: [_halves(row["own"])], ["conv_id", "part", "low"], _CELLS, _ARROW)


def repairs(cut: DataFrame) -> DataFrame:
    """For each conversation of ``cut`` (segments) a row: the counts of its faults, its first and last turn, cost and audit of the
    cheapest repair, and the codes of its segments. Only conversations of several segments are shuffled."""
    crossing = _crossing(cut)
    closed = cut.filter(F.col("closing").isNotNull()).select("conv_id", "part", "low", "closing.*")
    late = _repeats(cut, crossing).withColumnsRenamed({"conv_id": "_conv", "part": "_part", "low": "_low"})
    here = closed.join(late, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("low") == F.col("_low")), "left")
    single = written(_mapped(here, _one, ["conv_id", "part", "low", "more"], _CELLS, _ARROW), "matrices")
    columns = ["conv_id", "part", "low", *[f for f, _ in _ARROW]]
    rows = single.filter("not more").select(*columns)
    several = single.filter("more").select(*columns)
    most = single.agg(F.max("low")).first()[0] or 0
    while most:
        several, most = _level(several, F.floor(F.col("low") / FAN).cast("int"), "low"), most // FAN
    rows = rows.unionByName(several)
    over = written(rows.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crossing")), "left_semi"), "crossing")
    rows = rows.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crossing")), "left_anti")
    most = over.agg(F.max("part")).first()[0] or 0
    while most:
        over, most = _level(over, F.floor(F.col("part") / FAN).cast("int"), "part"), most // FAN
    whole = rows.unionByName(over)

    def choose(row: dict) -> list[dict]:
        cost, audit = best(_cells_of(row))
        return [{"cost": cost, "audit": audit}]

    keys = ["conv_id", *_COUNTS, "lo", "hi", "codes"]
    return _mapped(whole, choose, keys, "cost long, audit string", [("cost", pa.int64()), ("audit", pa.string())])


# --- repaired turns


def _pieces(row: dict) -> list[dict]:
    """The audit cut at the segments' edges, each piece with the state before it. Inserted turns go with the turn before them."""
    audit, at, state, out = row["audit"], 0, START, []
    for own in row["codes"]:
        begin, before = at, state
        for code in own["codes"]:
            while audit[at] == INSERT:
                state, at = _next(state, audit[at], ""), at + 1
            state, at = _next(state, audit[at], code), at + 1
        while at < len(audit) and audit[at] == INSERT:
            state, at = _next(state, audit[at], ""), at + 1
        out.append({"part": own["part"], "low": own["low"], "piece": audit[begin:at], "state": before})
    return out


def _next(state: int, edit: str, code: str) -> int:
    if edit == DELETE:
        return state
    if edit == KEEP and code.lower() == "s":
        return SYSTEM
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Repaired turns from sorted rows, in which a segment's piece of the audit comes before its turns: conversation, part, low, number
    within the segment, role, text, edit."""
    piece, at, state, place, number = "", 0, START, None, 0

    def inserted(out: list) -> None:
        nonlocal at, state, number
        while at < len(piece) and piece[at] == INSERT:
            state, at = _next(state, INSERT, ""), at + 1
            out.append((*place, number, USER if state == AFTER_USER else ASSISTANT, "", INSERT))
            number += 1

    for batch in batches:
        out: list[tuple] = []
        for conv, part, low, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pos < 0:
                if place:
                    inserted(out)
                piece, at, state, place, number = text, 0, int(role), (conv, part, low), 0
                inserted(out)
                continue
            edit, at = piece[at], at + 1
            if edit != DELETE:
                state = _next(state, edit, role[:1])
                if edit == REROLE:
                    role = USER if state == AFTER_USER else ASSISTANT
                out.append((conv, part, low, number, role, text, edit))
                number += 1
            inserted(out)
        yield out


def _with_pieces(cut: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    pieces = _mapped(found.select("conv_id", "audit", "codes"), _pieces, ["conv_id"], "part int, low int, piece string, state int", [("part", pa.int32()), ("low", pa.int32()), ("piece", pa.string()), ("state", pa.int32())])
    both = cut.select("conv_id", "part", "low", "pos", "role", "text").unionByName(pieces.select("conv_id", "part", "low", F.lit(-1).alias("pos"), F.col("state").cast("string").alias("role"), F.col("piece").alias("text")))
    return both.repartition(shuffle_partitions(cut.sparkSession), *keys).sortWithinPartitions("conv_id", "part", "low", "pos")


def repaired_turns(cut: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, part, low and number (in this order they are a conversation's turns), role, text
    and the edit that made them (K, R or I). Segments are dealt out one by one, so a long conversation is many tasks' work."""
    id_type = cut.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "low", "number", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _repaired(batches):
            if out:
                conv, part, low, number, role, text, edit = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(part, pa.int32()), pa.array(low, pa.int32()), pa.array(number, pa.int32()), pa.array(role), pa.array(text), pa.array(edit)], names=names)

    return _with_pieces(cut, found, "conv_id", "part", "low").mapInArrow(run, f"conv_id {id_type}, part int, low int, number int, role string, text string, edit string")


def repaired_digests(cut: DataFrame, found: DataFrame) -> DataFrame:
    """The SHA-256 of each repaired conversation (``role:text``, joined by line feeds). A digest is sequential: a conversation streams through
    one task, which holds a hash and a piece of its audit; one without a repaired turn gets the digest of nothing."""
    id_type = cut.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, kind = None, None, pa.null()

        def types(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in some:
                kind = batch.column(0).type
                yield batch

        def done(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], kind), pa.array([h for _, h in rows], pa.string())], names=["conv_id", "repaired_sha256"])

        for turns in _repaired(types(batches)):
            finished = []
            for turn in turns:
                if own is None or turn[0] != conv:
                    if own is not None:
                        finished.append((conv, own.hexdigest()))
                    conv, own = turn[0], hashlib.sha256()
                    own.update(f"{turn[4]}:{turn[5]}".encode())
                else:
                    own.update(f"\n{turn[4]}:{turn[5]}".encode())
            if finished:
                yield done(finished)
        if own is not None:
            yield done([(conv, own.hexdigest())])

    return _with_pieces(cut, found, "conv_id").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


# --- the table with faults


def damaged(rows: DataFrame) -> DataFrame:
    """Faults put into ``conversations`` (conv_id, turn, role, text; a null is one space) by crc32 of ``conv_id:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes its role user. Null turns stay null."""
    nothing = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), nothing), F.lit(":"), F.coalesce(F.col("turn").cast("string"), nothing)).cast("binary")) % 20
    own = rows.select("conv_id", "turn", F.coalesce("role", nothing).alias("role"), F.coalesce("text", nothing).alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, USER).otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_digest(every: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``every`` (null included): the faults of its ``rows``, cost and audit of their repair, its digest. A conversation
    without rows has zeros, an empty audit and the digest of nothing; an empty table gives no rows."""
    cut = segments(rows)
    found = written(repairs(cut), "repairs")
    digests = repaired_digests(cut, found).withColumnRenamed("conv_id", "_digest_of")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    own = found.select(F.col("conv_id").alias("_own"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    ids = every.select("conv_id").distinct()
    met = ids.join(own, F.col("conv_id").eqNullSafe(F.col("_own")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_digest_of")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
