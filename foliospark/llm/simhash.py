"""SimHash near-duplicates: fingerprints of 64 bits, all links within a small Hamming radius, components.

Fingerprints that differ in at most three of 64 bits agree in two of five blocks of bits, so each distinct fingerprint goes into
ten buckets, one for each pair of blocks, and links meet in a bucket. Copies share a fingerprint and count once there. In a
bucket fingerprints are compared bit-sliced: plane k holds bit k of 64 rows in a word, the plane shifted by d rows against
itself gives the differences of all rows and their d-th followers, carry-save counters add the planes up, and words whose
lanes all exceed the radius are abandoned. A bucket of more than ``BUCKET`` rows is cut by its other bits: four pieces, of which two
fingerprints that link have one in common, so each row is copied four times. A piece that is still too large is cut into chunks, and
each pair of chunks is a bucket of its own. No link is lost and no task gets a whole large bucket. Links become stars within a
task, and stars become components by alternating large-star and small-star rounds, each written to the shared folder. Rows are
joined with counts or minima of their key by ``by_size``, so that a bucket or a star that holds a large share of all rows isn't
shuffled into one task.

``near_duplicates`` links by that short fingerprint. ``keep_one``, which drops near copies, wants texts whose sets of five-word
shingles have a Jaccard likeness of 0.8 or more; those differ by about 15 % of a SimHash's bits, too many for blocks. Its
fingerprint has 1024 bits, so that the likeness can be guessed from the distance, and its buckets are bands of least shingle hashes;
the comparison within a bucket is the same bit-sliced one with wider counters, and finds candidates only. The components of
candidates are blocks; the shingle sets of their texts, made again for these alone, go there once, and a candidate is a link if its sets
are alike by 0.8 or more. Buckets that hold the same rows are compared once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, by_size, discard, heavy_keys, shuffle_partitions, written

SEED, SHINGLE, RADIUS = 42, 3, 3
#: What ``keep_one`` takes for near copies, and the 64-bit words of its fingerprint.
LIKE_SHINGLE, SIMILARITY, LIKE_WORDS = 5, 0.8, 16
#: Bands and least hashes in each: a pair at 0.8 shares a band with a probability of 0.9996, one at 0.3 with 0.05.
BANDS, BAND_ROWS = 20, 5
#: Candidates may be so many standard deviations farther than 0.8 has it. Sets of few shingles have ties among their bits, most
#: of all four and five shingles: 3 of 16 bits differ; ``SHORT`` shingles or fewer are compared by a radius that allows for that.
DEVIATIONS, SHORT, SHORT_SHARE = 5, 20, 3 / 16
#: Bits of the filter for the texts of candidates.
FILTER_BITS, MOST_FILTER_BITS = 1 << 26, 1 << 28
#: Counters of shingles, by which prefixes are ordered: more would order them better, fewer are as exact.
COUNTERS = 1 << 20
#: Bits of the five blocks, low ones first.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that are compared in one piece; a chunk has half of it. Rows of a bucket in which ``candidate_links``
#: compares at all.
BUCKET, LIKE_BUCKET = 8192, 512
#: Rows and shingles of a block in which sets are compared, and the rows that all chunks of a larger component share.
BLOCK, BLOCK_SHINGLES, HUBS = 512, 1 << 22, 16
#: Chunks up to which a large component is compared in pairs of them: a row is copied for each. The prefixes of usual texts copy it about as often.
FEW_CHUNKS = 32
#: Rows that a task compares at once, and words of a text that are hashed at once.
ROWS_AT_ONCE, LIKE_ROWS_AT_ONCE, WORDS_AT_ONCE = 1 << 19, 1 << 16, 1 << 16


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text of ``shingle`` words or more, in pieces."""
    import xxhash

    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    for a in range(0, n, WORDS_AT_ONCE):
        own = words[a : a + WORDS_AT_ONCE + shingle - 1]
        joined = b" ".join(own)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
        ends = np.cumsum(sizes) - 1
        begins = (ends - sizes + 1)[: len(own) - shingle + 1].tolist()
        yield np.array([digest(joined[s:e], seed) for s, e in zip(begins, ends[shingle - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's word shingles, repeats included: A-Z in lower case, words between ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for hashes in shingle_hashes(words, shingle, seed):
        for b in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[b : b + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _steps(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_WORD, _MASK, _ODD = _steps(LIKE_WORDS, 1), _steps(BANDS * BAND_ROWS, 2), _steps(BANDS * BAND_ROWS, 3) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles of ``LIKE_SHINGLE`` words (fewer words: of the whole sequence, be it empty), each once."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < LIKE_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    return np.unique(np.concatenate(list(shingle_hashes(words, LIKE_SHINGLE, SEED))))


def likeness(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """SimHash (``LIKE_WORDS`` words) of the text's ``shingle_set``, and the keys of its ``BANDS`` bands."""
    return set_likeness(shingle_set(text))


def set_likeness(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(64 * LIKE_WORDS, np.int64)
    least = np.full(len(_MASK), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 255):  # so many bits still add up in a byte
        own = hashes[a : a + 255]
        wide = mixed(own[:, None] ^ _WORD).astype("<u8", copy=False)
        total += np.add.reduce(np.unpackbits(wide.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        np.minimum(least, ((own ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = mixed(keys ^ column) + np.arange(BANDS, dtype=np.uint64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8"), keys


def likeness_radius(similarity: float = SIMILARITY, deviations: float = 2, share: float | None = None) -> int:
    """The distance that sets of this Jaccard likeness and of one size have (or ``share`` of the bits), and two standard deviations."""
    n = 64 * LIKE_WORDS
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) if share is None else share
    return int(n * share + deviations * (n * share * (1 - share)) ** 0.5)


def with_likeness(rows: DataFrame, text_column: str, schema: str) -> DataFrame:
    """The columns but ``text_column`` (the last one), the fingerprint's words w0, w1, ..., ``keys`` and the number ``n`` of shingles."""
    names = [f"w{k}" for k in range(LIKE_WORDS)]

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                hashes = shingle_set(text)
                found.append(set_likeness(hashes))
                n.append(len(hashes))
            words = np.array([w for w, _ in found], np.uint64).reshape(-1, LIKE_WORDS).view(np.int64)
            keys = np.array([k for _, k in found], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            columns = [*batch.columns[:-1], *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(LIKE_WORDS)], lists, pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names, "keys", "n"])

    return rows.mapInArrow(hash_texts, f"{schema}, {', '.join(f'{n} long' for n in names)}, keys array<long>, n long")


def with_fingerprints(rows: DataFrame, text_column: str, schema: str) -> DataFrame:
    """The columns but ``text_column`` (the last one), and ``fp`` as a signed long."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(hash_texts, f"{schema}, fp long")


def bucket_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: the number of the pair of blocks, and their bits."""
    at = np.concatenate(([0], np.cumsum(BLOCKS)))
    block = [F.shiftrightunsigned(fp, int(a)).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, BLOCKS)]
    pairs = itertools.combinations(range(len(BLOCKS)), 2)
    return F.array(*[F.lit(n << 40).bitwiseOR(F.shiftleft(block[i], 20)).bitwiseOR(block[j]) for n, (i, j) in enumerate(pairs)])


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row k holds bit k of every fingerprint (a row of 64-bit words), 64 of them in a word, and three words or less of zeros."""
    planes = np.zeros((64 * fps.shape[1], 8 * (len(fps) // 64 + 3)), np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    return planes.view("<u8")


def close_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of one group with fingerprints that differ in at most ``radius`` (at most 3) bits; groups follow one another,
    the largest first, so that the groups with a d-th follower are a prefix."""
    planes = bit_planes(fps[:, None])
    group = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        upto = int(ends[np.searchsorted(-sizes, -d, "left") - 1])  # rows of groups with more than d rows
        lanes = np.zeros(64 * (-(-(upto - d) // 64)), bool)
        lanes[: upto - d] = group[: upto - d] == group[d:upto]
        over = ~np.packbits(lanes, bitorder="little").view("<u8")
        at = np.nonzero(over != full)[0]
        over, ones, twos = over[at], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        jump, down = divmod(d, 64)
        down, up = np.uint64(down), np.uint64((64 - down) % 64)
        for k in range(0, 64, 2):
            a, b = (own[at] ^ ((own[at + jump] >> down) | (own[at + jump + 1] << up) if down else own[at + jump]) for own in (planes[k], planes[k + 1]))
            half = ones ^ a
            carry = (ones & a) | (half & b)
            ones = half ^ b
            over |= twos & carry
            twos ^= carry
            if radius < 3:
                over |= twos if radius < 2 else twos & ones
                over |= ones if radius < 1 else over
            if k % 8 == 6 and len(at):
                stays = np.nonzero(over != full)[0]
                if 2 * len(stays) < len(at):
                    at, over, ones, twos = at[stays], over[stays], ones[stays], twos[stays]
            if not len(at):
                break
        if len(at):
            close = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
            w, lane = np.nonzero(close)
            i = at[w] * 64 + lane
            if len(i):
                yield i, i + d


def close_likenesses(fps: np.ndarray, sizes: np.ndarray, radius: int, label: np.ndarray, first: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``close_pairs`` for fingerprints of several words and a radius of 8 or more. Pairs that ``label`` has as connected
    are left out: it may be filled in between, and with ``first`` takes each group's rows that are close to the group's first one."""
    group, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    if first:
        begin = np.repeat(ends - sizes, sizes)
        near = np.bitwise_count(fps ^ fps[begin]).sum(axis=1, dtype=np.int64) <= radius
        label[near] = begin[near]
    planes, full = bit_planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    high = radius.bit_length()  # counters begin so that one more than the radius overflows
    start = [full * np.uint64((1 << high) - 1 - radius >> m & 1) for m in range(high)]

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        upto = int(ends[np.searchsorted(-sizes, -d, "left") - 1])
        lanes = np.zeros(64 * (-(-(upto - d) // 64)), bool)
        lanes[: upto - d] = (group[: upto - d] == group[d:upto]) & (label[: upto - d] != label[d:upto])
        over = ~np.packbits(lanes, bitorder="little").view("<u8")
        at = np.nonzero(over != full)[0]
        over, count = over[at], [np.full(len(at), m) for m in start]
        jump, down = divmod(d, 64)
        down, up = np.uint64(down), np.uint64((64 - down) % 64)
        for k in range(0, len(planes), 8):
            if not len(at):
                break
            x = planes[k : k + 8, at]
            x = x ^ ((planes[k : k + 8, at + jump] >> down) | (planes[k : k + 8, at + jump + 1] << up) if down else planes[k : k + 8, at + jump])
            ones, a = add(count[0], x[0], x[1])
            ones, b = add(ones, x[2], x[3])
            twos, e = add(count[1], a, b)
            ones, a = add(ones, x[4], x[5])
            count[0], b = add(ones, x[6], x[7])
            count[1], f = add(twos, a, b)
            count[2], carry = add(count[2], e, f)
            for m in range(3, high):
                count[m], carry = count[m] ^ carry, count[m] & carry
            over |= carry
            if k % 32 == 24 and k > radius:
                stays = np.nonzero(over != full)[0]
                if 2 * len(stays) < len(at):
                    at, over, count = at[stays], over[stays], [c[stays] for c in count]
        if len(at):
            w, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64))
            i = at[w] * 64 + lane
            if len(i):
                yield i, i + d


def stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None, most: int = 1 << 21) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with. ``label``, where given, is filled after each ``most`` pairs."""
    label = np.arange(n) if label is None else label
    held: list[np.ndarray] = []
    size = 0

    def join():
        i, j = np.concatenate(held, axis=1)
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, least = i[differ], j[differ], np.minimum(a, b)[differ]
            np.minimum.at(label, a[differ], least)
            np.minimum.at(label, b[differ], least)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    for i, j in pairs:
        held.append(np.stack((i, j)))
        size += len(i)
        if size > most:
            join()
            held, size = [], 0
    if held:
        join()
    return label


def _likeness_radii(n: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Which rows, of sets of ``n`` shingles, to compare by what radius: their places, and the sizes of their groups."""
    yield np.arange(len(n)), sizes, likeness_radius(deviations=DEVIATIONS)
    group = np.repeat(np.arange(len(sizes)), sizes)
    short = np.flatnonzero(n <= SHORT)
    many = np.bincount(group[short], minlength=len(sizes))
    short = short[np.lexsort((group[short], -many[group[short]]))]
    yield short, -np.sort(-many[many > 0]), likeness_radius(deviations=DEVIATIONS, share=SHORT_SHARE)


def _fingerprint_stars(rows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    root = stars(rows.shape[1], close_pairs(rows[0].view(np.uint64), sizes))
    own = np.flatnonzero(root != np.arange(len(root)))
    yield root[own], own


def _candidate_stars(rows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that connect just the rows (node, n, words) that candidates of their group connect."""
    fps = np.ascontiguousarray(rows[2:].T).view(np.uint64)
    for at, own, radius in _likeness_radii(rows[1], sizes):
        label = np.arange(len(at))
        root = stars(len(at), close_likenesses(fps[at], own, radius, label), label, 1 << 14)
        moved = np.flatnonzero(root != np.arange(len(at)))
        yield at[root[moved]], at[moved]


def _by_group(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows (key, i, j, ...), sorted by these three, in which the largest groups come first, and their sizes."""
    new = np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(axis=0)) + 1
    begin = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((begin, [table.shape[1]])))
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    return np.repeat(begin[order] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(table.shape[1]), sizes


def _last_group(table: np.ndarray) -> int:
    """Where the last group of rows (key, i, j, ...) begins."""
    others = np.flatnonzero((table[:3] != table[:3, -1:]).any(axis=0))
    return int(others[-1]) + 1 if len(others) else 0


def _compare(batches: Iterator[pa.RecordBatch], pairs: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]] = _fingerprint_stars, at_once: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, node, ...) in order of the first three; yields stars (a, b), each node b with one of its component."""
    held: list[np.ndarray] = []

    def links(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, sizes = _by_group(table)
        nodes = table[3, rows]
        for i, j in pairs(table[3:, rows], sizes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(t.shape[1] for t in held) >= at_once:
            whole = np.concatenate(held, axis=1)
            if cut := _last_group(whole):
                yield from links(whole[:, :cut])
            held = [whole[:, cut:]]
    if held:
        yield from links(np.concatenate(held, axis=1))


def alike_links(label: np.ndarray, fps: np.ndarray, shingles: np.ndarray, starts: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of one group whose sets (``n`` of the ``shingles`` from ``starts`` on) are alike by ``SIMILARITY`` or more: as many as
    connect what all of them connect, beside rows of one ``label``, which are connected already. Candidates come from the
    bit-sliced comparison, first those with their group's first row, and each is decided by the sets themselves."""
    size, group, ends = len(label), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    order = np.lexsort((np.arange(size), label, group))
    new = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])))
    root = np.empty(size, np.int64)
    root[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    _, dense = np.unique(shingles, return_inverse=True)
    marked = np.zeros(len(dense) + 1, bool)
    parent = root.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def confirm(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[fits], j[fits]
        by_row = np.argsort(i, kind="stable")
        i, j = i[by_row], j[by_row]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
            if a == b:
                continue
            x, others = int(i[a]), j[a:b]
            own, many = dense[starts[x] : starts[x] + n[x]], n[others]
            marked[own] = True
            upto = np.cumsum(many)
            for c, d in _runs(upto):  # so many shingles at once that memory doesn't follow the number of candidates
                part, before = others[c:d], upto[c] - many[c]
                begin = upto[c:d] - many[c:d] - before
                at = np.arange(upto[d - 1] - before) + np.repeat(starts[part] - begin, many[c:d])
                both = np.add.reduceat(marked[dense[at]], begin, dtype=np.int64)
                for y in part[both >= SIMILARITY * (n[x] + many[c:d] - both) - 1e-9].tolist():
                    p, q = find(x), find(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        yield x, y
            marked[own] = False
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent[:] = jumped
        root[:] = parent[root]

    first = np.repeat(ends - sizes, sizes)
    for at, own, radius in _likeness_radii(n, sizes):
        near = at[np.bitwise_count(fps[at] ^ fps[first[at]]).sum(axis=1, dtype=np.int64) <= radius]
        links = list(confirm(first[near], near))
        live = root[at]
        held, many, most = [], 0, 1 << 12
        for i, j in close_likenesses(fps[at], own, radius, live, first=False):
            held.append((at[i], at[j]))
            many += len(i)
            if many >= most:
                links += confirm(*(np.concatenate(x) for x in zip(*held)))
                live[:] = root[at]
                held, many, most = [], 0, min(2 * most, 1 << 18)
        if held:
            links += confirm(*(np.concatenate(x) for x in zip(*held)))
        if links:
            yield tuple(np.array(links, np.int64).T)


def _runs(upto: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose cumulated sizes ``upto`` grow by about ``most``, one entry at least."""
    begin = 0
    while begin < len(upto):
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + most, "right")))
        yield begin, end
        begin = end


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, node, label, words, shingles) in order of the first three; yields links (a, b) of ``alike_links``."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(table: np.ndarray, n: np.ndarray, shingles: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(n) - n
        again = np.concatenate(([False], (table[:4, 1:] == table[:4, :-1]).all(axis=0)))  # a repeated row, from another task
        table, n, starts = table[:, ~again], n[~again], starts[~again]
        rows, sizes = _by_group(table)
        nodes = table[3, rows]
        fps = np.ascontiguousarray(table[5:, rows].T).view(np.uint64)
        for i, j in alike_links(table[4, rows], fps, shingles, starts[rows], n[rows], sizes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    for batch in batches:
        sets = batch.column(batch.num_columns - 1)
        held.append((np.stack([c.to_numpy() for c in batch.columns[:-1]]), sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()))
        if sum(t.shape[1] for t, _, _ in held) >= LIKE_ROWS_AT_ONCE or sum(len(s) for _, _, s in held) >= BLOCK_SHINGLES:
            table, n, shingles = np.concatenate([t for t, _, _ in held], axis=1), *(np.concatenate([x[k] for x in held]) for k in (1, 2))
            cut = _last_group(table)
            upto = int(n[:cut].sum())
            if cut:
                yield from links(table[:, :cut], n[:cut], shingles[:upto])
            held = [(table[:, cut:], n[cut:], shingles[upto:])]
    if held:
        yield from links(np.concatenate([t for t, _, _ in held], axis=1), *(np.concatenate([x[k] for x in held]) for k in (1, 2)))


def company(keyed: DataFrame) -> tuple[DataFrame, int]:
    """The buckets of rows (key, node) that have more than one node, as a written table (key, n, first: the smallest node), and how many
    rows ``keyed`` has. Of buckets that hold the same nodes, by their number and 128 bits of hashes, there is one."""
    sums = [F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    own = keyed.groupBy("key").agg(*sums).filter("n > 1").groupBy("n", "first", "x", "y").agg(F.min("key").alias("key"))
    return written(own.select("key", "n", "first"), "buckets"), keyed.count()


def finer_keys(key: Column, fp: Column) -> Column:
    """Four keys for a fingerprint in the bucket ``key`` of ``bucket_keys``: the bits outside the bucket's two blocks are cut into four
    pieces, and of two fingerprints that differ in at most three bits one piece agrees."""
    at = np.concatenate(([0], np.cumsum(BLOCKS)))
    pieces = []
    for pair in itertools.combinations(range(len(BLOCKS)), 2):
        rest = [b for k in range(len(BLOCKS)) if k not in pair for b in range(at[k], at[k + 1])]
        masks = [sum(1 << b for b in rest[len(rest) * q // 4 : len(rest) * (q + 1) // 4]) for q in range(4)]
        pieces.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]))
    own = F.get(F.array(*pieces), F.shiftright(key, 40).cast("int"))
    return F.transform(own, lambda mask, q: F.xxhash64(key, q, fp.bitwiseAND(mask)))


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Stars (a, b) that connect just the fingerprints (column ``fp``, distinct) that links within the radius connect."""

    def placed(rows: DataFrame, i: Column | int = 0, j: Column | int = 0) -> DataFrame:
        cast = [(x if isinstance(x, Column) else F.lit(x)).cast("long") for x in (i, j)]
        return rows.select("key", cast[0].alias("i"), cast[1].alias("j"), "node")

    keyed = distinct.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"))
    buckets, total = company(keyed)
    dealt = placed(by_size(keyed, buckets.filter(F.col("n") <= bucket), "key", total))
    large = buckets.filter(F.col("n") > bucket)
    if not large.isEmpty():
        finer = written(by_size(keyed, large, "key", total).select(F.explode(finer_keys(F.col("key"), F.col("node"))).alias("key"), "node").distinct(), "finer")
        buckets, total = company(finer)
        dealt = dealt.unionByName(placed(by_size(finer, buckets.filter(F.col("n") <= bucket), "key", total)))
        # what is still larger: a piece for each pair of chunks
        rest = by_size(finer, buckets.filter(F.col("n") > bucket), "key", total).withColumn("chunks", F.ceil(F.col("n") / (bucket // 2)).cast("int"))
        rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.expr("filter(sequence(0, chunks - 1), x -> x <> mine)")))
        dealt = dealt.unionByName(placed(rest, F.least("mine", "other") + 1, F.greatest("mine", "other") + 1))
    dealt = dealt.repartition(shuffle_partitions(distinct.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def candidate_links(distinct: DataFrame, bucket: int = LIKE_BUCKET) -> DataFrame:
    """Stars (a, b) that connect the rows (node, w0, w1, ..., keys, n) that may be alike: those within the radius in a bucket, and all of a
    bucket of more than ``bucket`` rows, which costs no comparison. Only rows that have company get their words shuffled."""
    words = [f"w{k}" for k in range(LIKE_WORDS)]
    keyed = distinct.select(F.explode("keys").alias("key"), "node")
    buckets, total = company(keyed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, _candidate_stars, LIKE_ROWS_AT_ONCE)

    few = by_size(keyed, buckets.filter(F.col("n") <= bucket), "key", total).select("key", "node")
    few = few.join(distinct.select("node", "n", *words), "node").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node", "n", *words)
    few = few.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(compare, "a long, b long")
    many = by_size(keyed, buckets.filter(F.col("n") > bucket), "key", total).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return few.unionByName(many.filter("a <> b")).distinct()


def with_sets(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """``needed`` (text_key and others, one row for each key) with the shingle sets of their texts, from ``rows`` (doc_id, hash, text), as a
    written table. A bit filter lets just these and a few others through, so that no other text's set is shuffled, and a task
    gives each set once, however often its row is repeated."""
    spark = needed.sparkSession
    # eight bits a key at least, so that few others come through; the bound is that of the broadcast, and of what the driver gets
    size = max(FILTER_BITS, 1 << min(MOST_FILTER_BITS, 8 * needed.count()).bit_length())
    place = F.pmod("text_key", F.lit(size))
    words = needed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(text_key, 64) as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bits.view(np.uint64))

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = keys % size
            own = np.flatnonzero(sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            own = [r for r, k in zip(own.tolist(), keys[own].tolist()) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(own, pa.int64()))
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["text_key", "shingles"])

    made = rows.select(F.xxhash64("doc_id", "hash").alias("text_key"), "text").mapInArrow(make_sets, "text_key long, shingles array<long>")
    return written(made.join(needed, "text_key"), "sets")


def alike_components(least: DataFrame, rows: DataFrame, bucket: int = LIKE_BUCKET, block: int = BLOCK, few: int = FEW_CHUNKS) -> DataFrame:
    """(node, root) for the nodes of ``least`` that links by ``SIMILARITY`` or more connect with others.

    Candidates' components are blocks in which all pairs are compared and decided by their sets; each set goes to its block once. A
    component of more than ``block`` rows is cut into chunks, each with the same ``HUBS`` rows besides, about. If that doesn't connect all of
    it, what isn't connected with its largest part is compared with all of it in pairs of chunks, where there are ``few``; where there are more, a
    row would be copied too often, and sets meet by the shingles of their prefixes instead (see ``prefixes``), in buckets of which one with more
    than ``block`` rows is compared in pairs of chunks. Neither way leaves out a pair."""
    words, parts = [f"w{k}" for k in range(LIKE_WORDS)], shuffle_partitions(least.sparkSession)
    candidates = components(candidate_links(least, bucket))
    members = written(least.join(candidates, "node").select("node", "root", F.xxhash64("first.doc_id", "first.hash").alias("text_key"), F.col("n").alias("shingles_n"), *words), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles_n").alias("all_n")).withColumn("chunks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int"))
    total = members.count()
    sets = with_sets(written(by_size(members, sizes.drop("all_n"), "root", total), "needed"), rows)

    def confirmed(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("root", F.col("place.i").cast("long").alias("i"), F.col("place.j").cast("long").alias("j"), "node", "label", *words, "shingles")
        dealt = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
        return written(dealt.mapInArrow(_confirm, "a long, b long"), "alike")

    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    hub = (F.col("node") == F.col("root")) | (F.pmod(F.xxhash64("node", F.lit(9)), F.col("n")) < HUBS)
    everywhere = F.expr("transform(sequence(0, chunks - 1), c -> struct(c as i, 0 as j))")
    places = F.when((F.col("chunks") > 1) & hub, everywhere).otherwise(F.array(F.struct(mine.alias("i"), F.lit(0).alias("j"))))
    links = confirmed(sets.withColumn("label", F.col("node")).withColumn("place", F.explode(places)))
    roots = components(links)
    large = sets.filter("chunks > 1")
    if large.isEmpty():
        return roots
    large = large.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = large.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = labels.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("settled"), F.max("n").alias("most"), F.sum("n").alias("n"))
    labels = labels.filter("n > most").withColumn("rest", F.ceil((F.col("n") - F.col("most")) / block).cast("int"))
    still = written(by_size(large.drop("n"), labels, "root", total), "open")
    pairs = still.filter(F.col("chunks") <= few).withColumn("mine", mine).withColumn("other", F.pmod(F.xxhash64("node", F.lit(8)), F.col("rest")).cast("int"))
    settled = F.expr("transform(sequence(0, rest - 1), u -> struct(u as i, mine as j))")
    loose = F.expr("concat(transform(sequence(0, chunks - 1), c -> struct(other as i, c as j)), transform(sequence(0, rest - 1), u -> struct(-1 - least(u, other) as i, greatest(u, other) as j)))")
    more = links.unionByName(confirmed(pairs.withColumn("place", F.explode(F.when(F.col("label") == F.col("settled"), settled).otherwise(loose)))))
    many = still.filter(F.col("chunks") > few).select("root", "node", "label", *words, "shingles")
    if many.isEmpty():
        return components(more)
    keyed = written(prefixes(many), "prefixes")
    sums = [F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.count_if("indexed").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    met = keyed.groupBy("key").agg(*sums).filter("n > 1 and m > 0 and least <> most").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    met = by_size(keyed.select("key", "node"), written(met.select("key", "n"), "buckets"), "key", keyed.count()).withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit(8)), F.col("chunks")).cast("int")
    places = F.transform(F.expr("sequence(0, chunks - 1)"), lambda c: F.struct(F.least(c, own).alias("i"), F.greatest(c, own).alias("j")))
    met = met.withColumn("place", F.explode(places)).select(F.col("key").alias("root"), "place", "node")
    return components(more.unionByName(confirmed(met.join(many.drop("root"), "node"))))


def prefixes(sets: DataFrame) -> DataFrame:
    """Rows (key, node, label, indexed) for sets (root, node, label, shingles): a key for each shingle of a set's prefix, in which two sets of one
    root that are alike by ``SIMILARITY`` or more share one, an indexed one of the smaller (or either, if they are equally large).

    Shingles are taken in one order, rare ones first, counted by ``COUNTERS`` buckets. If sets share o shingles, they share one of the first
    |x| - o + 1 and |y| - o + 1; o is at least t |x| for the larger, and 2 t / (1 + t) |y| for the smaller one. So a fifth of a set looks for a ninth
    of others, and sets that differ in more than a ninth by shingles of their own meet nothing."""
    buckets = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[buckets.column("b").to_numpy()] = buckets.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part, keys, at, indexed = batch.slice(a, 64), [], [], []
                roots = part.column(0).to_numpy().view(np.uint64)
                for r, own in enumerate(part.column(3)):
                    own = own.values.to_numpy()
                    n = len(own)
                    order = own[np.lexsort((own, sent.value[own % COUNTERS]))]
                    looks = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1
                    kept = n - int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9)) + 1
                    keys.append(mixed(order[:looks].view(np.uint64) ^ mixed(roots[r : r + 1])).view(np.int64))
                    at.append(np.full(len(keys[-1]), r))
                    indexed.append(np.arange(len(keys[-1])) < kept)
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(1).take(take), part.column(2).take(take), pa.array(np.concatenate(indexed))], names=["key", "node", "label", "indexed"])

    return sets.select("root", "node", "label", "shingles").mapInArrow(first_ones, "key long, node long, label long, indexed boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node of its component. Rounds go on until all
    are settled, which takes about the logarithm of the largest component's size."""
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "links")
    while True:
        total = edges.count()
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "v"))
        large = by_size(both.filter("u > v"), least, "v", 2 * total).select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u")
        # every pair has its larger node in v now
        own = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = by_size(large, own, "v", total).filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        found = written(moved.unionByName(own.select("v", F.col("m").alias("u"))).filter("v <> u").distinct(), "links")
        discard(edges)
        edges = found
        seen = edges.select(F.col("v").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        loose = seen.groupBy("x").agg(F.sum("child").alias("n"), F.max("root").alias("r")).filter("n > 1 or (n > 0 and r > 0)")
        if loose.isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """From rows (fp, doc_id): one row for each fingerprint with its component's smallest doc_id (null if it has none but
    null ids) and the number of its rows: columns fp, component_id, n."""
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(fingerprint_links(least.select("fp")))
    joined = written(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "roots")
    discard(least)
    sizes = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = by_size(joined.withColumnRenamed("n", "rows"), sizes, "root", joined.count())
    return written(found.select("fp", "component_id", F.col("rows").alias("n")), "components")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id: the smallest doc_id that can be reached over
    links, its own included. A null or empty text, or one of white space, has fingerprint zero and links like any other.
    Equal rows give equal rows; rows whose id is null take part, and their component_id is null if no row of their
    component has an id. An empty table gives no rows. Other columns are not read."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    fps = written(with_fingerprints(rows, "text", "doc_id long"), "documents")
    with Scratch() as scratch:
        components_of = scratch.keep(fingerprint_components(fps))
    found = by_size(fps, components_of, "fp", fps.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each group of near copies does: the one of the
    smallest id, ids of null last; among equal ids the one of the smallest hash of the text; of equal rows one. Groups are
    components of links between texts whose sets of five-word shingles are alike by ``SIMILARITY`` or more; a pair at 0.8 is found
    with a probability of 0.9996 (see ``BANDS``), and none below is linked. Texts of fewer words are alike if their words are equal; null, empty and blank texts are one group.
    An empty table gives an empty one."""
    own = "__folio_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    key = [F.col(id_column).cast("long").alias(f"{own}id"), F.xxhash64(F.col(text_column)).alias(f"{own}hash")]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column)).alias("hash"), F.col(text_column).alias("text"))
    words = [f"w{k}" for k in range(LIKE_WORDS)]
    with Scratch() as scratch:
        fps = written(with_likeness(rows, "text", "doc_id long, hash long"), "documents")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
        same = [F.any_value(c).alias(c) for c in (*words, "keys", "n")]
        least = written(fps.groupBy(F.xxhash64(*words, "keys").alias("node")).agg(first, *same), "fingerprints")
        repeats = fps.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        repeats, total = scratch.keep(written(repeats.select(F.col("doc_id").alias(f"{own}id"), F.col("hash").alias(f"{own}hash"), "n"), "repeats")), fps.count()
        discard(fps)
        roots = alike_components(least, rows)
        first = least.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        stays = scratch.keep(written(first.select(F.col("first.doc_id").alias(f"{own}id"), F.col("first.hash").alias(f"{own}hash")), "stays"))
    found = _rows_once(docs.select("*", *key), stays, repeats, total, [f"{own}id", f"{own}hash"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def _rows_once(rows: DataFrame, stays: DataFrame, repeats: DataFrame, total: int, key: list[str]) -> DataFrame:
    """One row for each key of ``stays``. Only rows whose key is repeated (``repeats``: key, n) are grouped; those of a key with a large
    share of the ``total`` rows, of which ``heavy_keys`` bounds the number, are combined before they move."""

    def among(left: DataFrame, right: DataFrame, how: str = "left_semi") -> DataFrame:
        right = right.select(*[F.col(c).alias(f"{c}_") for c in key])
        return left.join(right, F.col(key[0]).eqNullSafe(F.col(f"{key[0]}_")) & F.col(key[1]).eqNullSafe(F.col(f"{key[1]}_")), how)

    if repeats.isEmpty():
        return among(rows, stays)
    heavy, others = heavy_keys(repeats, total), rows
    if heavy is not None:
        others = among(rows, F.broadcast(heavy), "left_anti")
    others = among(others, stays)
    found = among(others, repeats, "left_anti").unionByName(among(others, repeats).dropDuplicates(key))
    if heavy is not None:
        found = found.unionByName(among(rows, F.broadcast(among(heavy, stays))).dropDuplicates(key))
    return found
