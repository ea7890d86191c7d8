"""Nearest neighbours by largest inner product: inverted lists, scanned with an adaptive number of dimensions.

Each vector gets one more component, the root of (M**2 - its squared length) with M the largest length, so that the nearest in distance
has the largest inner product. A random rotation spreads the distance evenly over dimensions. k-means on a bounded sample gives the
lists' centroids; every row is indexed. A list is stored as column blocks of ``COLUMNS`` rotated dimensions: after each block a
hypothesis test compares the distance that the dimensions so far predict with the bound of the query's k-th neighbour, and drops
the candidate if it is too far by more than ``EPSILON`` allows. What is left is scored on the original vectors in double
precision. The bound comes from a part of the sample, whose rows are candidates themselves.

The number of probed lists is the least that finds ``TARGET`` of the neighbours of sampled queries, whatever the table's size. A list of
more than ``BLOCK`` vectors is cut into blocks, dealt by a hash, so one hot list is many tasks; a query goes to every block of its
lists. Repeated rows are folded before they are indexed. A query that has found fewer than k although there are more candidates
is searched again in all lists, without a test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, discard, shuffle_partitions, written

SAMPLE_ROWS, SAMPLE_BYTES, MOST_LISTS, LIST_BYTES = 16_384, 32 << 20, 16_384, 64 << 20
BLOCK, QUERIES_AT_ONCE, COLUMNS = 4096, 256, 16
#: Rows of the sample that bound the k-th neighbour; a quarter of all rows at most, so that even of a query whose nearest lie in
#: lists that aren't probed enough others pass.
BOUND_ROWS = 16_384
EPSILON, TARGET, SEED, ROUNDS, JUDGES = 2.1, 0.975, 7, 8, 512


def usable(vector: Column) -> Column:
    """Whether all components are finite and one isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Space:
    """The rotated space of vectors with one more component, and the centroids in it."""

    def __init__(self, dim: int, largest: float, sample: np.ndarray, lists: int):
        random = np.random.default_rng(SEED)
        self.largest = largest
        self.rotation = np.linalg.qr(random.standard_normal((dim + 1, dim + 1)))[0]
        points = self.base(sample)
        self.centroids = self._kmeans(points, min(lists, len(points)), random)
        own = self.nearest(points)
        n = np.bincount(own, minlength=len(self.centroids))
        away = np.einsum("ij,ij->i", points, points) + self.distances(points)[np.arange(len(points)), own] if len(points) else np.zeros(0)
        self.spread = np.bincount(own, np.maximum(away, 0), len(self.centroids)) / np.maximum(n, 1)
        self.luck = np.sqrt(2 * np.log(n + 2) / (dim + 1))

    def base(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.largest - np.einsum("ij,ij->i", x, x)))
        return np.column_stack((x, rest)) @ self.rotation

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.zeros(len(x)))) @ self.rotation

    def _kmeans(self, points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
        centers = points[random.choice(len(points), k, replace=False)]
        for _ in range(ROUNDS):
            self.centroids = centers
            own = self.nearest(points)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, points)
            n = np.bincount(own, minlength=k)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        return centers

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To the centroids, less the points' own squared lengths."""
        return np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * points @ self.centroids.T

    def promise(self, queries: np.ndarray) -> np.ndarray:
        """What squared distance the nearest member of each list may have: a member lies off the centroid by the list's spread, and
        the luckiest of n members has a direction of about sqrt(2 log n / dimensions) towards the query. A tight list far away
        can so come before a wide one nearby."""
        far = np.maximum(0.0, np.einsum("ij,ij->i", queries, queries)[:, None] + self.distances(queries))
        return far + self.spread - 2 * np.sqrt(far * self.spread) * self.luck

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(points[i : i + 2048]).argmin(axis=1) for i in range(0, len(points), 2048)] or [np.zeros(0, np.int64)])


def probes_needed(space: Space, sample: np.ndarray, total: int, k: int) -> int:
    """The least number of lists that hold TARGET of the sampled queries' neighbours. Of ``total`` rows a sample holds its share of
    the k nearest, so as many neighbours are looked for."""
    judges = sample[:: max(1, len(sample) // JUDGES)]
    want = max(1, round(k * len(sample) / max(total, 1)))
    if len(sample) <= want + 1:
        return len(space.centroids)
    scores = judges @ sample.T
    scores[np.arange(len(judges)), np.arange(0, len(sample), max(1, len(sample) // JUDGES))] = -np.inf
    near = np.argpartition(-scores, want, axis=1)[:, :want]
    rank = space.promise(space.query(judges)).argsort(axis=1).argsort(axis=1)
    found = rank[np.arange(len(judges))[:, None], space.nearest(space.base(sample))[near]]
    return int(np.quantile(found, TARGET, method="higher")) + 1


def scan(space: Space, ids: np.ndarray, vectors: np.ndarray, columns: list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of one block for each query, as rows of (query, id, score), each id with its best row. ``bounds``: a score
    that k candidates reach."""
    rotated, dim = space.query(queries), space.rotation.shape[0]
    # squared distances; a little slack keeps ties
    most = (np.einsum("ij,ij->i", queries, queries) + space.largest - 2 * bounds) * (1 + 1e-9) + 1e-12
    q = x = None  # pairs that are left; None: all
    part, done = np.zeros((len(queries), len(ids))), 0
    for block in columns:
        width = block.shape[1]
        own = rotated[:, done : done + width]
        if q is None:
            part += np.einsum("ij,ij->i", own, own)[:, None] + np.einsum("ij,ij->i", block, block) - 2 * own @ block.T
        else:
            d = own[q] - block[x]
            part = part + np.einsum("ij,ij->i", d, d)
        done += width
        far = (1 + epsilon / np.sqrt(done)) ** 2 * done / dim if done < dim else 1 + 1e-9
        if q is None:
            left = part <= (most * far)[:, None]
            if left.mean() < 0.25 or done == dim:
                q, x = np.nonzero(left)
                part = part[q, x]
        else:
            left = part <= most[q] * far
            q, x, part = q[left], x[left], part[left]
    own = ids[x] != query_ids[q]
    q, x = q[own], x[own]
    score = np.empty(len(q))
    for i in range(0, len(q), 65536):
        score[i : i + 65536] = (queries[q[i : i + 65536]] * vectors[x[i : i + 65536]]).sum(axis=1)
    order = np.lexsort((-score, ids[x], q))
    q, x, score = q[order], x[order], score[order]
    best = np.ones(len(q), bool)
    best[1:] = (q[1:] != q[:-1]) | (ids[x[1:]] != ids[x[:-1]])
    q, x, score = q[best], x[best], score[best]
    order = np.lexsort((ids[x], -score, q))
    q, x, score = q[order], x[order], score[order]
    first = np.searchsorted(q, q, "left")
    top = np.arange(len(q)) - first < k
    return query_ids[q[top]], ids[x[top]], score[top]


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 20, *, id_column: str = "vec_id", vector_column: str = "embedding", lists: int | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with ``is_query``, the k nearest found among all other rows, or all of
    them if there are fewer; ties to the smaller vec_id. ``exact`` searches all lists and abandons nothing.

    A vector that is null, zero, of another length than most, or that holds a null or a component that isn't finite, takes no part, nor
    does a row with a null id. Rows of one id are one candidate, with the best of their scores, and one query, if one of them is.
    An empty table gives no rows. Other columns are not read."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q"))
    with Scratch() as scratch:
        folded = written(rows, "vectors")
        sizes = folded.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
        if not sizes:
            return spark.createDataFrame([], FOUND)
        dim, total, largest = sizes[0]["dim"], sizes[0]["n"], sizes[0]["largest"]
        index = Index(folded.filter(F.size("v") == dim), dim, total, largest, k, lists)
        discard(folded)
        found = index.search(index.rows.filter("q"), len(index.space.centroids) if exact else probes or index.probes, np.inf if exact else EPSILON, exact)
        found = scratch.keep(written(found, "neighbours"))
        # a query has k neighbours, or all the other ids
        whole = min(k, index.ids - 1)
        n = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        short = written(index.rows.filter("q").join(n, "id", "left").filter(F.coalesce("n", F.lit(0)) < whole).select("id", "v"), "short")
        if short.isEmpty() or exact:
            return found
        again = scratch.keep(written(index.search(short, len(index.space.centroids), np.inf, True), "neighbours"))
        return found.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)


FOUND = "query_id long, rank int, vec_id long, score double"


class Index:
    """Inverted lists over distinct rows (id, v, q): ``rows``, a written table with the list of each."""

    def __init__(self, rows: DataFrame, dim: int, total: int, largest: float, k: int, lists: int | None):
        self.spark, self.k = rows.sparkSession, k
        self.ids = rows.select("id").distinct().count()
        most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        share = min(1.0, 1.05 * most / total)
        drawn = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").limit(most).toArrow()
        if not drawn.num_rows:
            drawn = rows.select("id", "v").limit(most).toArrow()
        drawn = drawn.sort_by("id")
        sample_ids, sample = drawn.column("id").to_numpy(), _rows(drawn.column("v").combine_chunks())
        self.space = Space(dim, largest, sample, lists or max(1, min(MOST_LISTS, LIST_BYTES // (8 * (dim + 1)), round(total**0.5))))
        one_each = np.unique(sample_ids, return_index=True)[1]
        self.probes = probes_needed(self.space, sample[one_each], self.ids, k)
        step = max(1, -(-len(sample) // max(1, min(BOUND_ROWS, total // 4))))
        self.sent = sent = self.spark.sparkContext.broadcast((self.space, sample_ids[::step], sample[::step]))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = sent.value[0].nearest(sent.value[0].base(_rows(batch.column(1))) if len(batch) else np.zeros((0, dim + 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "v", "q", "list"])

        self.rows = written(rows.select("id", "v", "q").mapInArrow(assign, "id long, v array<double>, q boolean, list int"), "index")
        # one row for each list
        blocks = np.ones(len(self.space.centroids), np.int64)
        for r in self.rows.groupBy("list").count().collect():
            blocks[r["list"]] = max(1, -(-r["count"] // BLOCK))
        self.first_block = np.concatenate(([0], np.cumsum(blocks)))
        self.many = self.spark.sparkContext.broadcast((self.first_block, blocks))

    def search(self, asked: DataFrame, probes: int, epsilon: float, unbounded: bool) -> DataFrame:
        """The k nearest of each of the rows ``asked`` (id, v) in its ``probes`` best lists; ``unbounded`` starts without a bound."""
        sent, many, k = self.sent, self.many, self.k

        def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, n = many.value
            for batch in batches:
                own = batch.column(2).to_numpy()
                at = first[own] + batch.column(3).to_numpy() % n[own]
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), pa.array(np.full(len(batch), np.nan)), batch.column(1)], names=["block", "id", "bound", "v"])

        def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (first, n), (space, sample_ids, sample) = many.value, sent.value
            begin = np.unique(sample_ids, return_index=True)[1]  # rows of one id are one candidate, and ids ascend
            for batch in batches:
                for i in range(0, len(batch), 512):
                    part = batch.slice(i, 512)
                    ids, v = part.column(0).to_numpy(), _rows(part.column(1))
                    scores = v @ sample.T
                    scores[ids[:, None] == sample_ids] = -np.inf
                    if len(begin) < len(sample_ids):
                        scores = np.maximum.reduceat(scores, begin, axis=1)
                    bound = np.full(len(v), -np.inf)
                    if scores.shape[1] > k and not unbounded:
                        bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                        bound -= np.where(np.isfinite(bound), 1e-9 * (np.abs(bound) + 1), 0)
                    chosen = np.argsort(space.promise(space.query(v)), axis=1)[:, :probes]
                    row = np.repeat(np.arange(len(v)), n[chosen].sum(axis=1))
                    at = np.concatenate([np.arange(first[c], first[c] + n[c]) for own in chosen for c in own]) if len(v) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[row]), pa.array(bound[row]), part.column(1).take(pa.array(row))], names=["block", "id", "bound", "v"])

        kept = "block long, id long, bound double, v array<double>"
        salt = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("salt")
        members = self.rows.select("id", "v", "list", salt).mapInArrow(to_block, kept).withColumn("kind", F.lit(0))
        questions = asked.select("id", "v").mapInArrow(to_probes, kept).withColumn("kind", F.lit(1))
        dealt = members.unionByName(questions).repartition(max(shuffle_partitions(self.spark), int(self.first_block[-1]) // 64), "block").sortWithinPartitions("block", "kind", "id")

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, at = sent.value[0], None
            held: list[tuple[np.ndarray, np.ndarray]] = []  # the block's members as they come
            ids = vectors = columns = None

            for batch in batches:
                block, own_ids, bound, v, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _rows(batch.column(3)), batch.column(4).to_numpy()
                cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(block)]):
                    if a == b:
                        continue
                    if block[a] != at:
                        at, held, ids = block[a], [], None
                    if kind[a] == 0:
                        held.append((own_ids[a:b], v[a:b]))
                        continue
                    if not held:
                        continue
                    if ids is None:
                        ids, vectors = (np.concatenate(x) for x in zip(*held))
                        rotated = space.base(vectors)
                        columns = [np.ascontiguousarray(rotated[:, i : i + COLUMNS]) for i in range(0, rotated.shape[1], COLUMNS)]
                    for s in range(a, b, QUERIES_AT_ONCE):
                        e = min(b, s + QUERIES_AT_ONCE)
                        found = scan(space, ids, vectors, columns, own_ids[s:e], v[s:e], bound[s:e], k, epsilon)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        found = dealt.mapInArrow(scanned, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
