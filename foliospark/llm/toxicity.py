"""Toxicity by a classifier chain: one linear model for each category, in order, each also given the probabilities of the
categories before it.

A text's features are its words (runs of letters, lower case) hashed into ``BUCKETS`` buckets, with the square root of their share
in the text, so length doesn't matter. A later model must not learn from probabilities that an earlier one gave to rows it was fitted on:
the training rows are dealt into ``FOLDS`` folds by a hash of their ids, and each fold's probabilities come from a model fitted on
the other folds, its features chosen there too. Those out-of-fold probabilities also set each category's threshold: the least
of those that gain most, a row with the label caught counting one and one without it caught counting minus ``CLEAN_WEIGHT``.

Fitted on at most ``TRAIN_DOCUMENTS`` labelled ids, chosen by a hash of them, with one document each. Statistics of words are summed by
the tasks, and each model is fitted by a task; the driver gets chosen features, weights and two numbers for each training row.
Prediction covers every row and whole texts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, written

BUCKETS, TRAIN_DOCUMENTS, FOLDS = 1 << 18, 16_000, 5
#: Features of a model: most telling for the label, and against it (found by tasks, then among what they found); a feature occurs in so many training rows at least.
FEATURES_FOR, FEATURES_AGAINST, LEAST_ROWS = 4000, 500, 3
CLEAN_WEIGHT, LEAST_THRESHOLD = 10, 0.15
PENALTY, STEPS = 1e-4, 300
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a very long text that are split at once.
_CHARS = 1 << 20


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values; none for a text that is null or has no letter."""
    counted: Counter[str] = Counter()
    rest, text = "", (text or "").lower()
    for i in range(0, len(text), _CHARS):
        words = _WORD.findall(rest + text[i : i + _CHARS])
        rest = words.pop() if words and i + _CHARS < len(text) and text[i + _CHARS - 1].isalpha() else ""
        counted.update(words)
    total = sum(counted.values())
    if not total:
        return np.zeros(0, np.int32), np.zeros(0)
    found = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in counted), np.int64, len(counted))
    buckets, at = np.unique(found, return_inverse=True)
    tf = np.bincount(at, np.fromiter(counted.values(), np.float64, len(counted)))
    return buckets.astype(np.int32), np.sqrt(50 * tf / total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Welch-like t of each bucket between rows with the label and without. n: rows by label; sums: buckets by label."""
    if not n.all():
        return np.zeros(len(rows))
    mean = sums.sum(axis=1) / n.sum()
    spread = squares / n.sum() - mean * mean + 1e-12
    t = (sums[:, 1] / n[1] - sums[:, 0] / n[0]) / np.sqrt(spread * (1 / n[0] + 1 / n[1]))
    t[rows < LEAST_ROWS] = 0
    return t


def chosen(t: np.ndarray) -> np.ndarray:
    order = np.argsort(-t, kind="stable")
    high, low = order[:FEATURES_FOR], order[::-1][:FEATURES_AGAINST]
    return np.sort(np.concatenate((high[t[high] > 0], low[t[low] < 0])))


def threshold(held: np.ndarray, y: np.ndarray) -> float:
    """See above; 1, which catches nothing, if no threshold gains anything."""
    order = np.argsort(-held, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0, 1, -CLEAN_WEIGHT))
    last = np.append(np.diff(held[order]) != 0, True) if len(held) else np.zeros(0, bool)  # equal ones are caught together
    gain = np.where(last, gain, -np.inf)
    if not len(gain) or gain.max() <= 0:
        return 1.0
    at = int(np.flatnonzero(gain == gain.max())[-1])
    below = held[order][at + 1] if at + 1 < len(held) else 0.0
    return float(min(max(below, LEAST_THRESHOLD), held[order][at] * (1 - 1e-12)))


@dataclass
class Linear:
    """Weights of buckets, of the categories before, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logit(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        own = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        return np.bincount(row[own], value[own] * self.weights[at[own]], len(before)) + before @ self.chain + self.bias


def fit_linear(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, before: np.ndarray, y: np.ndarray, picked: tuple[np.ndarray, np.ndarray]) -> Linear:
    """Logistic regression by accelerated gradient steps; a feature's scale is its absolute t, so the penalty holds the less
    telling ones down."""
    own, t = picked
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Linear(own[:0], np.zeros(0), np.zeros(before.shape[1]), bias)
    scale = np.abs(t)
    at = np.searchsorted(own, bucket)
    at[at == len(own)] = 0
    kept = (own[at] == bucket) if len(own) else np.zeros(len(bucket), bool)
    row, at, value = row[kept], at[kept], value[kept]
    v = value * scale[at]
    n, k = len(y), before.shape[1]
    size = np.bincount(row, v * v, n) + (before * before).sum(axis=1)
    step = 1 / (0.25 * np.percentile(size, 99) + PENALTY)
    w, m = np.zeros(len(own) + k), np.zeros(len(own) + k)
    b = mb = bias
    for i in range(STEPS):
        g = _sigmoid(np.bincount(row, v * m[at], n) + before @ m[len(own) :] + mb) - y
        grad = np.concatenate((np.bincount(at, v * g[row], len(own)), before.T @ g)) / n + PENALTY * m
        new, new_b = m - step * grad, mb - 4 * g.mean()
        pull = i / (i + 3)
        m, mb = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return Linear(own, w[: len(own)] * scale, w[len(own) :], float(b))


@dataclass
class ToxicityChain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Texts x categories."""
        found = [features(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(b) for b, _ in found])
        bucket, value = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack((out, _sigmoid(model.logit(row, bucket, value, out))))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int, *, id_column: str, text_column: str, label_id: str) -> DataFrame:
    """id, text, fold, y0, y1, ...: one row for each of at most ``most`` labelled ids, however often its document or label is repeated; of
    several texts of an id the least one by its hash counts, of several labels the largest values."""
    flags = [c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    ys = [f"y{i}" for i in range(len(categories))]
    own = labels.select(F.col(label_id).cast("long").alias("label_id"), *flags).dropna()
    own = own.groupBy("label_id").agg(*[F.max(y).alias(y) for y in ys])
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    # at most ``most`` rows of a few numbers are broadcast; a repeated document is folded by the tasks before it moves
    rows = texts.join(F.broadcast(own), F.col("id") == F.col("label_id"))
    rows = rows.groupBy("id", *ys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return rows.select("id", F.col("least.text").alias("text"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"), *ys)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_column: str = "doc_id", text_column: str = "text", label_id: str = "doc_id", most: int = TRAIN_DOCUMENTS) -> ToxicityChain:
    """A chain of ``categories`` (name: condition on ``labels``, in order). A label row whose id or any condition is null is
    left out, of several for an id the largest values count, of several documents of an id one does. Without any labelled
    document each probability is the same.

    Words of the training rows are hashed once and written. A model is fitted by one task, on the training rows' chosen features, all
    models of a category at once; the driver gets the fitted weights."""
    spark, names, k = docs.sparkSession, list(categories), len(categories)
    ys = [f"y{i}" for i in range(k)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *lists], names=[batch.schema.names[0], *batch.schema.names[2:], "b", "v"])

    with Scratch():
        chosen_rows = training_rows(docs, labels, categories, most, id_column=id_column, text_column=text_column, label_id=label_id)
        data = written(chosen_rows.mapInArrow(hashed, "id long, fold int, " + ", ".join(f"{y} int" for y in ys) + ", b array<int>, v array<double>"), "training")
        sizes = np.zeros((FOLDS, k, 2))
        for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).collect():
            for c in range(k):
                sizes[r["fold"], c] = r["n"] - r[f"y{c}"], r[f"y{c}"]
        ranked = written(_features_of_models(data, sizes, k), "features")
        out, held = ToxicityChain(names), None
        for c in range(k):
            fitted, held = _fit_category(data, ranked, c, held)
            model, found = fitted
            out.models.append(model)
            out.thresholds.append(found)
    return out


def _features_of_models(data: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """(model, bucket, t): the chosen features of each model; model number fold * k + c leaves that fold out, FOLDS * k + c none.
    ``sizes``: rows by fold, category and label."""
    cols = [f"s{i}" for i in range(3 + k)]  # rows, squares, sums with each label, all sums

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, BUCKETS, 3 + k), np.float32)
        for batch in batches:
            lists = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            many = lists[0].value_lengths().to_numpy().astype(np.int64)
            bucket, value = (x.flatten().to_numpy() for x in lists)
            fold = np.repeat(batch.column(0).to_numpy(), many)
            at = (fold.astype(np.int64) * BUCKETS + bucket) * (3 + k)
            flat = sums.reshape(-1)
            np.add.at(flat, at, np.float32(1))
            np.add.at(flat, at + 1, (value * value).astype(np.float32))
            np.add.at(flat, at + 2 + k, value.astype(np.float32))
            for c in range(k):
                np.add.at(flat, at + 2 + c, (value * np.repeat(batch.column(1 + c).to_numpy(), many)).astype(np.float32))
        fold, bucket = np.nonzero(sums[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(bucket.astype(np.int32)), *map(pa.array, sums[fold, bucket].T.copy())], names=["fold", "bucket", *cols])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's buckets, those that can be among the chosen ones of a model."""
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if len(batch)]
        if not held:
            return
        table = np.concatenate(held, axis=1)
        bucket, own = table[0].astype(np.int32), table[1:].reshape(FOLDS, len(cols), -1)
        for f in range(FOLDS + 1):
            keep = [x for x in range(FOLDS) if x != f]
            s = own[keep].sum(axis=0)
            for c in range(k):
                t = telling(sizes[keep, c].sum(axis=0), np.stack((s[-1] - s[2 + c], s[2 + c]), axis=1), s[1], s[0])
                at = chosen(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f * k + c, np.int32)), pa.array(bucket[at]), pa.array(t[at])], names=["model", "bucket", "t"])

    stats = data.select("fold", *[f"y{i}" for i in range(k)], "b", "v").mapInArrow(summed, "fold int, bucket int, " + ", ".join(f"{c} float" for c in cols))
    wide = stats.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0.0)).alias(f"{c}_{f}") for f in range(FOLDS) for c in cols])
    ranked = wide.mapInArrow(best, "model int, bucket int, t double")
    place = F.row_number().over(Window.partitionBy("model", F.col("t") > 0).orderBy(F.desc(F.abs("t")), "bucket"))
    ranked = ranked.select("*", place.alias("place")).filter(F.when(F.col("t") > 0, F.col("place") <= FEATURES_FOR).otherwise(F.col("place") <= FEATURES_AGAINST))
    return ranked.select("model", "bucket", "t")


def _fit_category(data: DataFrame, ranked: DataFrame, c: int, before: DataFrame | None) -> tuple[tuple[Linear, float], DataFrame]:
    """The model of category ``c`` and its threshold, and (id, p0, ..., pc): out-of-fold probabilities of the training rows up to it.
    ``before`` has those of the categories before. Each model is one task's work, on its chosen features of the training rows, which
    are as many as ``fit`` was given at most."""
    k = sum(x.startswith("y") for x in data.columns)
    earlier = [f"p{i}" for i in range(c)]
    rows = data.join(before, "id") if before is not None else data
    tops = ranked.filter(F.pmod("model", F.lit(k)) == c).select((F.col("model") / k).cast("int").alias("without"), "bucket", "t")
    # chosen features of one category: (FOLDS + 1) x (FEATURES_FOR + FEATURES_AGAINST) rows at most
    found = tops.toArrow()
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f in range(FOLDS + 1):
        at = found.column("without").to_numpy() == f
        bucket, t = found.column("bucket").to_numpy()[at].astype(np.int64), found.column("t").to_numpy()[at]
        order = np.argsort(bucket)
        models[f] = bucket[order], t[order]
    wanted = np.zeros(BUCKETS, bool)
    for bucket, _ in models.values():
        wanted[bucket] = True
    sent = data.sparkSession.sparkContext.broadcast((models, wanted))

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            many = batch.column(n - 2).value_lengths().to_numpy().astype(np.int64)
            bucket, value = (batch.column(n - 2 + i).flatten().to_numpy() for i in (0, 1))
            own = sent.value[1][bucket]
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(np.append(own, False), np.minimum(np.cumsum(many) - many, len(own)), dtype=np.int64) * (many > 0)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[own])) for x in (bucket, value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *lists], names=batch.schema.names)

    cut = rows.select("id", "fold", f"y{c}", *earlier, "b", "v").mapInArrow(restricted, f"id long, fold int, y{c} int, " + "".join(f"{p} double, " for p in earlier) + "b array<int>, v array<double>")
    dealt = written(cut, "restricted").withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionById(FOLDS + 1, F.col("without")).sortWithinPartitions("id")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A model leaves its fold out and gives that fold's probabilities; the last one leaves none out and gives its weights."""
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        without = table.column("without")[0].as_py()
        ids, fold, y = (table.column(x).to_numpy() for x in ("id", "fold", f"y{c}"))
        chain = np.stack([table.column(p).to_numpy() for p in earlier], axis=1) if earlier else np.zeros((len(ids), 0))
        lists = [table.column(x).combine_chunks() for x in ("b", "v")]
        many = lists[0].value_lengths().to_numpy().astype(np.int64)
        row, bucket, value = np.repeat(np.arange(len(ids)), many), lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy()
        inside = fold != without
        to, use = np.cumsum(inside) - 1, inside[row]
        model = fit_linear(to[row[use]], bucket[use], value[use], chain[inside], y[inside].astype(np.float64), sent.value[0][without])
        if without < FOLDS:
            out = ~inside
            p = _sigmoid(model.logit(row, bucket, value, chain))[out]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(out.sum(), without, np.int32)), pa.array(ids[out]), pa.array(p), pa.array(y[out])], names=["without", "id", "p", "y"])
        else:
            weights = np.concatenate((model.weights, model.chain, [model.bias]))
            places = np.concatenate((model.buckets, -1 - np.arange(len(model.chain)), [-BUCKETS]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(weights), FOLDS, np.int32)), pa.array(places), pa.array(weights), pa.array(np.zeros(len(weights), np.int32))], names=["without", "id", "p", "y"])

    results = written(dealt.mapInArrow(fitted, "without int, id long, p double, y int"), "fitted")
    weights = results.filter(F.col("without") == FOLDS).select("id", "p").toArrow().sort_by("id")
    places, w = weights.column("id").to_numpy(), weights.column("p").to_numpy()
    if not len(places):
        return (Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(c), float(np.log(1e-4 / (1 - 1e-4)))), 1.0), results.select("id", *[F.lit(0.0).alias(f"p{i}") for i in range(c + 1)])
    words, chain = places >= 0, (places < 0) & (places > -BUCKETS)
    model = Linear(places[words], w[words], w[chain][::-1].copy(), float(w[places == -BUCKETS][0]))
    # two numbers for each training row
    held = results.filter(F.col("without") < FOLDS).select("p", "y").toArrow()
    own = results.filter(F.col("without") < FOLDS).select("id", F.col("p").alias(f"p{c}"))
    return (model, threshold(held.column("p").to_numpy(), held.column("y").to_numpy().astype(np.float64))), own if before is None else before.join(own, "id")


def score(docs: DataFrame, chain: ToxicityChain, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category in order, and is_<last category>: whether its probability is above its
    threshold. One row for each row, repeated ones too; a null id stays null; a null text has the features of an empty one: none.
    An empty table gives no rows; other columns are not read."""
    sent, names = docs.sparkSession.sparkContext.broadcast(chain), [f"p_{c}" for c in chain.categories]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T]], names=["doc_id", *names])

    scored = rows.mapInArrow(predict, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))
    return scored.withColumn(f"is_{chain.categories[-1]}", F.col(f"`{names[-1]}`") > chain.thresholds[-1])


def keep_clean(docs: DataFrame, chain: ToxicityChain, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose last category isn't above its threshold. A null or empty text has no features and so the
    chain's plain probability; equal rows stay or go together; an empty table gives an empty one."""
    sent, schema, at = docs.sparkSession.sparkContext.broadcast(chain), docs.schema, docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(batch.column(at).to_pylist())
            yield batch.filter(pa.array(p[:, -1] <= sent.value.thresholds[-1]))

    return docs.mapInArrow(keep, schema)


def label_categories() -> dict[str, Column]:
    """The categories that the table ``labels`` has, in the order of the chain."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
