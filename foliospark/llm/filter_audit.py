"""Filter interaction audit: what each of five filters removes, in every order that they may be applied in.

Filters that apply to a document one after another are a walk up the lattice of their subsets: an edge leads from the filters already
applied to those and the next one. There are 80 edges (5 filters, each after any of 16 subsets of the others) and 600 steps of 120 orders, and
a step's counts are those of its edge. So documents are counted by which filters they fail, those counts are added up along the 80 edges
once, and the edges are joined to the 600 steps.

One scan reads the texts and keeps a few bytes of each document; what is shuffled after that doesn't hold texts, and is summed before it is
shuffled, so that neither a text that a third of all documents share nor a part that holds them all is work for one task."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A: fewer words; B: a smaller share of distinct words, in percent; C: a larger share of capitals, in percent; D: any of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
#: The filter that needs other documents (E: the text of a document with a smaller id), as a bit like the others.
REPEATED = 1 << 4


def text_failures(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """For each row: its id, its part (null: empty), the SHA-256 of its text (null: empty), and ``failing``, a bit for each of the first
    four filters that the whole text fails. A map over rows; equal rows give equal rows, other columns aren't read."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select("*", F.split("text", r"[\x20\x09-\x0D]+").alias("pieces"))
    # White space at either end leaves an empty piece there, and nowhere else.
    head, tail = (F.element_at("pieces", 1) == "").cast("int"), ((F.size("pieces") > 1) & (F.element_at("pieces", -1) == "")).cast("int")
    words, distinct = F.size("pieces") - head - tail, F.size(F.array_distinct("pieces")) - F.greatest(head, tail)
    capitals, size = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long"), F.length("text").cast("long")
    fails = [words < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * words.cast("long"), 100 * capitals > MOST_CAPITALS * size, F.col("text").rlike(MARKS)]
    failing = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("identity"), failing.cast("int").alias("failing"))


def failure_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of text_failures, counted: a row for each part, set of failed filters (E included) and labels, with its ``n`` documents.

    A row fails E if another row of any part has its text and a smaller id; equal ids don't count, a null id is neither smaller nor larger.
    Labels of one id add up: good if any has quality 1, toxic if any has toxic 1; an id without labels is neither. Rows are
    summed by id, text and part first, then by text and part, so a text's copies meet as a row for each part they are in."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.filter((F.col("good") == 1) | (F.col("toxic") == 1))
    once = rows.groupBy("doc_id", "identity", "part", "failing").agg(F.count("*").alias("n"))
    marked = once.join(marks, "doc_id", "left").select(*once.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    alike = marked.groupBy("identity", "part", "failing", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    alike = alike.withColumn("smallest", F.expr("min(least) OVER (PARTITION BY identity)"))
    first = F.col("without_id") + F.when(F.col("least") == F.col("smallest"), F.col("at_least")).otherwise(0)
    split = F.array(F.struct("failing", first.alias("n")), F.struct(F.col("failing").bitwiseOR(REPEATED).alias("failing"), (F.col("n") - first).alias("n")))
    both = alike.select("part", "good", "toxic", F.inline(split)).filter(F.col("n") > 0)
    return both.groupBy("part", "failing", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``counts`` of failure_counts along the edges of the lattice: a row for each part, set of filters already applied and next filter (bits
    both), zeros included."""
    size = len(filters)
    edges = [(applied, 1 << i) for i in range(size) for applied in range(1 << size) if not applied >> i & 1]
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next")) for a, f in edges])).alias("edge")
    at = counts.select("*", every).select("part", "failing", "good", "toxic", "n", "edge.*")
    fails, removed_before = F.col("failing").bitwiseAND(F.col("next")) != 0, F.col("failing").bitwiseAND(F.col("applied")) != 0

    def total(condition) -> F.Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return at.groupBy("part", "applied", "next").agg(
        total(~fails & ~removed_before).alias("kept"), total(fails & ~removed_before).alias("removed"), total(fails & removed_before).alias("redundant"),
        total(F.col("failing") == F.col("next")).alias("unique_fails"), total(fails & ~removed_before & (F.col("good") == 1)).alias("good_lost"),
        total(fails & ~removed_before & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def permutation_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """The paths through the lattice: for each order of ``filters`` and step (from 1) the edge that it takes."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(filters) for k in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (``lang``; null: empty), order and step: the documents kept after it and removed by it, the ones failing its filter but
    removed earlier, the ones that fail no other filter, those removed that are labelled good or toxic, and the filter's removals summed
    over all orders. An empty table gives no rows; null texts are empty ones; equal rows are documents of their own; columns other than
    doc_id, text and lang (doc_id, quality and toxic of ``labels``) aren't read. The 600 steps are what is broadcast."""
    edges = lattice_edges(failure_counts(text_failures(docs), labels))
    steps = edges.join(F.broadcast(permutation_steps(docs.sparkSession)), ["applied", "next"])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return steps.select("part", "filter_order", "step", *counts, F.expr("sum(removed) OVER (PARTITION BY part, next)").alias("shapley"))
