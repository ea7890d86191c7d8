"""A pipeline over ``documents``: language, toxicity, near duplicates, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import langid, packing, simhash, toxicity
from foliospark.llm.common import default_vocabulary, discard, table, written
from foliospark.llm.entry import END_ID, SEQUENCE, WORD_TOKENIZER
from foliospark.sources.ship import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: a null or empty text, no letter, or a probability under one half. Equal rows stay or go
    together; an empty table gives an empty one; all columns are kept."""
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. A null or empty text has no features and stays; equal rows stay or go together; an empty
    table gives an empty one; all columns are kept."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.label_categories()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles alike by 0.8 or more) stays, that of the smallest id; null
    and blank texts are one group; of equal rows one stays; an empty table gives an empty one; all columns are kept."""
    ship(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence. A null text is an empty one and has the end id alone; equal
    rows are documents of their own; an empty table gives no rows."""
    ship(spark)
    return packing.pack_documents(docs, default_vocabulary(WORD_TOKENIZER), END_ID, SEQUENCE)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one is written."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
