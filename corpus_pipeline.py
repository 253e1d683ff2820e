"""Cleaning and packing a corpus: five stages, each of which reads what the one before kept.

Null and empty texts pass every filter and are packed as their end token.  Of repeated rows, near copies
and ties the row with the least id stays.  Null ids are ids of their own.  Empty tables give empty ones.  Further columns
of documents are kept up to packing, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiotiles.llm import contamination, jaccard, packing, repeats, toxicity
from radiotiles.llm.common import SPACES, stage, table

#: None: a learned score and packing are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon learned from the labels predicts toxic go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the least id stays."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur elsewhere leave the texts; rows of which no word is left go.  Rows that had none
    before stay.  n_chars, where there is such a column, counts the text that is left."""
    blank, own = F.coalesce(F.translate(F.col("text"), SPACES, "") == "", F.lit(False)), "__had_words"
    after = repeats.without_repeats(docs.withColumn(own, ~blank))
    kept = after.where(~(blank & F.col(own)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold four fifths of a benchmark item go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens in the mixture of the sources."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
