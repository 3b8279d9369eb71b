"""A corpus pipeline of five stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.

Edge cases, alike in all stages: a null text is the empty one (no words, no lines, no pieces) and is no near-duplicate of
a text with words; rows that agree in id and text are one document, of which near_dedup keeps one row; a null id is an
id; an empty table gives an empty one; other columns stay as they are, whatever their names; very long texts are worked
on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.llm.common import fresh, table, whole_text, written
from sonagrid.llm.line_dedup import without_recurring_lines
from sonagrid.llm.mixing import domain_labels, thinned
from sonagrid.llm.pieces import sampled_segmentations
from sonagrid.llm.simhash import one_of_each_group
from sonagrid.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go. Its labelled rows are those of the labels table."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; documents that lose every line go."""
    dropped = fresh(docs, "dropped")[0]
    lines = without_recurring_lines(docs, n_dropped=dropped)
    return lines.filter((F.col(dropped) == 0) | (whole_text() != "")).drop(dropped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (5-word shingles, similarity 0.8 or more)."""
    return one_of_each_group(docs, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that bring the quality domains' token totals to their targets."""
    return thinned(docs, domain_labels(table(spark, sf_dir, "labels")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their ids."""
    import public_tokenizers

    return sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), cached_edges=1_000_000, batch_chars=100_000)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("pieces", pieces)]

#: The trained stages and the seeded samples can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
