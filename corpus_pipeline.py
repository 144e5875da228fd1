"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

What holds for every stage: a null text counts as an empty one; rows are judged each, so rows that repeat a
doc_id, and those without one, are kept or dropped by their own text (near_dedup says what it does); texts
are looked at whole, however long; an empty table gives an empty table; further columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.columns import read
from siftstone.llm.decontaminate import drop_leaks
from siftstone.llm.near_dedup import drop_near_duplicates
from siftstone.llm.quality_model import SubwordClassifier, keep_good
from siftstone.llm.queries import QUALITY_THRESHOLD, pieces, training_labels
from siftstone.llm.sentencepiece_lattice import encode
from siftstone.llm.suffix_dedup import remove_repeats
from siftstone.llm.token_pack import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels not held out, scores at the threshold or more. An empty text has the score of the model's bias."""
    return keep_good(docs, SubwordClassifier.fit(docs, training_labels(spark, sf_dir)), QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash of 5-word shingles (links at 4 bits, found by Golay keys), the one with the smallest doc_id. Empty texts are copies of each other. Rows that repeat a doc_id stay or go together; rows without one stay."""
    return drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document with a smaller doc_id has; n_chars is that of what is left. A null text becomes an empty one; a null doc_id counts as the largest; of rows with one doc_id none takes anything from the other."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark. Empty texts and items match nothing."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids, one row for each row; empty texts have no ids."""
    return encode(docs, pieces())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]
#: SQL can express none of the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after the other."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
