"""Training-corpus pipeline: classify, cut repeated lines, drop near-duplicates, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; a stage drops a row only for its own reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm.classifier import keep_good
from tracklake.llm.common import read, staged
from tracklake.llm.decontaminate import decontaminate
from tracklake.llm.lines import drop_repeated_lines
from tracklake.llm.pieces import default_model, token_digests
from tracklake.llm.simhash import drop_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores under 0.5; empty and null texts are scored too, repeated rows alike; no rows give no rows."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut multi-line chunks that stand in an earlier place; a document that loses all its words goes.

    Null and empty texts lose nothing and stay; rows without a doc_id stay as they are; repeated rows count once; no rows give no rows.
    """
    return drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates.

    Empty and null texts are near-duplicates of each other; repeated rows become one; rows without a doc_id stay only where a group has no other; no rows give no rows.
    """
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null and empty texts hold none and stay, repeated rows share one fate, an empty table on either side removes nothing."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: doc_id, n_tokens, ids_sha256, decoded_sha256; a row for each row, null and empty texts as the end id alone."""
    return token_digests(docs, default_model())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("piece_encoding", piece_encoding),
]

#: No SQL can express the classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
