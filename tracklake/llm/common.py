"""Shared pieces of the text operators: tables, key filters.

Row conventions, the same for every operator here:

* A null text is the empty text; a null ``doc_id`` keeps its row, but has no place
  in the order of documents and so is neither a source nor a target of matches
  between documents.
* Rows that repeat a ``doc_id`` with another text stay apart (the hidden row key
  is a hash of both); full repeats count as one document and each returns a row.
* Only the named columns are read; other columns, whatever their names, are ignored,
  and operators that return the rows of ``docs`` return them unchanged (:func:`packed`).
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.plans.staging import clear, discard, shared_folder, staged  # noqa: F401

KEY = "tl_row_key"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps that nothing refers to now rather than at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key() -> Column:
    """Hash of the id and the text of a row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row key, text) with null texts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_key().alias(KEY))


def packed(docs: DataFrame) -> DataFrame:
    """(row key, text, row): the whole row as one struct, so no name of a column of ours meets one of ``docs``."""
    return docs.select(row_key().alias(KEY), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


class KeyFilter:
    """Bloom filter over 64-bit keys: may say yes wrongly, never no wrongly."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def test(self, keys: np.ndarray) -> np.ndarray:
        a = keys & self.mask
        hit = self.words[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63)) & np.uint64(1) != 0
        at = np.flatnonzero(hit)
        b = (keys[at] >> np.uint64(24) ^ keys[at] << np.uint64(17)) & self.mask
        hit[at] = self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1) != 0
        return hit


def key_filter(keys: DataFrame, column: str, max_bytes: int) -> KeyFilter | None:
    """Build a :class:`KeyFilter` with Spark, two bits of sixteen for each key; None where that takes over ``max_bytes``.

    Words of the bit table are OR-ed by key, so the driver receives the table alone.
    """
    n = keys.count()
    bits = max(1 << 14, 1 << int(16 * max(1, n) - 1).bit_length())
    if bits > max_bytes * 8:
        return None
    k = F.col(column).cast("long")
    second = F.shiftrightunsigned(k, 24).bitwiseXOR(F.shiftleft(k, 17))
    spots = keys.select(F.explode(F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in (k, second)])).alias("spot"))
    words = spots.groupBy(F.shiftrightunsigned("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return KeyFilter(table)


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as a bigint column."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
