"""Suffix-array dedup: byte windows that repeat, found by a depth-limited radix order of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm.arrowtext import blocks
from tracklake.llm.repeats import Batches, Windows, merged, repeated_spans, span_lists, with_spans

_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def dedup_suffixes(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Earlier: in a document with a smaller doc_id, or in the same one further left.
    The radix order of :mod:`repeats`: a row stands for the neighbouring suffixes of
    one anchor; each pass skips the bytes that a group shares with its first suffix
    and deals the rest by depth and value of the next byte, only groups of two or
    more going on; suffixes equal to the first through ``length`` bytes repeat it.
    A string lies in one document; a text shorter than ``length``, empty or null, or
    without a doc_id, loses nothing; no rows give no rows.  Full repeats of a row are
    one document; rows with one doc_id and other texts follow in the order of their
    row keys.  Cuts may fall inside a character, so ``kept`` is binary.
    """
    spec = Windows(length, min(gram, length), False)
    joined = with_spans(docs, repeated_spans(docs, spec, within=True))

    def cut(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, (a, b) in enumerate(span_lists(rows)):
                a, b = merged(a, b)
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                kept = text[np.cumsum(gone[:-1]) == 0].tobytes() if len(a) else text.tobytes()
                for col, x in zip(cols, (len(text), len(text) - len(kept), len(a), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                "n_spans": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.binary()), "kept_sha256": pa.array(cols[4], pa.string()),
            })

    return joined.mapInArrow(cut, _SCHEMA)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`dedup_suffixes` over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
