"""Substring dedup: seed on winnowed anchors, extend both ways, remove later copies of long repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import SPACED, blocks, word_spans
from tracklake.llm.repeats import Batches, Windows, merged, repeated_spans, span_lists, with_spans

_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def dedup_substrings(docs: DataFrame, words: int = 50, seed: int = 16) -> DataFrame:
    """Remove passages of ``words`` or more words that also stand in a document with a smaller doc_id.

    Seeds are winnowed anchors of ``seed`` words.  Documents join the first document
    that has their seed, the match is extended word by word to both sides, and what
    it leaves open goes on to the first document that shares the next word there
    (see :mod:`repeats`).  Matches of ``words`` or more that touch join into maximal
    repeats, returned as ``spans``.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by a space),
    kept_sha256 and spans.  Repeats inside one document stay, as do rows without a
    doc_id; a text of fewer than ``words`` words, an empty or a null text loses
    nothing; no rows give no rows.  Rows that repeat a doc_id are one document
    (each is compared with smaller ids only).
    """
    spec = Windows(words, min(seed, words), True)
    joined = with_spans(docs, repeated_spans(docs, spec, within=False))

    def cut(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            starts, ends, first = word_spans(data, offsets, SPACED)
            raw, cols = data.tobytes(), ([], [], [], [], [])
            for i, (a, b) in enumerate(span_lists(rows)):
                a, b = merged(a, b)
                n = int(first[i + 1] - first[i])
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + first[i]
                kept = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                for col, x in zip(cols, (n, n - len(left), kept.decode(), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_text": pa.array(cols[2], pa.string()),
                "kept_sha256": pa.array(cols[3], pa.string()), "spans": pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            })

    return joined.mapInArrow(cut, _SCHEMA)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`dedup_substrings` over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))
