"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import keyed_texts, read, staged

_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("tracklake", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) by a byte-level BPE; a null or empty text has 0 tokens, strings of special tokens are ordinary text.

    Every row gives a row, repeated ones and those without a doc_id too; no rows give
    no rows.  A very long text is encoded whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path, pattern).encode_ordinary
        for rows in batches:
            n = np.fromiter((len(encode(x.as_py())) for x in rows.column(1)), np.int64, len(rows))
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_tokens": pa.array(n)})

    return keyed_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, stripe: int = 1024) -> DataFrame:
    """One row for each occurring length, with what any limit of that many tokens gives.

    n_docs have exactly n_tokens; docs_longer have more; tokens_upto is their sum
    up to this length; tokens_truncated is the total if every text is cut at
    n_tokens; share is the part of documents at or below it.  Between two rows all
    of these follow exactly from the lower row (:func:`at_limit`).  Suffix sums run
    in two levels, stripes of lengths and lengths in a stripe, so no window holds
    more than ``stripe`` rows or the number of stripes.  No rows give no rows.
    """
    counts = staged(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("stripe", F.floor(F.col("n_tokens") / stripe))
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = counts.groupBy("stripe").agg(F.sum("n_docs").alias("s_docs"), F.sum(tokens).alias("s_tokens"))
    above = Window.orderBy(F.col("stripe").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("stripe", F.coalesce(F.sum("s_docs").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("s_tokens").over(above), F.lit(0)).alias("t_above"), F.sum("s_docs").over(every).alias("all_docs"), F.sum("s_tokens").over(every).alias("all_tokens"))
    inside = Window.partitionBy("stripe").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum(tokens).over(inside), F.lit(0))}).join(sums, "stripe")
    longer = F.col("d_in") + F.col("d_above")
    upto = F.col("all_tokens") - F.col("t_in") - F.col("t_above")
    return rows.select("n_tokens", "n_docs", longer.alias("docs_longer"), upto.alias("tokens_upto"), (upto + longer * F.col("n_tokens")).alias("tokens_truncated"), ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share"))


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: totals if every text is cut at ``limit`` tokens (limit, docs_cut, tokens_total)."""
    least = F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))
    row = histogram.agg(F.max_by(F.struct("docs_longer", "tokens_upto"), least).alias("r"), F.sum("n_docs").alias("n"))
    cut = F.coalesce("r.docs_longer", "n", F.lit(0))
    return row.select(F.lit(limit).cast("long").alias("limit"), cut.alias("docs_cut"), (F.coalesce("r.tokens_upto", F.lit(0)) + cut * limit).alias("tokens_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of the documents does not exceed."""
    return histogram.where(F.col("share") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """:func:`length_histogram` of the encoded lengths of ``documents``."""
    import public_tokenizers

    lengths = token_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return length_histogram(lengths)
