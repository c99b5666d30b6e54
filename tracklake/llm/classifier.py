"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import LOWER, Rolling, blocks, mix
from tracklake.llm.common import KEY, keyed_texts, read

Batches = Iterator[pa.RecordBatch]

#: byte -> 0 space, 1 letter, digit or non-ASCII, 2 other symbol
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_AGAIN = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Ftrl:
    """Model size and training parameters."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-3
    epochs: int = 4
    shards: int = 8
    #: at most this many labelled rows are used, those with the smallest hash; the bound keeps training independent of corpus size
    max_rows: int = 24_000


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) entries: hashed word n-grams of whole texts.

    Tokens are runs of word characters and runs of symbols.  A token equal to one
    of the two before it reads as "again", so n-grams see repetition of any word.
    Each document has its unigrams and bigrams of lower-cased tokens, and of token
    shapes (upper, capital, lower, other, symbol), each worth its share of the
    tokens; a text without tokens has only the bias slot 0.
    """
    kind = _CLASS[data]
    n_docs = len(offsets) - 1
    start = kind != 0
    start[1:] &= kind[1:] != kind[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] = kind[at] != 0
    stop = kind != 0
    stop[:-1] &= kind[1:] != kind[:-1]
    at = offsets[1:][offsets[1:] > 0] - 1
    if len(data):
        stop[at] = kind[at] != 0
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    token = Rolling(LOWER[data]).of(starts, ends)
    pos = np.arange(len(doc)) - first[:-1][doc]
    same = np.zeros(len(token), bool)
    for back in (1, 2):
        same[back:] |= (token[back:] == token[:-back]) & (pos[back:] >= back)
    token = np.where(same, _AGAIN, token)
    upper = np.concatenate(([0], np.cumsum((data >= 0x41) & (data <= 0x5A))))
    lower = np.concatenate(([0], np.cumsum((data >= 0x61) & (data <= 0x7A))))
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    shape = np.where(kind[starts] == 2, 4, np.where(lows == 0, np.where(ups > 1, 0, 3), np.where(ups > 0, 1, 2))).astype(np.uint64)
    pair = np.flatnonzero(pos > 0)
    shift = np.uint64(64 - bits)
    slots = [
        mix(token ^ np.uint64(1)) >> shift,
        mix(token[pair - 1] * np.uint64(3) + token[pair]) >> shift,
        mix(shape + np.uint64(0xA1B2C3)) >> shift,
        mix(shape[pair - 1] * np.uint64(16) + shape[pair] + np.uint64(0x1F2E3D4C)) >> shift,
    ]
    docs = [doc, doc[pair], doc, doc[pair]]
    share = 1.0 / np.maximum(n, 1)
    docs, slots = np.concatenate(docs), np.concatenate(slots).astype(np.int64)
    return np.concatenate((docs, np.arange(n_docs))), np.concatenate((slots, np.zeros(n_docs, np.int64))), np.concatenate((share[docs], np.ones(n_docs)))


def _sparse(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each document, equal slots summed."""
    doc, slot, value = features(data, offsets, bits)
    key, inverse = np.unique(doc << bits | slot, return_inverse=True)
    value = np.bincount(inverse, value, len(key))
    cut = np.searchsorted(key >> bits, np.arange(len(offsets)))
    return [(key[a:b] & ((1 << bits) - 1), value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Ftrl) -> np.ndarray:
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    for epoch in range(p.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            slot, x, y = rows[i]
            w = _weights(z[slot], n[slot], p)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * x
            sigma = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / p.alpha
            z[slot] += g - sigma * w
            n[slot] += g * g
    return _weights(z, n, p)


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> np.ndarray:
    """Weights of the model, learnt from labelled rows outside the held-out third.

    A row is held out if crc32(doc_id as text) mod 3 is 1.  At most ``p.max_rows``
    rows are used; they are dealt into ``p.shards`` shards by hash, each shard runs
    FTRL on its own from weights of 0, and the weights are averaged over the shards
    that have rows.  Labels that disagree on one doc_id count once each; a null
    label is no label.  Without rows all weights are 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("label_doc"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL AND label_doc IS NOT NULL").distinct()
    marks = marks.where(F.crc32(F.col("label_doc").cast("string")) % 3 != 1).orderBy(F.xxhash64("label_doc"), "quality").limit(p.max_rows)
    texts = keyed_texts(docs)
    # max_rows bounds this side, so it is broadcast at every size and the texts stay where they are
    rows = texts.join(F.broadcast(marks), texts.doc_id == marks.label_doc).select("text", "quality", F.pmod(F.col(KEY), F.lit(p.shards)).cast("int").alias("shard"))

    def fit(batches: Batches) -> Batches:
        by: dict[int, list] = {}
        for rows, data, offsets in blocks(batches):
            for (slot, x), y, shard in zip(_sparse(data, offsets, p.bits), rows.column("quality").to_pylist(), rows.column("shard").to_pylist(), strict=True):
                by.setdefault(shard, []).append((slot, x, y))
        for own in by.values():
            w = _train(own, p)
            slot = np.append(np.flatnonzero(w), -1)  # slot -1 counts the shards
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "weight": pa.array(np.append(w[slot[:-1]], 1.0))})

    parts = rows.repartition(p.shards, "shard").sortWithinPartitions("shard", "text").mapInArrow(fit, "slot long, weight double")
    total = parts.groupBy("slot").agg(F.sum("weight").alias("weight")).toArrow()
    out = np.zeros((1 << p.bits) + 1)
    out[total.column("slot").to_numpy()] = total.column("weight").to_numpy()
    return out[:-1] / max(1.0, out[-1])


def _scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    doc, slot, value = features(data, offsets, int(len(weights)).bit_length() - 1)
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights[slot] * value, len(offsets) - 1), -30, 30)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, row key, score): probability of label 1, a sparse dot product for each whole text; an empty or null text is scored by the bias alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), KEY: rows.column(KEY), "score": pa.array(_scores(data, offsets, model.value))})

    return keyed_texts(docs).mapInArrow(run, f"doc_id long, {KEY} long, score double")


def classify(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, row key, held_out, score, predicted (1 from 0.5 on).

    Every row of ``docs`` gives one row; equal texts have equal scores; a null or
    empty text has the score of the bias; without labels every score is 0.5.
    """
    scored = score(docs, train(docs, labels, p))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", KEY, held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that the classifier accepts; decided where the row is, without an exchange.

    Null and empty texts are scored by the bias like any other; repeated rows stay or go together.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def run(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array(_scores(data, offsets, model.value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """:func:`classify` over ``documents`` with ``labels``."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
