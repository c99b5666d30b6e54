"""Exact repeated windows across documents, found from anchors and compared symbol by symbol.

A window is ``window`` symbols (words or bytes) in a row.  Each window is owned by
its anchor, the leftmost smallest hash of ``gram`` symbols in it, so equal windows
have equal anchors at equal offsets.  One row for each anchor stands for all the
windows it owns: a range of offsets, and the symbols to its left and right as far
as these windows reach.  Anchors whose gram occurs once drop out; the others form
groups by gram, which are then refined:

* the first row of a group, by document and position, is its representative;
* every other row is compared with it, symbol by symbol, to the left and right of
  the anchor, which settles all offsets whose whole window lies in the match;
* what is not settled goes on in a smaller group, dealt by side, depth and symbol
  of the first difference: the windows that reach past the left difference by the
  left one, the others by the right one.

All rows that share a window take the same way, and stop only when the first of
them represents their group, so nothing is missed; a span is reported only after
its symbols were compared, so hashes (of grams and groups) only steer.  Each round
is linear in the rows that are left: no pairs, no group in one place (hot groups
are split), and every round takes the first row out of each group and goes at least
one symbol deeper, so there are at most as many rounds as symbols in a reach.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import SPACED, Rolling, blocks, common_prefix, gather, mix, string_buffers, winnow, word_spans
from tracklake.llm.common import KEY, discard, key_filter, keyed_texts, release, signed, staged
from tracklake.operators.skew import hot_keys, join_to_one, parts_of

Batches = Iterator[pa.RecordBatch]
FILTER_BYTES = 32 << 20
_ROWS = f"grp long, doc_id long, {KEY} long, start int, lo int, hi int, left binary, right binary"


@dataclass(frozen=True)
class Windows:
    """What is compared: ``window`` symbols in a row, anchored on ``gram`` of them."""

    window: int
    gram: int
    words: bool

    def anchors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol bytes, byte start of each symbol (and the end), symbol offsets of the documents, and for each
        anchor its document, gram hash, position, and first and last owned start as one array of two rows."""
        if self.words:
            starts, ends, at = word_spans(data, offsets, SPACED)
            codes = Rolling(data).of(starts, ends)
            size = ends - starts + 1
            begin = np.concatenate(([0], np.cumsum(size))) + 1  # a space stands before the first word and after each
            text = np.full(begin[-1], 32, np.uint8)
            k = np.arange(begin[-1] - 1) - np.repeat(begin[:-1] - 1, size)
            inside = k < np.repeat(size - 1, size)
            text[1:][inside] = data[(np.repeat(starts, size) + k)[inside]]
        else:
            text, begin, at, codes = data, np.arange(len(data) + 1), offsets, data
        grams = Rolling(codes).grams(self.gram)
        doc, pos, first, last = winnow(grams, at, self.window, self.gram)
        return text, begin, at, doc, grams[pos], pos, np.stack((first, last))

    def sides(self, text: np.ndarray, begin: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """What lies left of each anchor, read backwards, and right of it; each word is followed by a space."""
        back = 1 if self.words else 0
        return gather(text, begin[first] - back, begin[pos] - back, True), gather(text, begin[pos], begin[last + self.window])

    def extend(self, data: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols each row shares with row ``first`` of its group on one side, and a code of its next symbol."""
        common = common_prefix(data, at[:-1], at[1:], at[:-1][first], at[1:][first])
        if not self.words:
            padded = np.append(data, np.zeros(1, np.uint8))
            return common, padded[np.minimum(at[:-1] + common, len(data))].astype(np.uint64)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        before, upto = np.searchsorted(ends, at[:-1]), np.searchsorted(ends, at[:-1] + common)
        start = np.where(upto > before, ends[upto - 1] + 1, at[:-1])
        return upto - before, Rolling(data).of(start, np.maximum(start, ends[np.minimum(upto, len(ends) - 1)]))


def _column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _members(texts: DataFrame, spec: Windows, filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One row for each anchor whose gram occurs again, and the number of rows of each gram.

    Grams are counted first (pre-aggregated in each task).  Up to ``filter_bytes``
    the repeated ones are broadcast as a Bloom filter; beyond that, places of
    anchors without text meet them in a join and go back to their documents.
    """

    def count_grams(batches: Batches) -> Batches:
        for _, data, offsets in blocks(batches):
            values, counts = np.unique(spec.anchors(data, offsets)[4], return_counts=True)
            yield pa.RecordBatch.from_pydict({"grp": signed(values), "n": pa.array(counts.astype(np.int32))})

    spark = texts.sparkSession
    grams = staged(texts.mapInArrow(count_grams, "grp long, n int").groupBy("grp").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    release(spark)
    tied = key_filter(grams, "grp", filter_bytes)
    tied = None if tied is None else spark.sparkContext.broadcast(tied)
    if tied is None:

        def list_places(batches: Batches) -> Batches:
            for rows, data, offsets in blocks(batches):
                _, _, at, doc, digit, pos, _ = spec.anchors(data, offsets)
                yield pa.RecordBatch.from_pydict({"grp": signed(digit), "doc_id": pa.array(_column(rows, "doc_id")[doc]), KEY: pa.array(_column(rows, KEY)[doc]), "start": pa.array((pos - at[doc]).astype(np.int32))})

        places = staged(texts.mapInArrow(list_places, f"grp long, doc_id long, {KEY} long, start int"), "places")
        again = join_to_one(places, grams.select("grp"), "grp", ["doc_id", KEY, "start"], "left_semi", sizes=grams)
        wanted = again.groupBy("doc_id", KEY).agg(F.collect_set("start").alias("wanted"))
        texts = texts.join(wanted.hint("merge"), ["doc_id", KEY])

    def list_anchors(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            text, begin, at, doc, digit, pos, (first, last) = spec.anchors(data, offsets)
            start = pos - at[doc]
            if tied is not None:
                hit = tied.value.test(digit)
            else:
                lists = rows.column(rows.schema.get_field_index("wanted"))
                owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
                hit = np.isin(doc << 32 | start, owner << 32 | lists.flatten().to_numpy(zero_copy_only=False))
            doc, digit, pos, first, last, start = (x[hit] for x in (doc, digit, pos, first, last, start))
            left, right = spec.sides(text, begin, pos, first, last)
            yield pa.RecordBatch.from_pydict({
                "grp": signed(digit), "doc_id": pa.array(_column(rows, "doc_id")[doc]), KEY: pa.array(_column(rows, KEY)[doc]), "start": pa.array(start.astype(np.int32)),
                "lo": pa.array((pos - last).astype(np.int32)), "hi": pa.array((pos - first).astype(np.int32)), "left": left, "right": right,
            })

    out = staged(texts.mapInArrow(list_anchors, _ROWS), "anchors")
    if tied is None:
        discard(places)
    return out, grams


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows with a ``slot``, group by group in order of place, each group in one task.

    A hot group is dealt over several slots, and each slot begins with its first row.
    """
    hot = hot_keys(sizes, "grp", rows.count())
    parts = parts_of("grp", hot)
    out = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", KEY, "start"), parts))
    if hot:
        firsts = rows.where(F.col("grp").isin([g for some in hot.values() for g in some])).groupBy("grp").agg(F.min(F.struct("doc_id", KEY, "start", "lo", "hi", "left", "right")).alias("r"))
        out = out.unionByName(firsts.select("grp", "r.*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("slot")))
    return out.repartition("grp", "slot").sortWithinPartitions("grp", "slot", "doc_id", KEY, "start")


def repeated_spans(docs: DataFrame, spec: Windows, within: bool, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, row key, start, stop): symbol ranges covered by windows that also start earlier.

    Earlier is a smaller doc_id; with ``within`` also an earlier place in the same
    document (rows with one doc_id and other texts then follow in the order of their
    row keys).  Ranges overlap and are not merged.  Empty input, or texts shorter
    than a window, give no rows.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs).where(F.col("doc_id").isNotNull())

    def compare(batches: Batches) -> Batches:
        head = None  # the first row of the group that the last batch ended in
        for batch in batches:
            for cut in range(0, len(batch), 4096):
                rows = batch.slice(cut, 4096)
                if head is not None:
                    rows = pa.Table.from_batches([head, rows]).combine_chunks().to_batches()[0]
                lo, hi, start, doc, key, slot = (_column(rows, c).astype(np.int64) for c in ("lo", "hi", "start", "doc_id", KEY, "slot"))
                group = _column(rows, "grp").view(np.uint64)
                opens = np.ones(len(rows), bool)
                opens[1:] = (group[1:] != group[:-1]) | (slot[1:] != slot[:-1])
                first = np.maximum.accumulate(np.where(opens, np.arange(len(rows)), 0))
                head = rows.slice(int(first[-1]), 1)
                (left, left_next), (right, right_next) = (spec.extend(*string_buffers(rows.column(rows.schema.get_field_index(c))), first) for c in ("left", "right"))
                other = (doc != doc[first]) | (key != key[first]) | (start != start[first])
                a, b = np.maximum(lo, spec.window - right), np.minimum(hi, left)
                done = np.flatnonzero(other & (a <= b) & (within | (doc != doc[first])))
                parts = [(done, None, (start - b)[done], (start - a + spec.window)[done])]
                for which, depth, symbol, new_lo, new_hi in ((1, left, left_next, np.maximum(lo, left + 1), hi), (2, right, right_next, lo, np.minimum(np.minimum(hi, left), spec.window - right - 1))):
                    on = np.flatnonzero(other & (new_lo <= new_hi))
                    deal = mix(group ^ mix(symbol * np.uint64(0x9E3779B97F4A7C15) + depth.astype(np.uint64) * np.uint64(4) + np.uint64(which)))
                    parts.append((on, signed(deal[on]), new_lo[on], new_hi[on]))
                for at, grp, x, y in parts:
                    kept = {c: rows.column(rows.schema.get_field_index(c)).take(pa.array(at)) for c in ("doc_id", KEY, "start")}
                    texts = {c: pa.nulls(len(at), pa.binary()) if grp is None else rows.column(rows.schema.get_field_index(c)).take(pa.array(at)) for c in ("left", "right")}
                    yield pa.RecordBatch.from_pydict({"grp": pa.nulls(len(at), pa.int64()) if grp is None else grp, **kept, "lo": pa.array(x.astype(np.int32)), "hi": pa.array(y.astype(np.int32)), **texts})

    rows, sizes = _members(texts, spec, filter_bytes)
    release(spark)
    steps, found = [rows, sizes], []
    while not rows.isEmpty():
        step = staged(_dealt(rows, sizes).mapInArrow(compare, _ROWS), "compared")
        release(spark)
        found.append(step.where("grp IS NULL").select("doc_id", KEY, F.col("lo").alias("start"), F.col("hi").alias("stop")))
        rows = step.where("grp IS NOT NULL")
        sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
        steps.append(step)
        if len(found) == 1:
            discard(*steps[:2])
    none = spark.createDataFrame([], f"doc_id long, {KEY} long, start int, stop int")
    out = staged(functools.reduce(DataFrame.unionByName, found, none), "spans")
    discard(*(steps[2:] or steps))
    return out


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges, touching ones joined, in order."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    at = np.flatnonzero(new)
    return start[at], stop[np.append(at[1:], len(start)) - 1]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, row key, text, starts, stops): each row with its own spans, at most a few for each anchor it has."""
    lists = spans.groupBy("doc_id", KEY).agg(F.collect_list(F.struct("start", "stop")).alias("pairs"))
    lists = lists.select(F.col("doc_id").alias("span_doc"), F.col(KEY).alias("span_key"), F.col("pairs.start").alias("starts"), F.col("pairs.stop").alias("stops"))
    texts = keyed_texts(docs)
    # by merge at every size: what repeats grows with the corpus and is never broadcast
    return texts.join(lists.hint("merge"), (texts.doc_id == lists.span_doc) & (texts[KEY] == lists.span_key), "left").drop("span_doc", "span_key")


def span_lists(rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two list columns of :func:`with_spans`, one pair of arrays for each row."""
    out = []
    starts, stops = (rows.column(rows.schema.get_field_index(c)).fill_null([]) for c in ("starts", "stops"))
    lo = starts.offsets.to_numpy()
    base = lo[0] if len(lo) else 0
    a, b = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), stops.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(len(rows)):
        s = slice(lo[i] - base, lo[i + 1] - base)
        out.append((a[s], b[s]))
    return out
