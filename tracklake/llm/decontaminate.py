"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences."""

from __future__ import annotations


import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import ALNUM, LOWER, Rolling, blocks, gather, word_spans
from tracklake.llm.common import KEY, keyed_texts, packed, read, staged

Batches = Iterator[pa.RecordBatch]
BLOCK_BYTES = 8 << 20
_LANE = 256
_FOUND = f"doc_id long, {KEY} long, n_words long, hits array<bigint>, items array<string>"


class _Length:
    """Shift table and suffix buckets of all test strings with the same number of words.

    ``words`` are the word hashes of all items, ``start`` the first word of each
    string.  The shift table has eight slots or more for each string, so blocks of
    words that occur in none seldom meet a taken one.
    """

    def __init__(self, words: np.ndarray, start: np.ndarray, m: int) -> None:
        self.words, self.m, self.block = words, m, min(2, m)
        self.bits = max(16, int(8 * len(start)).bit_length())
        self.shift = np.full(1 << self.bits, min(255, m - self.block + 1), np.uint8)
        for end in range(self.block, m + 1):
            slots = self.slots(words, start + end - 1)
            self.shift[slots] = np.minimum(self.shift[slots], m - end)
        buckets = self.slots(words, start + m - 1) >> 3
        order = np.argsort(buckets, kind="stable")
        self.start = start[order].astype(np.int32)
        self.order = order.astype(np.int32)
        self.first = np.searchsorted(buckets[order], np.arange((1 << self.bits >> 3) + 1)).astype(np.int32)

    def slots(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Table slot of the block of words that ends at ``last``."""
        mixed = words[last] * np.uint64(0xC2B2AE3D27D4EB4F)
        if self.block == 2:
            mixed += words[last - 1] * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, string) of every occurrence by word hash; documents begin at ``first``.

        Many short lanes of the text advance together; each jumps by the shift of
        the block it ends on, and only where the shift is 0 are the bucket's
        strings compared.
        """
        m = self.m
        low, high = first[:-1] + m - 1, first[1:]
        lanes = np.maximum(0, -(-(high - low) // _LANE))
        doc = np.repeat(np.arange(len(lanes)), lanes)
        at = low[doc] + (np.arange(len(doc)) - (np.cumsum(lanes) - lanes)[doc]) * _LANE
        end = np.minimum(at + _LANE, high[doc])
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            slot = self.slots(text, at)
            jump = self.shift[slot]
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                here, bucket = at[zero], slot[zero] >> 3
                count = self.first[bucket + 1] - self.first[bucket]
                owner = np.repeat(np.arange(len(here)), count)
                pattern = self.first[bucket][owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                start = here[owner] - m + 1
                for k in range(m):  # first words first: most candidates end here
                    same = text[start + k] == self.words[self.start[pattern] + k]
                    start, pattern = start[same], pattern[same]
                found_at.append(start)
                found.append(self.order[pattern].astype(np.int64))
            at = at + np.maximum(jump, 1)
            go = at < end
            at, end = at[go], end[go]
        return np.concatenate(found_at), np.concatenate(found)


class Patterns:
    """Test strings of one block of benchmark items: windows of ``width`` words, or the whole of a shorter item.

    Held as flat arrays: the lower-cased text of the items, word bounds and hashes,
    and two numbers for each string, some tens of bytes for each word in all.
    """

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        encoded = [text.encode() for _, text in items]
        self.names = [name for name, _ in items]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int64)
        data = LOWER[np.frombuffer(b"".join(encoded), np.uint8)]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        words = Rolling(data).of(starts, ends)
        self.data, self.starts, self.ends = data, starts.astype(np.int32), ends.astype(np.int32)
        n = np.diff(first)
        self.tables = []
        for m in np.unique(np.minimum(n[n > 0], width)).tolist():
            own = np.flatnonzero((n == m) if m < width else (n >= m))
            each = n[own] - m + 1
            item = np.repeat(own, each)
            start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
            self.tables.append((_Length(words, start, m), start.astype(np.int32), item.astype(np.int32)))

    def held_bytes(self) -> int:
        arrays = [self.data, self.starts, self.ends, *[x for t, *rest in self.tables for x in (t.shift, t.first, t.start, t.order, *rest)]]
        return sum(x.nbytes for x in arrays) + self.tables[0][0].words.nbytes if self.tables else 0

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(start words, number of words, items) of the occurrences, confirmed by comparing the words themselves."""
        text = Rolling(data).of(starts, ends)
        for table, own, item in self.tables:
            at, pattern = table.search(text, first)
            same = np.ones(len(at), bool)
            for k in range(table.m):
                x, y = at + k, own[pattern] + k
                same &= ends[x] - starts[x] == self.ends[y] - self.starts[y]
                here = np.flatnonzero(same)
                left, right = gather(data, starts[x[here]], ends[x[here]]), gather(self.data, self.starts[y[here]].astype(np.int64), self.ends[y[here]].astype(np.int64))
                same[here] = pa.compute.equal(left, right).to_numpy(zero_copy_only=False)
            yield at[same], table.m, item[pattern[same]]


def _blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``block_bytes`` of text (one item at least), so what is broadcast at once is bounded."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("name", "body"), F.lit(n)) == k) for k in range(n)]


def _matches(patterns: Patterns, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[set], list[set]]:
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    hits, items = [set() for _ in range(len(rows))], [set() for _ in range(len(rows))]
    for at, size, item in patterns.search(data, starts, ends, first):
        doc = np.searchsorted(first, at, "right") - 1
        for d, a, name in zip(doc.tolist(), (at - first[doc]).tolist(), item.tolist(), strict=True):
            hits[d].update(range(a, a + size))
            items[d].add(patterns.names[name])
    return np.diff(first), hits, items


def _searches(texts: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> list[DataFrame]:
    """For each block of the benchmark what it hits; with several, each is stored before the next block is sent, and its own is dropped."""
    parts, found = _blocks_of(benchmark, block_bytes), []
    for part in parts:
        patterns = texts.sparkSession.sparkContext.broadcast(Patterns([(r.name, r.body) for r in part.collect()], width))

        def search(batches: Batches, patterns=patterns) -> Batches:
            for rows, data, offsets in blocks(batches):
                n, hits, items = _matches(patterns.value, rows, data, offsets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), KEY: rows.column(KEY), "n_words": pa.array(n.astype(np.int64)),
                    "hits": pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                })

        got = texts.mapInArrow(search, _FOUND)
        if len(parts) > 1:
            got = staged(got.where(F.size("items") > 0), "benchmark-hits")
            patterns.destroy()
        found.append(got)
    return found


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the words of each document inside any occurrence of a benchmark window.

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z.  An item of fewer than ``width`` words is one window; an item or document
    without words (empty, null) matches nothing.  Items that share an id count once;
    a null id is the empty name.  Every row of ``docs`` gives one row, repeated rows
    too: doc_id, row key, n_words, n_hit, n_items, items (sorted, comma-joined),
    contaminated.  A benchmark of one block needs no shuffle; with more, the hits of
    the blocks meet by row, without text.  A very long text is searched whole by one
    task, block by block of its batch; empty tables give no rows and no hits.
    """
    texts = keyed_texts(docs)
    found = _searches(texts, benchmark, width, block_bytes)
    flow = found[0]
    if len(found) > 1:
        every = functools.reduce(DataFrame.unionByName, found)
        sets = every.groupBy(F.col(KEY).alias("hit_key")).agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

        def count(batches: Batches) -> Batches:
            for rows, data, offsets in blocks(batches):
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), KEY: rows.column(KEY), "n_words": pa.array(np.diff(word_spans(LOWER[data], offsets, ALNUM)[2]).astype(np.int64))})

        flow = texts.mapInArrow(count, f"doc_id long, {KEY} long, n_words long").join(sets.hint("merge"), F.col(KEY) == F.col("hit_key"), "left")
        flow = flow.withColumns({"hits": F.coalesce("hits", F.array().cast("array<bigint>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.size("hits").cast("long")
    return flow.select("doc_id", KEY, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that hold no benchmark window.

    Null and empty texts hold none and stay; repeated rows stay or go together; an
    empty benchmark removes nothing.  With a benchmark of one block each row is
    decided where it is, without an exchange.
    """
    parts = _blocks_of(benchmark, block_bytes)
    if len(parts) > 1:
        hit = functools.reduce(DataFrame.unionByName, _searches(keyed_texts(docs), benchmark, width, block_bytes)).select(KEY).distinct()
        return packed(docs).select(KEY, "row").join(hit.hint("merge"), KEY, "left_anti").select("row.*")
    patterns = docs.sparkSession.sparkContext.broadcast(Patterns([(r.name, r.body) for r in parts[0].collect()], width))

    def keep(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array([not x for x in _matches(patterns.value, rows, data, offsets)[2]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_benchmark(spark, sf_dir: str) -> DataFrame:
    """:func:`find_benchmark` over ``documents``, with a digest of the items."""
    found = find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")
