"""Ranked lexical search: each task keeps its documents in an FP-tree, and each query item walks it by branch and bound."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import ALNUM, LOWER, Rolling, blocks, common_prefix, string_buffers, word_spans
from tracklake.llm.common import read, staged

Batches = Iterator[pa.RecordBatch]
#: Text of the query items that is broadcast at once; more items are searched in turn.
BLOCK_BYTES = 8 << 20
#: Documents, and terms in them, of one tree; documents of a leaf; documents that are scored at a time.
TREE_DOCS, TREE_TERMS, LEAF, STEP = 16_384, 2_000_000, 32, 512


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text)."""
    data = LOWER[data]
    return data, *word_spans(data, offsets, ALNUM)


class Terms:
    """The distinct terms of some query items, found by hash and compared by bytes."""

    def __init__(self, texts: pa.Array) -> None:
        data, starts, ends, first = _words(*string_buffers(texts))
        raw = data.tobytes()
        numbers: dict[bytes, int] = {}
        self.of_text = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            self.of_text.append(sorted({numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)}))
        self.data = np.frombuffer(b"".join(numbers), np.uint8)
        self.ends = np.cumsum([len(t) for t in numbers], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in numbers], np.int64)
        hashes = Rolling(self.data).of(self.starts, self.ends) if numbers else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.most = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # terms with one hash

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term of each word, -1 where it is none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = Rolling(data).of(starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        both = np.concatenate([data, self.data])
        for k in range(self.most):
            slot = np.minimum(at + k, len(self.hashes) - 1)
            maybe = np.flatnonzero((self.hashes[slot] == hashes) & (at + k < len(self.hashes)))
            term = self.order[slot[maybe]]
            long = ends[maybe] - starts[maybe]
            same = (self.ends[term] - self.starts[term]) == long
            maybe, term, long = maybe[same], term[same], long[same]
            equal = common_prefix(both, starts[maybe], ends[maybe], len(data) + self.starts[term], len(data) + self.ends[term]) == long
            out[maybe[equal]] = term[equal]
        return out


def term_vectors(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tfs): words of each whole text, and its term vector restricted to the query terms (32-bit arrays, by term)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Batches) -> Batches:
        known = shared.value
        wide = max(1, len(known.hashes))
        for batch in batches:
            for rows, data, offsets in blocks([batch]):
                data, starts, ends, first = _words(data, offsets)
                found = known.find(data, starts, ends)
                doc = np.repeat(np.arange(len(rows)), np.diff(first))
                hit = found >= 0
                key, tf = np.unique(doc[hit] * wide + found[hit], return_counts=True)
                edge = np.searchsorted(key, np.arange(len(rows) + 1) * wide)
                ids, tf = (key % wide).astype(np.int32), tf.astype(np.int32)
                cut = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n": pa.array(np.diff(first)), "terms": pa.array([ids[c].tobytes() for c in cut], pa.binary()), "tfs": pa.array([tf[c].tobytes() for c in cut], pa.binary())})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit values of all rows, values of each row)."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int32).astype(np.int64), np.array([len(v) // 4 for v in values], np.int64)


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: one row for each term and task is shuffled."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("terms"))[0], minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(total[some])})

    out = np.zeros(n_terms, np.int64)
    if n_terms:
        got = vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def _score(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """One term's part of the score; it grows with tf and falls with m."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class FpTree:
    """Documents by their frequency-ordered term vectors; documents below a node share a prefix.

    A node is a run of documents in lexicographic order.  Runs of one size with the
    node above (over three quarters of it) are opened into it, and runs of few
    documents gathered to leaves, so nodes are few and the depth is logarithmic.
    Each node knows the largest tf of each term and the least m of its documents.
    """

    def __init__(self, doc: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """Entries (doc, rank of the term, tf) sorted by doc, then rank; m of each doc."""
        n = len(m)
        size = np.bincount(doc, minlength=n)
        ends = np.cumsum(size)
        text = rank.astype(">u4").tobytes()
        keys = [text[4 * (e - s) : 4 * e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        self.order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        lo, hi = (ends - size)[self.order], ends[self.order]
        shared = np.zeros(n + 1, np.int64)  # terms in common with the document before
        shared[1:n] = common_prefix(rank, lo[1:], hi[1:], lo[:-1], hi[:-1])
        self.m = m[self.order]
        self._split(n, shared)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        by_term = np.lexsort((place[doc], rank))
        self.docs, self.tf, rank = place[doc][by_term], tf[by_term], rank[by_term]
        self.terms, self.first = np.unique(rank, return_index=True)
        self.first = np.append(self.first, len(rank))
        self._summarise(rank)

    def _split(self, n: int, shared: np.ndarray) -> None:
        self.lo, self.hi, self.up, self.kids = [0], [n], [-1], [[]]
        todo = [(0, 0, n)]
        while todo:
            node, lo, hi = todo.pop()
            if hi - lo <= LEAF:
                if node and (self.lo[node], self.hi[node]) == (lo, hi):
                    continue
                self._add(node, lo, hi)
                continue
            inside = shared[lo + 1 : hi]
            cuts = [lo, *(lo + 1 + np.flatnonzero(inside == inside.min())).tolist(), hi]
            few = lo
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                large = b - a > LEAF
                if few < a and (large or b - few > LEAF):
                    self._add(node, few, a)
                    few = a
                if large:
                    alone = 4 * (b - a) <= 3 * (self.hi[node] - self.lo[node])
                    todo.append((self._add(node, a, b) if alone else node, a, b))
                    few = b
            if few < hi:
                self._add(node, few, hi)

    def _add(self, up: int, lo: int, hi: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.up.append(up)
        self.kids.append([])
        self.kids[up].append(len(self.lo) - 1)
        return len(self.lo) - 1

    def _summarise(self, rank: np.ndarray) -> None:
        count, wide = len(self.lo), int(rank.max(initial=0)) + 1
        up = np.array(self.up)
        leaves = np.array([k for k in range(count) if not self.kids[k]])
        leaves = leaves[np.argsort(np.array(self.lo)[leaves])]
        starts = np.array(self.lo)[leaves]
        self.least_m = np.full(count, np.iinfo(np.int64).max)
        if len(self.m):
            self.least_m[leaves] = np.minimum.reduceat(self.m, starts)
        depth = np.zeros(count, np.int64)
        for k in range(1, count):  # a node comes after the one above it
            depth[k] = depth[up[k]] + 1
        node = leaves[np.searchsorted(starts, self.docs, "right") - 1]
        own, term, top, parts, moved = depth[node], rank, self.tf, [], ()
        for level in range(int(depth.max()), -1, -1):  # what the leaves here hold, and what nodes below pass up
            now = own == level
            here = [np.concatenate(x) for x in zip((node[now], term[now], top[now]), moved or (node[:0], term[:0], top[:0]), strict=True)]
            key = here[1] * count + here[0]
            by = np.argsort(key, kind="stable")
            key, first = np.unique(key[by], return_index=True)
            most = np.maximum.reduceat(here[2][by], first) if len(first) else here[2]
            parts.append((key % count, key // count, most))
            if level:
                nodes = np.flatnonzero(depth == level)
                np.minimum.at(self.least_m, up[nodes], self.least_m[nodes])
                moved = (up[parts[-1][0]], parts[-1][1], most)
        node, term, top = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(term, kind="stable")
        self.node_of, self.node_top = node[by], top[by]
        self.node_first = np.searchsorted(term[by], np.append(self.terms, wide))

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node no less than the score of any document below it."""
        total = np.zeros(len(self.lo), np.int64)
        for at, w in self._present(ranks, weights):
            rows = slice(self.node_first[at], self.node_first[at + 1])
            nodes = self.node_of[rows]
            total[nodes] += _score(w, self.node_top[rows], self.least_m[nodes])
        return total

    def _present(self, ranks: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
        at = np.searchsorted(self.terms, ranks)
        have = at < len(self.terms)
        have[have] = self.terms[at[have]] == ranks[have]
        return list(zip(at[have].tolist(), weights[have].tolist(), strict=True))

    def search(self, ranks: np.ndarray, weights: np.ndarray, offer: Offer) -> int:
        """Depth first, the more promising child first; what cannot reach the worst of the best is left.  Returns the documents scored."""
        bound = self.bounds(ranks, weights)
        present = self._present(ranks, weights)
        todo, waiting, held, scored = [0], [], 0, 0
        while todo or waiting:
            if todo:
                node = todo.pop()
                if bound[node] < max(offer.worst, 1):
                    continue
                if self.kids[node]:
                    todo += sorted(self.kids[node], key=bound.__getitem__)
                else:
                    waiting.append(node)
                    held += self.hi[node] - self.lo[node]
                if held < STEP and todo:
                    continue
            waiting = [k for k in waiting if bound[k] >= max(offer.worst, 1)]
            if waiting:
                scored += self._leaves(waiting, present, offer)
            waiting, held = [], 0
        return scored

    def _leaves(self, leaves: list[int], present: list[tuple[int, int]], offer: Offer) -> int:
        leaves = sorted(leaves, key=self.lo.__getitem__)
        lo, hi = np.array([self.lo[k] for k in leaves]), np.array([self.hi[k] for k in leaves])
        moved = np.cumsum(hi - lo) - hi  # place in the batch = place + moved of its leaf
        total = np.zeros(int((hi - lo).sum()), np.int64)
        for at, w in present:
            a, b = self.first[at], self.first[at + 1]
            docs = self.docs[a:b]
            s, e = np.searchsorted(docs, lo), np.searchsorted(docs, hi)
            n = e - s
            if n.any():
                pick = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                d = docs[pick]
                total[d + np.repeat(moved, n)] += _score(w, self.tf[a:b][pick], self.m[d])
        good = np.flatnonzero(total >= max(offer.worst, 1))
        leaf = np.searchsorted(moved + lo, good, "right") - 1
        offer.add(total[good], self.order[good - moved[leaf]])
        return len(total)


class Offer:
    """The best (score, document) of one item so far; ties go to the smaller id, a null id first."""

    def __init__(self, top: int) -> None:
        self.top, self.worst = top, 0
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids, self.nulls = self.doc, self.null

    def over(self, ids: np.ndarray, nulls: np.ndarray) -> Offer:
        """Documents are numbered in these arrays from now on."""
        self.ids, self.nulls = ids, nulls
        return self

    def add(self, score: np.ndarray, docs: np.ndarray) -> None:
        if not len(score):
            return
        score, doc, null = np.append(self.score, score), np.append(self.doc, self.ids[docs]), np.append(self.null, self.nulls[docs])
        best = np.lexsort((doc, ~null, -score))[: self.top]
        self.score, self.doc, self.null = score[best], doc[best], null[best]
        if len(best) == self.top:
            self.worst = int(self.score[-1])


def _search(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], rank_of: np.ndarray, n_docs: int, n_words: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best ``top`` of each task for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, rank_of))

    def run(batches: Batches) -> Batches:
        queries, rank_of = shared.value
        offers = [Offer(top) for _ in queries]
        held: list[pa.RecordBatch] = []
        docs = terms = 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            term, size = _joined(table.column("terms"))
            tf, _ = _joined(table.column("tfs"))
            doc = np.repeat(np.arange(len(size)), size)
            rank = rank_of[term]
            by = np.lexsort((rank, doc))
            tree = FpTree(doc[by], rank[by], tf[by], 50 + (50 * table.column("n").to_numpy() * n_docs) // n_words)
            ids = table.column("doc_id").combine_chunks()
            numbers, nulls = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for (ranks, weights), offer in zip(queries, offers, strict=True):
                tree.search(ranks, weights, offer.over(numbers, nulls))

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                docs += part.num_rows
                terms += pc.sum(pc.binary_length(part.column("terms"))).as_py() // 4
                if docs >= TREE_DOCS or terms >= TREE_TERMS:
                    flush()
                    held.clear()
                    docs = terms = 0
        if held:
            flush()
        for k, offer in enumerate(offers):
            if len(offer.score):
                yield pa.RecordBatch.from_pydict({"item": pa.array([k] * len(offer.score), pa.int64()), "doc_id": pa.array(offer.doc, pa.int64(), mask=offer.null), "score": pa.array(offer.score)})

    return vectors.where(F.length("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each item with their rank: first within sixteen parts of an item, then of those."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(16))], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 for each item.

    ``docs`` (doc_id, text) and ``items`` (item_id, text) are cut into words of
    letters, digits and all above ASCII, A-Z lower-cased.  A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is 50 + (50 n N) div L; the
    score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct
    terms.  Equal scores rank by doc_id, nulls first.

    The terms of at most about ``block_bytes`` of item text are broadcast at once.
    Texts are read once for each such block: restricted term vectors go to the
    shared folder, document frequencies are counted over them, and each task puts
    its documents into FP-trees of bounded size that every item searches.  Tasks
    return ``top`` rows an item.

    Null texts have no words.  Rows that repeat an item_id are one item with the
    terms of all; every document row is a document, so full repeats rank one after
    the other; items without a known term and empty tables give no rows.  Very long
    texts are read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, math.ceil((plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    found = []
    for k in range(parts):
        rows = plain.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toArrow()
        terms = Terms(rows.column("text"))
        of_item: dict[int | None, set[int]] = {}
        for item, own in zip(rows.column("item_id").to_pylist(), terms.of_text, strict=True):
            of_item.setdefault(item, set()).update(own)
        vectors = staged(term_vectors(docs, terms), "term-vectors")
        n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_words:
            break
        df = document_frequencies(vectors, len(terms.hashes))
        rank_of = np.empty(len(df), np.int64)
        rank_of[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = []
        for own in of_item.values():
            own = np.array(sorted(own), np.int64)
            own = own[(weight[own] > 0) & (df[own] > 0)]
            queries.append((rank_of[own], weight[own]))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(of_item)], "item long, item_id long")
        ranked = best(_search(vectors, queries, rank_of, n_docs, n_words, top), top)
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """:func:`ranked_search` of every ``benchmark`` item over all ``documents``."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
