"""SimHash near-duplicates, candidates filtered by pigeonring chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import LOWER, SPACED, blocks, word_spans
from tracklake.llm.common import KEY, discard, keyed_texts, packed, read, release, staged
from tracklake.operators.skew import join_to_one

Batches = Iterator[pa.RecordBatch]


def _prints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACED)
    keep = SPACED[data]
    keep[ends[ends < len(data)]] = True  # one space after each word; shingles are then slices
    line = np.where(SPACED[data], data, 32)[keep].astype(np.uint8).tobytes()
    rank = np.cumsum(keep) - 1
    lo, hi = rank[starts], rank[starts] + (ends - starts)
    words = np.diff(first)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), n)
    a = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    b = np.minimum(a + shingle, first[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], 42) for s, e in zip(lo[a].tolist(), hi[b].tolist(), strict=True)), np.uint64, len(a))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), at[:-1][some])
            out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row key, fp): 64-bit SimHash of lower-cased word shingles, repeats counted.

    A text of fewer words is one shingle; without words (or null) the fingerprint is 0.
    """

    def run(batches: Batches) -> Batches:
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), KEY: rows.column(KEY), "fp": pa.array(_prints(data, offsets, shingle).view(np.int64))})

    return keyed_texts(docs).mapInArrow(run, f"doc_id long, {KEY} long, fp long")


def _segments(limit: int) -> list[tuple[int, int]]:
    """(shift, width) of ``limit + 1`` nearly equal segments of 64 bits."""
    m = limit + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), widths[i]) for i in range(m)]


def _part(x: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _viable(diff: Column, segments: list[tuple[int, int]], start: int, limit: int) -> Column:
    """Every prefix of the chain that starts here stays within its share of the limit."""
    m, total, ok = len(segments), F.lit(0), F.lit(True)
    for length in range(1, m + 1):
        total = total + F.bit_count(_part(diff, segments[(start + length - 1) % m]))
        ok = ok & (total <= length * limit // m)
    return ok


def close_pairs(prints: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b): pairs of different fingerprints at ``limit`` or fewer differing bits, each once.

    Pigeonring: cut the ring of 64 bits into m segments.  If the whole differs in
    at most ``limit`` bits, some segment starts a chain in which every prefix of l
    segments differs in at most l * limit / m bits.  With m = limit + 1 the first
    segment agrees and the first two differ in one bit at most, so candidates meet
    on (start, first segment, second segment with up to one bit flipped on one
    side).  The rest of the chain is checked before the full distance, and a pair
    is kept only for its first viable start, so it is made once.
    """
    segments, m = _segments(limit), limit + 1
    value = F.col("fp")
    sides = []
    for flip in (False, True):
        keys = []
        for start in range(m):
            one, two = segments[start], segments[(start + 1) % m]
            head = _part(value, one) + F.lit(start << 20)
            tail = _part(value, two)
            tails = [tail, *[tail.bitwiseXOR(F.lit(1 << bit)) for bit in range(two[1])]] if flip else [tail]
            keys += [F.struct(F.lit(start).alias("start"), (F.shiftleft(head, 24) + t).alias("key")) for t in tails]
        sides.append(prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key"))
    a, b = sides[0].toDF("a", "start", "key"), sides[1].toDF("b", "start_b", "key_b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chains = [_viable(diff, segments, i, limit) for i in range(m)]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(chains)], F.lit(-1))
    on = (a.key == b.key_b) & (F.col("a") < F.col("b")) & (F.bit_count(diff) <= limit) & (first == F.col("start"))
    # by merge at every size: the exploded side is far larger than its table, by which Spark would choose to broadcast it
    return a.join(b.hint("merge"), on).select("a", "b")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, by alternating large-star and small-star steps.

    Each step gives every node's neighbours one edge to its smallest neighbour; the
    centre of a star is a hot key, whose edges are dealt over several tasks.
    """
    spark = nodes.sparkSession
    edges = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = join_to_one(both, least.drop("n"), "u", ["v"], sizes=least).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large")  # u > v
        lower = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lower")
        small = join_to_one(large, lower.drop("n"), "u", ["v"], sizes=lower).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        fresh = staged(small.where("u != v").distinct(), "links")
        discard(edges, least, large, lower)
        edges = fresh
        release(spark)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, row key, fp, component_id) for each document.

    Copies collapse to one fingerprint before the search, so a group of equal
    texts of any size costs one row.  Fingerprints link at ``limit`` or fewer
    differing bits; component_id is the smallest doc_id reachable (null only where
    the component has no doc_id at all).  Wordless, empty and null texts share
    fingerprint 0 and link like any other; repeated rows are in one component; no
    rows give no rows.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints-of")
    links = close_pairs(classes.select("fp"), limit)
    named = staged(components(links, classes.select(F.col("fp").alias("node"))).join(classes.withColumnRenamed("fp", "node").hint("merge"), "node"), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    least = staged(least, "least")
    member = staged(join_to_one(named.select("node", "root"), least.drop("n"), "root", ["node"], sizes=least).select(F.col("node").alias("fp"), "component_id"), "members")
    out = join_to_one(prints, member, "fp", ["doc_id", KEY], sizes=classes).select("doc_id", KEY, "fp", "component_id")
    discard(named, least, classes)
    release(docs.sparkSession)
    return out


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns as they were, with one document of each component.

    It is the one with the smallest doc_id; rows that repeat that doc_id and text
    stay one row, whichever.  Rows without a doc_id stay only in components that
    have none at all.  Wordless, empty and null texts are near-duplicates of each other.
    """
    keep = near_duplicates(docs, shingle, limit).where("doc_id = component_id OR component_id IS NULL").select(KEY).distinct()
    # by merge at every size: the kept keys grow with the corpus and are never broadcast
    return packed(docs).select(KEY, "row").dropDuplicates([KEY]).join(keep.hint("merge"), KEY, "left_semi").select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` over ``documents``, with the fingerprint in hexadecimal."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
