import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import brute
from tracklake.llm import lexical
from tracklake.llm.lexical import FpTree, Offer, op11_ranked_search, ranked_search
from tracklake.llm.registry import ORACLES


def got(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_op11_whole_tables(spark, sf_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(op11_ranked_search(spark, sf_dir)) == sorted(brute.ranked(texts, items), key=repr)


def test_op11_equals_sql(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(ORACLES["op11_ranked_search"])
    assert got(op11_ranked_search(spark, folder)) == sorted(want.project("item_id, rank, doc_id, score").fetchall(), key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_odd_rows_in_one_block_of_items_and_in_many(spark, block):
    rng = random.Random(block)
    words = ["a", "B", "c3", "é", "日本", "x_y", "don't", "Zz", "zz", "q"]
    docs = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200])))) for i in range(150)]
    docs += docs[:40] + [(500, None), (501, ""), (502, "-- .. !"), (503, "q " * 50_000), (504, "Q")]
    items = [(1, "a b C3"), (1, "zz"), (2, None), (3, ""), (None, "é 日本 x"), (4, "unknown words"), (5, " ".join(words)), (6, "q"), (7, "don T t")]
    frame = spark.createDataFrame([(d, t, 9, b"t") for d, t in docs], "doc_id long, text string, n long, terms binary").repartition(3)
    query = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert got(ranked_search(frame, query, 20, block)) == sorted(brute.ranked(docs, items, 20), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(ranked_search(docs.where("false"), items)) == [] and got(ranked_search(docs, items.where("false"))) == []
    assert got(ranked_search(docs.withColumn("text", docs.doc_id.cast("string").substr(5, 1)), items)) == []


def _made(seed, n, n_terms):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        own = np.unique(np.minimum(rng.geometric(0.08, rng.integers(0, 40)) - 1, n_terms - 1)) if d % 5 else rows[-1][0] if rows else np.zeros(0, np.int64)
        rows.append((own, rng.integers(1, 6, len(own))))
    doc = np.repeat(np.arange(n), [len(r) for r, _ in rows])
    return doc, np.concatenate([r for r, _ in rows]).astype(np.int64), np.concatenate([t for _, t in rows]).astype(np.int64), rng.integers(51, 400, n)


def test_tree_shares_prefixes_and_bounds_hold():
    doc, rank, tf, m = _made(1, 3000, 60)
    tree = FpTree(doc, rank, tf, m)
    weights = np.random.default_rng(2).integers(1, 9000, 60)
    scores = np.zeros(3000, np.int64)
    np.add.at(scores, doc, lexical._score(weights[rank], tf, m[doc]))
    bound = tree.bounds(np.arange(60), weights)
    for k, (lo, hi) in enumerate(zip(tree.lo, tree.hi, strict=True)):
        own = tree.order[lo:hi]
        assert bound[k] >= scores[own].max() and tree.least_m[k] == m[own].min()
        assert not tree.kids[k] or sorted(x for c in tree.kids[k] for x in range(tree.lo[c], tree.hi[c])) == list(range(lo, hi))
    sequences = [tuple(rank[doc == d]) for d in tree.order]
    assert sequences == sorted(sequences)


def test_search_leaves_documents_out_and_loses_none():
    doc, rank, tf, m = _made(3, 9000, 80)
    tree, weights = FpTree(doc, rank, tf, m), np.random.default_rng(4).integers(100, 9000, 80)
    scored = 0
    for seed in range(20):
        own = np.sort(np.random.default_rng(seed).choice(80, 6, replace=False))
        w = weights[own]
        scores = np.zeros(9000, np.int64)
        at = np.isin(rank, own)
        np.add.at(scores, doc[at], lexical._score(weights[rank[at]], tf[at], m[doc[at]]))
        offer = Offer(10).over(np.arange(9000), np.zeros(9000, bool))
        scored += tree.search(own, w, offer)
        best = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s)[:10]
        assert list(zip((-offer.score).tolist(), offer.doc.tolist(), strict=True)) == best
    assert scored < 0.7 * 20 * 9000


def test_terms_of_one_hash_are_told_apart():
    terms = lexical.Terms(pa.array(["alpha beta", "beta Gamma", None]))
    assert [len(t) for t in terms.of_text] == [2, 2, 0]
    terms.hashes = np.full(3, 5, np.uint64)
    terms.order, terms.most = np.arange(3), 3
    real, lexical.Rolling.of = lexical.Rolling.of, lambda self, s, e: np.full(len(s), 5, np.uint64)
    try:
        data = np.frombuffer(b"gamma x beta alpha betas", np.uint8)
        assert terms.find(data, np.array([0, 6, 8, 13, 19]), np.array([5, 7, 12, 18, 24])).tolist() == [2, -1, 1, 0, -1]
    finally:
        lexical.Rolling.of = real
