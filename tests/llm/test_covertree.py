import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tracklake.llm import covertree
from tracklake.llm.covertree import near_vectors, op12_embeddings

SCHEMA = "vec_id long, embedding array<float>"


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(seed, n, dim=16, spread=0.12):
    """Unit vectors of clusters of very different sizes and widths, chains of neighbours and lone ones."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.choice([1, 1, 2, 5, 40, 150]))):
            if rng.random() < 0.2:
                centre = centre + rng.normal(size=dim) * 0.09
            out.append(centre + rng.normal(size=dim) * spread * rng.random())
    return [[float(np.float32(c)) for c in v] for v in out[:n]]


def test_op12_whole_tables(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        assert got(op12_embeddings(spark, folder)) == sorted(brute.near_vectors(rows), key=repr)


@pytest.mark.parametrize("block", [4096, 64])
def test_clusters_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "PIVOTS", 50)
    rows = list(enumerate(clusters(block, 1500)))
    want = sorted(brute.near_vectors(rows), key=repr)
    assert sum(r[1] for r in want) > 10_000
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_odd_vectors(spark):
    a = [1.0, 2.0, -0.5]
    rows = [
        (1, a), (2, a), (3, [2.0, 4.0, -1.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, float("nan"), 0.0]), (7, [1.0, None, 1.0]), (8, []), (9, [float("inf"), 1.0, 1.0]),
        (None, a), (10, [-1.0, -2.0, 0.5]), (10, [5.0, 0.0, 0.0]), (11, [7.0]), (12, [-0.0, 0.0, 1e-30]), (13, [0.0, -0.0, 3e30]), (4, None), (None, None),
    ]
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA))) == sorted(brute.near_vectors(rows), key=repr)


def test_one_vector_holds_a_third_of_all_rows(spark):
    vectors = clusters(2, 200)
    rows = [(i, vectors[i % 200] if i % 3 else vectors[0]) for i in range(900)]
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA))) == sorted(brute.near_vectors(rows), key=repr)


def test_no_vectors_and_clashing_columns(spark):
    frame = spark.createDataFrame([(3, [1.0, 0.0], b"k", b"u", 9), (1, [1.0, 0.1], b"k", b"u", 9)], SCHEMA + ", key binary, unit binary, n long")
    assert got(near_vectors(frame)) == [(1, 1, 1, True), (3, 1, 1, False)]
    assert got(near_vectors(frame.where("false"))) == []
    assert got(near_vectors(frame.select("vec_id", "embedding").withColumn("embedding", F.lit(None).cast("array<float>")))) == [(1, 0, 1, True), (3, 0, 3, True)]


def test_most_pairs_are_pruned_or_taken_whole(monkeypatch):
    x = np.array(clusters(5, 900))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree._Tree(x, np.ones(len(x)), covertree._paths(x))
    for k, radius in enumerate(covertree.LEVELS):
        inner = tree.node[k][tree.centre[k]]
        assert (tree.centre[k][inner] == tree.centre[k]).all()  # nested: a centre is in its own node
        gap = x[tree.centre[k]] @ x[tree.centre[k]].T - 2 * np.eye(len(inner))
        assert gap.max() < np.cos(radius) + 1e-6  # centres are a level's angle apart
    seen = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: seen.append(len(a[1])) or real(*a))
    first, _, _ = covertree.dual_links(tree, tree, 0.9)
    assert sum(seen) < 0.25 * len(x) ** 2
    assert (first == (x @ x.T >= 0.9).sum(1)).all()
