"""Exact threshold links between embeddings: cover trees, traversed two at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import discard, read, staged
from tracklake.llm.simhash import components
from tracklake.operators.skew import join_to_one

#: Levels of the trees: angles that halve from one to the next.  The first two route vectors to cells, the rest are in blocks.
TOP = (math.pi / 2, math.pi / 4)
LEVELS = (math.pi / 4, math.pi / 8, math.pi / 16, math.pi / 32)
#: Vectors that the top of the tree is made from, the least by digest; every vector is then routed and measured.
PIVOTS = 1024
#: Vectors of a block, and rows of a tile of distances in a task.
BLOCK, TILE = 4096, 512
#: Single precision only rules out; a bound gives way by this much on top of the rounding of the products.
SLACK = 1e-5


def _net(cosines: np.ndarray, radius: float, centres: list[int], order: np.ndarray) -> list[int]:
    """Centres of the next level: those there are, and each further vector (in ``order``) that none covers."""
    least = math.cos(radius)
    covered = (cosines[centres] >= least).any(0) if centres else np.zeros(cosines.shape[1], bool)
    out = list(centres)
    for i in order:
        if not covered[i]:
            out.append(int(i))
            covered |= cosines[i] >= least
    return out


def _paths(unit: np.ndarray) -> np.ndarray:
    """For each vector its node (the centre's row) at every level of the block's tree; nodes are nested."""
    n = len(unit)
    if not n:
        return np.zeros((0, len(LEVELS)), np.int32)
    narrow = unit.astype(np.float32)
    cosines = narrow @ narrow.T
    levels, centres, order = [], [], np.arange(n)
    for radius in LEVELS:
        centres = _net(cosines, radius, centres, order)
        levels.append(np.array(centres))
    path = np.empty((n, len(LEVELS)), np.int32)
    at = np.arange(n)
    for k in range(len(LEVELS) - 1, -1, -1):  # a node's parent is the centre nearest to its own
        near = levels[k][np.argmax(cosines[np.ix_(levels[k], np.unique(at))], axis=0)]
        to = np.empty(n, np.int64)
        to[np.unique(at)] = near
        at = to[at]
        path[:, k] = at
    return path


class _Tree:
    """A block's nodes by level: centres, covering angles, weights, and the node of each node of the next level."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, path: np.ndarray) -> None:
        self.unit, self.weight = unit, weight
        path = np.column_stack([path, np.arange(len(unit))])  # the last level is the vectors themselves
        self.centre, self.angle, self.total, self.up, self.node = [], [], [], [], []
        for k in range(path.shape[1]):
            centre, node = np.unique(path[:, k], return_inverse=True)
            reach = np.arccos(np.clip(np.einsum("ij,ij->i", unit, unit[path[:, k]]), -1, 1))
            angle = np.zeros(len(centre))
            np.maximum.at(angle, node, reach)
            if k == path.shape[1] - 1:
                angle[:] = 0
            self.centre.append(centre)
            self.angle.append(angle)
            self.total.append(np.bincount(node, weight, len(centre)))
            self.node.append(node)
            if k:
                up = np.zeros(len(centre), np.int64)
                up[node] = self.node[k - 1]
                self.up.append(up)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of rows a[i] and b[i]: roots fall to the least of the joined until nothing changes."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            over = root[root]
            if (over == root).all():
                break
            root = over
    return root


def dual_links(one: _Tree, two: _Tree, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight linked to each vector of ``one``, of ``two``, component of each row of both).

    Pairs of nodes are followed down both trees together.  With covering angles a, b
    a pair whose centres are more than T + a + b apart holds no link and goes; one
    within T - a - b holds nothing but links: weights are added to the two nodes and
    their vectors joined, without naming the pairs.  The others part into pairs of
    children; at the bottom the cosine in double precision decides.
    """
    n, wide = len(one.unit), math.acos(least)
    root = np.arange(n + len(two.unit))
    sums = [[np.zeros(len(c)) for c in t.centre] for t in (one, two)]
    slack = SLACK + 4 * one.unit.shape[1] * np.finfo(np.float32).eps
    last = len(one.centre) - 1
    narrow = [t.unit.astype(np.float32) for t in (one, two)]
    whole: list[tuple[int, np.ndarray, np.ndarray]] = []
    alive = None  # of the level before: pairs of nodes still open, as a matrix
    for k in range(last + 1):
        ca, cb = one.centre[k], two.centre[k]
        aa, ab = one.angle[k], two.angle[k]
        open_now = np.zeros((len(ca), len(cb)), bool) if k < last else None
        by_angle = np.argsort(aa, kind="stable")
        for lo in range(0, len(ca), TILE):
            rows = by_angle[lo : lo + TILE]
            columns = np.arange(len(cb))
            if alive is not None:
                part = alive[one.up[k - 1][rows]]
                rows, part = rows[part.any(1)], part[part.any(1)]
                if not len(rows):
                    continue
                columns = columns[part.any(0)[two.up[k - 1]]]
            if not len(columns):
                continue
            cosine = narrow[0][ca[rows]] @ narrow[1][cb[columns]].T
            reach = np.minimum(wide + aa[rows].max() + ab[columns], math.pi)
            maybe = cosine >= (np.cos(reach) - slack).astype(np.float32)  # a first bound with the tile's widest node
            if alive is not None:
                maybe &= part[:, two.up[k - 1][columns]]
            i, j = np.nonzero(maybe)
            i, j = rows[i], columns[j]
            exact = np.concatenate([np.einsum("ij,ij->i", one.unit[ca[i[s : s + 65536]]], two.unit[cb[j[s : s + 65536]]]) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            both = aa[i] + ab[j]
            if k == last:
                hit = exact >= least
                np.add.at(sums[0][k], i[hit], two.total[k][j[hit]])
                np.add.at(sums[1][k], j[hit], one.total[k][i[hit]])
                root = _merge(root, i[hit], n + j[hit])
                continue
            near = exact >= np.cos(np.minimum(wide + both, math.pi)) - SLACK
            inside = (wide - both > SLACK) & (exact >= np.cos(np.maximum(wide - both, 0)) + SLACK)
            whole.append((k, i[inside], j[inside]))
            np.add.at(sums[0][k], i[inside], two.total[k][j[inside]])
            np.add.at(sums[1][k], j[inside], one.total[k][i[inside]])
            rest = near & ~inside
            open_now[i[rest], j[rest]] = True
        alive = open_now
    for k, i, j in whole:  # a node that lies in a link with a whole node: its vectors are all of one component
        for side, (tree, nodes, offset) in enumerate(((one, i, 0), (two, j, n))):
            mine = np.flatnonzero(np.isin(tree.node[k], nodes))
            root = _merge(root, offset + mine, offset + tree.centre[k][tree.node[k][mine]])
        root = _merge(root, one.centre[k][i], n + two.centre[k][j])
    counts = []
    for tree, own in zip((one, two), sums, strict=True):
        total = np.zeros(len(tree.unit))
        for k, s in enumerate(own):
            total += s[tree.node[k]]
        counts.append(total)
    return counts[0], counts[1], root


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, unit): unit vectors as doubles, key a digest of their bytes; both null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column("embedding"):
                x = np.array(v.as_py() if v.is_valid else [], dtype=float)  # null components become nan
                norm = np.abs(x).max(initial=0.0)
                if not (len(x) and np.isfinite(x).all() and norm > 0):
                    keys.append(None)
                    units.append(None)
                    continue
                x = x / norm  # so that squares of very large or small components stay finite
                x = x / np.sqrt(x @ x) + 0.0
                units.append(x.tobytes())
                keys.append(hashlib.blake2b(units[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "key": pa.array(keys, pa.binary()), "unit": pa.array(units, pa.binary())})

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(run, "vec_id long, key binary, unit binary")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors of a binary column; shorter ones end in zeros."""
    values = column.to_pylist()
    if values and all(len(b) == 8 * width for b in values):
        return np.frombuffer(b"".join(values)).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for i, b in enumerate(values):
        x = np.frombuffer(b)
        out[i, : len(x)] = x
    return out


def _top(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of the two upper levels of the tree, from at most :data:`PIVOTS` vectors; (units, parent)."""
    share = max(1, classes.count() // (2 * PIVOTS))  # about twice as many as are taken, so that few rows travel
    some = classes.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).orderBy("key").limit(PIVOTS)
    first = _matrix(some.select("unit").toArrow().column("unit"), width)
    if not len(first):
        return first, np.zeros(0, np.int64)
    cosines = first @ first.T
    order = np.arange(len(first))
    wide = _net(cosines, TOP[0], [], order)
    fine = np.array(_net(cosines, TOP[1], wide, order))
    return first[fine], np.argmax(cosines[np.ix_(fine, wide)], axis=1)


def linked_pairs(classes: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(key, linked; a, b) for distinct unit vectors (key, unit, n).

    ``linked`` is the number of vectors, copies of the vector itself included, whose
    cosine with it is ``least`` or more.  The edges (a, b) join each component of
    links, with far fewer rows than there are links.

    The top of the cover tree routes each vector to its nearest pivot; a cell's
    covering angle is measured over all of its vectors.  Cells are grouped, in order
    of the level above, into blocks of about :data:`BLOCK` vectors, larger ones dealt
    over several by hash.  Groups whose cells lie too far apart never meet; two
    blocks of the others meet in one task, which walks their trees.
    """
    spark = classes.sparkSession
    width = (classes.agg(F.max(F.length("unit"))).first()[0] or 0) // 8
    pivots, parent = _top(classes, width)
    shared = spark.sparkContext.broadcast(pivots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _matrix(batch.column("unit"), width) @ shared.value.T
                cell = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("key", "unit", "n")}, "cell": pa.array(cell, pa.int64()), "angle": pa.array(angle)})

    routed = staged(classes.select("key", "unit", "n").mapInArrow(route, "key binary, unit binary, n long, cell long, angle double"), "routed")
    cells = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).toArrow().to_pylist()  # PIVOTS rows at most
    cells.sort(key=lambda c: (parent[c["cell"]], c["cell"]))
    group, sizes, filled = {}, [], BLOCK
    for c in cells:
        if filled + c["n"] > BLOCK:
            sizes.append(0)
            filled = 0
        group[c["cell"]] = len(sizes) - 1
        sizes[-1] += c["n"]
        filled += c["n"]
    at = np.array([c["cell"] for c in cells], np.int64)
    angle = np.array([c["angle"] for c in cells])
    apart = np.arccos(np.clip(pivots[at] @ pivots[at].T, -1, 1)) if len(at) else np.zeros((0, 0))
    meets = apart <= math.acos(least) + angle[:, None] + angle[None, :] + 1e-6
    of = np.array([group[c] for c in at.tolist()], np.int64)
    near = np.zeros((len(sizes), len(sizes)), bool)
    np.logical_or.at(near, (of[:, None], of[None, :]), meets)
    slices = [-(-s // BLOCK) for s in sizes]
    where = spark.createDataFrame([(int(c), int(g), slices[g]) for c, g in group.items()], "cell long, grp long, slices long")
    partners = spark.createDataFrame([(g, [(int(h), slices[h]) for h in np.flatnonzero(near[g])]) for g in range(len(sizes))], "grp long, partners array<struct<h: long, slices: long>>")

    def build(table: pa.Table) -> pa.Table:
        path = _paths(_matrix(table.column("unit"), width))
        return pa.table({**{c: table.column(c) for c in ("key", "unit", "n", "grp", "slice")}, "place": pa.array(np.arange(len(path))), "path": pa.array([p.tobytes() for p in path], pa.binary())})

    dealt = routed.join(F.broadcast(where), "cell").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")))
    trees = dealt.select("key", "unit", "n", "grp", "slice").groupBy("grp", "slice").applyInArrow(build, "key binary, unit binary, n long, grp long, slice long, place long, path binary")
    trees = staged(trees, "trees")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.slices") - 1))
    met = trees.join(F.broadcast(partners), "grp").withColumn("p", F.explode("partners")).withColumn("other", other)
    me, you = (F.shiftleft(F.col(g), 40) + F.col(s) for g, s in (("grp", "slice"), ("p.h", "other")))
    met = met.select("key", "unit", "n", "place", "path", F.least(me, you).alias("a"), F.greatest(me, you).alias("b"), (me > you).alias("second"))

    def walk(table: pa.Table) -> pa.Table:
        sides = []
        for second in (False, True):
            mine = table.filter(pc.equal(table.column("second"), second)).sort_by("place")  # as the tree was built
            path = np.frombuffer(b"".join(mine.column("path").to_pylist()), np.int32).reshape(mine.num_rows, len(LEVELS))
            sides.append((_Tree(_matrix(mine.column("unit"), width), mine.column("n").to_numpy().astype(float), path), mine.column("key").to_pylist()))
        (one, keys), (two, others) = sides
        if others:
            counts, more, root = dual_links(one, two, least)
            keys, counts = keys + others, np.concatenate([counts, more])
        else:  # a block with itself: both ends are the same rows
            counts, _, root = dual_links(one, one, least)
            root = _merge(root, np.arange(len(keys)), len(keys) + np.arange(len(keys)))
        some = np.flatnonzero(counts)
        return pa.table({"key": pa.array([keys[i] for i in some], pa.binary()), "linked": pa.array(counts[some].astype(np.int64)), "root": pa.array([keys[i] for i in root[some]], pa.binary())})

    found = staged(met.groupBy("a", "b").applyInArrow(walk, "key binary, linked long, root binary"), "met")
    discard(routed, trees)
    return found.groupBy("key").agg(F.sum("linked").alias("linked")), found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Rows link where their cosine in double precision is ``least`` or more, found by
    :func:`linked_pairs`; n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, kept marks that row.  Equal unit
    vectors are one class of the search and each other's links; a class of any size
    costs one row there.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are their own component; of vectors
    of different length the shorter counts as ending in zeros.  Rows that repeat a
    vec_id are rows of their own; a null vec_id links as any other, but is no
    component_id (null only where no linked row has one) and is never kept.  No rows
    give no rows.
    """
    units = staged(_units(vectors), "units")
    valid = units.where("key IS NOT NULL")
    classes = staged(valid.groupBy("key", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "vector-classes")
    if classes.isEmpty():
        named = classes.select("key", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        linked, edges = linked_pairs(classes, least)
        roots = staged(components(edges, classes.select(F.col("key").alias("node"))).withColumnRenamed("node", "key"), "vector-roots")
        lowest = roots.join(classes.select("key", "least").hint("merge"), "key").groupBy("root").agg(F.min("least").alias("component_id"))
        named = roots.join(lowest.hint("merge"), "root").join(linked.hint("merge"), "key").select("key", (F.col("linked") - 1).alias("n_links"), "component_id")
    named = staged(named, "vector-names")
    sizes = classes.select("key", "n")
    out = join_to_one(valid.select("vec_id", "key"), named, "key", ["vec_id"], sizes=sizes).select("vec_id", "n_links", "component_id")
    alone = units.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embeddings(spark, sf_dir: str) -> DataFrame:
    """:func:`near_vectors` over all ``embeddings``, whatever their labels, at cosine 0.9."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
