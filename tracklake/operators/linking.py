"""Linking detections between frames: overlap costs, distance candidates, mutual best."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.graph import number_rows
from tracklake.operators.keys import by
from tracklake.operators.labels import foreground, tiled
from tracklake.plans.staging import staged


def overlap_costs(runs: DataFrame, max_gap: int = 1, cutoff: float | None = 0.9, offset: float = 1.0, coefs: dict[str, float] | None = None) -> DataFrame:
    """(t1, t2, label1, label2, overlap, iou, ratio_1, ratio_2, cost) of labels that share voxels ``max_gap`` frames or fewer apart.

    Runs are cut into tiles of a row and meet by an equi join on (frame, z, y, tile);
    the runs of one frame do not overlap, so a tile has few of either side whatever
    the length of the row.  Each run joins its own frame number shifted by every
    gap, so no theta join is planned, and the shared voxels of the tiles add up.
    cost = offset + sum of coefficients times features (default 1 - ratio_2), kept
    up to ``cutoff``.
    """
    coefs = {"ratio_2": -1.0} if coefs is None else coefs
    by_movie = by(runs)
    own = foreground(runs).select(*by_movie, "t", "z", "y", "x0", "x1", "label")
    area = own.groupBy(*by_movie, "t", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    cut = tiled(own)
    later = cut.select(*by_movie, F.col("t").alias("t2"), "z", "y", "tile", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("label2"))
    earlier = cut.select(*by_movie, F.col("t").alias("t1"), F.explode(F.sequence(F.col("t") + 1, F.col("t") + max_gap)).alias("t2"), "z", "y", "tile", "x0", "x1", F.col("label").alias("label1"))
    both = earlier.join(later, [*by_movie, "t2", "z", "y", "tile"]).where("x0 <= u1 AND x1 >= u0")
    pairs = both.groupBy(*by_movie, "t1", "t2", "label1", "label2").agg(F.sum(F.least("x1", "u1") - F.greatest("x0", "u0") + 1).alias("overlap"))
    for k in "12":
        pairs = pairs.join(area.select(*by_movie, F.col("t").alias(f"t{k}"), F.col("label").alias(f"label{k}"), F.col("area").alias(f"area{k}")), [*by_movie, f"t{k}", f"label{k}"])
    features = {"iou": F.col("overlap") / (F.col("area1") + F.col("area2") - F.col("overlap")), "ratio_1": F.col("overlap") / F.col("area1"), "ratio_2": F.col("overlap") / F.col("area2")}
    pairs = pairs.withColumns(features)
    cost = F.lit(offset)
    for name, weight in coefs.items():
        cost = cost + F.lit(weight) * F.col(name)
    pairs = pairs.withColumn("cost", cost).drop("area1", "area2")
    return pairs.where(F.col("cost") <= cutoff) if cutoff is not None else pairs


#: Cells of one cube and frame that make it a full one, whose cells are dealt over tasks.
FULL_CUBE = 256
#: Cubes are halved while one holds more cells of a frame than this (and eight times k), and no more often than this.
DENSE_CUBE, HALVINGS = 64, 20


def distance_candidates(cells: DataFrame, max_distance: float, k: int, max_gap: int = 1) -> DataFrame:
    """(t1, t2, id1, id2, d2): for each later cell its ``k`` nearest within ``max_distance`` in the ``max_gap`` frames before.

    Space is cut into cubes of ``max_distance``, and into halves of those while cubes
    are dense.  A later cell first meets the smallest cube around it that holds ``k``
    earlier ones; its k-th nearest there bounds how far the search has to go.  Then
    it meets its own and the 26 neighbouring cubes of the smallest side that covers
    this bound, by an equi join, so the pairs of a cell do not grow with the density.
    Of earlier cells at one place only the ``k`` of smallest id are asked.  The cells
    of a full cube (over :data:`FULL_CUBE` on its frame) are dealt into parts by id,
    and a later cell meets every part in another task.
    """
    own = by(cells)
    placed = staged(cells.where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").select(*own, "id", "t", "z", "y", "x"), "placed")
    early = placed.select(*own, F.col("id").alias("id1"), F.col("t").alias("t1"), F.explode(F.sequence(F.col("t") + 1, F.col("t") + max_gap)).alias("t2"), *[F.col(a).alias(f"{a}1") for a in "zyx"])
    first = F.row_number().over(Window.partitionBy(*own, "t2", "z1", "y1", "x1").orderBy("id1"))
    early = staged(early.withColumn("tl_k", first).where(F.col("tl_k") <= k).drop("tl_k"), "early")
    late = placed.select(*own, F.col("id").alias("id2"), F.col("t").alias("t2"), "z", "y", "x")
    box = ["bz", "by", "bx"]

    def side(level: int) -> float:
        return max_distance / (1 << level)

    def cube(level: int, mark: str = "") -> list[Column]:
        return [F.floor(F.col(f"{a}{mark}") / side(level)).alias(f"b{a}") for a in "zyx"]

    def at_level(frame: DataFrame, levels: range, mark: str = "") -> DataFrame:
        spots = [F.struct(F.lit(i).alias("level"), *cube(i, mark)) for i in levels]
        return frame.withColumn("tl_s", F.explode(F.array(*spots))).select(*frame.columns, "tl_s.*")

    levels = 1
    while levels <= HALVINGS and not early.groupBy(*own, "t2", *cube(levels - 1, "1")).count().where(F.col("count") > max(DENSE_CUBE, 8 * k)).isEmpty():
        levels += 1
    every = range(levels)
    spot = [*own, "t2", "level", *box]
    cubed = at_level(early, every, "1")
    d2 = sum(((F.col(a) - F.col(f"{a}1")) * (F.col(a) - F.col(f"{a}1")) for a in "zyx"), F.lit(0.0))
    cell = [*own, "id2", "t2", "z", "y", "x"]
    most = max_distance * max_distance
    if levels == 1:
        bounded = late.withColumns({"bound": F.lit(most), "level": F.lit(0)})
    else:
        enough = cubed.groupBy(*spot).agg(F.count("*").alias("n")).where(F.col("n").between(k, FULL_CUBE)).select(*spot)
        around = at_level(late, every).join(enough, spot).groupBy(*cell).agg(F.max("level").alias("level"))
        around = around.select(*cell, "level", *[F.element_at(F.array(*[cube(i)[j] for i in every]), F.col("level") + 1).alias(b) for j, b in enumerate(box)])
        kth = F.row_number().over(Window.partitionBy(*cell).orderBy("d2"))
        near = around.join(cubed, spot).select(*cell, d2.alias("d2")).withColumn("tl_k", kth).where(F.col("tl_k") <= k)
        bounds = near.where(F.col("tl_k") == k).select(*cell, F.least("d2", F.lit(most)).alias("bound")).distinct()
        bounded = late.join(bounds, cell, "left").withColumn("bound", F.coalesce("bound", F.lit(most)))
        level = F.lit(0)
        for i in every[1:]:
            level = F.when(F.col("bound") <= side(i) * side(i), F.lit(i)).otherwise(level)
        bounded = bounded.withColumn("level", level)
    full = cubed.groupBy(*spot).agg(F.count("*").alias("n")).where(F.col("n") > FULL_CUBE).select(*spot, F.ceil(F.col("n") / FULL_CUBE).cast("long").alias("parts"))
    early = cubed.join(full, spot, "left").withColumn("part", F.pmod(F.xxhash64("id1"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    mine = [F.element_at(F.array(*[cube(i)[j] for i in every]), F.col("level") + 1).alias(b) for j, b in enumerate(box)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip("zyx", step, strict=True)]) for step in product((-1, 0, 1), repeat=3)]))
    late = bounded.select(*cell, "bound", "level", *mine).withColumn("b", steps).select(*cell, "bound", "level", *[(F.col(f"b{a}") + F.col(f"b.d{a}")).alias(f"b{a}") for a in "zyx"])
    late = late.join(full, spot, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    near = late.join(early.hint("merge"), [*spot, "part"]).withColumn("d2", d2).where(F.col("d2") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy(*own, "id2").orderBy("d2", "id1"))
    return near.withColumn("k", rank).where(F.col("k") <= k).select(*own, "t1", "t2", "id1", "id2", "d2")


def link_mutual_best(candidates: DataFrame, cutoff: float, split_cutoff: float | None = None) -> DataFrame:
    """(parent, child, cost, kind) from candidates (parent, child, cost).

    A pair links if each is the other's cheapest (ties: smaller id) within
    ``cutoff``.  With ``split_cutoff`` a parent may take one more child, the
    cheapest of the children left that rank it first.  Mutual best is not the
    globally cheapest assignment; it needs two windows and no solver.
    """
    own = by(candidates)
    usable = candidates.where(F.col("cost") <= max(cutoff, split_cutoff or cutoff))
    ranked = usable.withColumns({"p": F.row_number().over(Window.partitionBy(*own, "parent").orderBy("cost", "child")), "c": F.row_number().over(Window.partitionBy(*own, "child").orderBy("cost", "parent"))})
    main = ranked.where((F.col("p") == 1) & (F.col("c") == 1) & (F.col("cost") <= cutoff)).select(*own, "parent", "child", "cost", F.lit("link").alias("kind"))
    if split_cutoff is None:
        return main
    rest = ranked.where((F.col("c") == 1) & (F.col("cost") <= split_cutoff)).join(main.select(*own, "parent"), [*own, "parent"], "left_semi").join(main.select(*own, "child"), [*own, "child"], "left_anti")
    second = rest.withColumn("s", F.row_number().over(Window.partitionBy(*own, "parent").orderBy("cost", "child"))).where("s = 1")
    return main.unionByName(second.select(*own, "parent", "child", "cost", F.lit("split").alias("kind")))


def assign_ids(nodes: DataFrame) -> DataFrame:
    """(src, id): 1, 2, ... in (t, track, src) order, by ranges rather than one global window."""
    own = by(nodes)
    return number_rows(nodes.select(*own, "t", "track", "src"), ["t", "track", "src"], "id").select(*own, "src", "id")
