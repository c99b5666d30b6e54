"""Label volumes as run tables (t, z, y, x0, x1, label), both ends inclusive; closed forms, no per-voxel code."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.keys import by
from tracklake.plans.staging import staged
from tracklake.schemas import MAX_LABEL_ID

#: Voxels of a tile, as many as a long has bits: spans are cut at tile borders before they meet, so a key holds no more than a tile's width of spans that do not overlap.
TILE = 64


def _count() -> Column:
    return F.col("x1") - F.col("x0") + 1


def foreground(labels: DataFrame) -> DataFrame:
    return labels.where("label <> 0")


def to_runs(voxels: DataFrame, keys: tuple[str, ...] = ("t", "z", "y")) -> DataFrame:
    """Voxels (keys, x, label) -> maximal runs of one label."""
    own = [*by(voxels), *keys]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*own, "label").orderBy("x"))
    return voxels.withColumn("tl_island", island).groupBy(*own, "label", "tl_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*own, "x0", "x1", "label")


def explode_runs(runs: DataFrame) -> DataFrame:
    keys = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"))


def tiled(runs: DataFrame, width: int = TILE) -> DataFrame:
    """Runs cut at tile borders, with their ``tile``."""
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    cut = runs.withColumn("tile", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))))
    return cut.select(*rest, "tile", F.greatest("x0", F.col("tile") * width).alias("x0"), F.least("x1", F.col("tile") * width + (width - 1)).alias("x1"))


def merge_runs(runs: DataFrame, keys: tuple[str, ...] = ("z", "y")) -> DataFrame:
    """Union of x spans that touch or overlap within a row: (keys, x0, x1)."""
    keys = tuple(dict.fromkeys((*by(runs), *keys)))
    row = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0)
    flagged = runs.select(*keys, "x0", "x1", new.alias("tl_new"))
    island = flagged.withColumn("tl_island", F.sum("tl_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "tl_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("tl_island")


def union_sets(*sets: DataFrame, keys: tuple[str, ...] = ("z", "y")) -> DataFrame:
    by(*sets)
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return merge_runs(out, keys)


def label_inventory(runs: DataFrame) -> DataFrame:
    """Per (t, label): area, coordinate sums, exact box; background skipped.  One partial and one final aggregation."""
    n = _count()
    out = foreground(runs).groupBy(*by(runs), "t", "label")
    return out.agg(
        F.sum(n).alias("area"), F.sum(F.col("z") * n).alias("sum_z"), F.sum(F.col("y") * n).alias("sum_y"), F.sum(F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")).alias("sum_x"),
        F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
    )


def scan_label(runs: DataFrame, t: int, label: int) -> DataFrame:
    """One row; area 0, sums 0 and a null box where the label is absent.  For runs of many movies one row for each that has runs."""
    own = by(runs)
    n = _count()
    hit = (F.col("t") == t) & (F.col("label") == label) & (F.col("label") != 0)
    zero = F.lit(0).cast("long")
    sums = {"area": n, "sum_z": F.col("z") * n, "sum_y": F.col("y") * n, "sum_x": F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")}
    box = [F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("bx0"), F.max("x1").alias("bx1")]
    found = runs.where(hit).groupBy(*own).agg(*[F.coalesce(F.sum(x), zero).alias(k) for k, x in sums.items()], *box)
    if own:
        found = runs.select(*own).distinct().join(found, own, "left").fillna(0, list(sums))
    return found.select(*own, F.lit(t).cast("long").alias("t"), F.lit(label).cast("long").alias("label"), *sums, "z0", "z1", "y0", "y1", F.col("bx0").alias("x0"), F.col("bx1").alias("x1"))


def inventory_flags(inventory: DataFrame, ceiling: int = MAX_LABEL_ID) -> DataFrame:
    """(label, flag): ids above the ceiling, ids on more than one frame."""
    own = by(inventory)
    wide = inventory.where(F.col("label") > ceiling).select(*own, "label", F.lit("too_large").alias("flag")).distinct()
    twice = inventory.groupBy(*own, "label").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(*own, "label", F.lit("many_frames").alias("flag"))
    return wide.unionByName(twice)


def region_props(runs: DataFrame) -> DataFrame:
    inv = label_inventory(runs)
    return inv.select(*by(runs), "t", "label", *[(F.col(f"sum_{a}") / F.col("area")).alias(a) for a in "zyx"])


def publish_inventory(inventory: DataFrame, cells: DataFrame, edits: DataFrame, blobs: DataFrame, floor: int | DataFrame = 0) -> dict[str, DataFrame]:
    """The tables after a finished scan, to be swapped in together: mask_labels, mask_extent, cells, edits, blobs, next_id.

    mask_labels and mask_extent are rewritten whole from the scan; labels of positive
    area without a cell get one (on their first frame, if they are on several), others stay as they are; mask edits and their
    snapshots go, since they hold bytes of the store before; the next free id is past
    every label and never below ``floor`` (one number, or (dataset, floor)).  The
    inventory goes into four of the tables and is written first, so the volume is
    scanned once.
    """
    own = by(inventory, cells, edits, blobs)
    inventory = staged(inventory, "inventory")
    first = inventory.where("area > 0").groupBy(*own, F.col("label").alias("id")).agg(F.min_by(F.struct("t", "area", "sum_z", "sum_y", "sum_x"), "t").alias("f")).select(*own, "id", "f.*")
    found = first.select(*own, "id", "t", *[(F.col(f"sum_{a}") / F.col("area")).alias(a) for a in "zyx"], "area")
    new = found.join(cells.select(*own, "id"), [*own, "id"], "left_anti")
    top = inventory.groupBy(*own).agg((F.coalesce(F.max("label"), F.lit(0)) + 1).alias("next_id"))
    if isinstance(floor, int):
        top = top.withColumn("next_id", F.greatest("next_id", F.lit(floor)))
    else:
        top = top.join(floor, own, "full").select(*own, F.greatest("next_id", "floor").alias("next_id"))
    kept = edits.where("domain <> 'mask'")
    box = ("z0", "z1", "y0", "y1", "x0", "x1")
    return {
        "mask_labels": inventory.select(*own, "t", "label"), "mask_extent": inventory.select(*own, "t", "label", *box, "area", "sum_z", "sum_y", "sum_x"), "cells": cells.unionByName(new, allowMissingColumns=True),
        "edits": kept, "blobs": blobs.join(edits.where("domain = 'mask'").select(*own, "seq"), [*own, "seq"], "left_anti"), "next_id": top,
    }


def object_counts(runs: DataFrame) -> DataFrame:
    """Foreground labels per frame; empty frames do not appear."""
    return foreground(runs).groupBy(*by(runs), "t").agg(F.countDistinct("label").alias("objects"))


def drop_small(runs: DataFrame, min_size: int = 15) -> DataFrame:
    key = [*by(runs), "t", "label"]
    big = foreground(runs).groupBy(*key).agg(F.sum(_count()).alias("n")).where(F.col("n") >= min_size)
    return runs.join(big.select(key), key, "left_semi")


def narrow_dtype(runs: DataFrame) -> DataFrame:
    """(t, dtype): u16 below 65536, else u32."""
    return runs.groupBy(*by(runs), "t").agg(F.when(F.max("label") < 65536, "u16").otherwise("u32").alias("dtype"))


def relabel(runs: DataFrame, nodes: DataFrame, t_offset: int = 0) -> DataFrame:
    """Runs whose value is a track id of ``nodes`` (t, track, id) on its frame, with the node's id instead."""
    own = by(runs, nodes)
    key = nodes.select(*own, (F.col("t") + t_offset).alias("t"), F.col("track").alias("label"), F.col("id").alias("to"))
    return runs.join(key, [*own, "t", "label"]).drop("label").withColumnRenamed("to", "label")


def relabel_by_track(runs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Value = track_id + 1; labels without a track become 0 and go; ``tracks`` is (t, label, track_id)."""
    out = runs.join(tracks, [*by(runs, tracks), "t", "label"], "left").withColumn("label", F.coalesce(F.col("track_id") + 1, F.lit(0))).drop("track_id")
    return foreground(out)


def remap_to_tracks(runs: DataFrame, cells: DataFrame, slots: DataFrame | None = None, base: int = 16777216, stride: int = 1024) -> DataFrame:
    """Display values: 0 stays, an id becomes its track (or itself), a highlighted id becomes base + slot * stride."""
    own = by(runs, cells)
    out = runs.join(cells.select(*own, F.col("id").alias("label"), F.coalesce("track_id", "id").alias("shown")), [*own, "label"], "left")
    value = F.when(F.col("label") == 0, 0).otherwise(F.coalesce("shown", "label"))
    if slots is not None:
        out = out.join(slots.select(*by(runs, slots), F.col("id").alias("label"), "slot"), [*own, "label"], "left")
        value = F.when(F.col("slot").isNotNull(), base + F.col("slot") * stride).otherwise(value)
    return out.withColumn("value", value).drop("shown", "slot")


def relabel_mismatches(runs: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """(t, value, problem): values without a node, nodes without voxels; the first ``limit`` in order, of each movie."""
    own = by(runs, nodes)
    have = foreground(runs).select(*own, "t", F.col("label").alias("value"), F.lit(True).alias("voxels")).distinct()
    want = nodes.select(*own, "t", F.col("track").alias("value"), F.lit(True).alias("node")).distinct()
    both = have.join(want, [*own, "t", "value"], "full").where("voxels IS NULL OR node IS NULL")
    out = both.select(*own, "t", "value", F.when(F.col("node").isNull(), "no_node").otherwise("no_voxels").alias("problem"))
    if not own:
        return out.orderBy("t", "value").limit(limit)
    return out.withColumn("tl_k", F.row_number().over(Window.partitionBy(*own).orderBy("t", "value"))).where(F.col("tl_k") <= limit).drop("tl_k")


def stamp_runs(stamps: DataFrame, dims: tuple[int, int, int], scale: tuple[float, float, float] | None = None) -> DataFrame:
    """Runs (stamp columns, z, y, x0, x1) of ellipsoids at fractional centres (cz, cy, cx), radius r.

    A voxel belongs if its centre does; radii follow the voxel size, bounds are
    clipped, ``plane_axis``/``plane_index`` columns (optional) pin one axis.
    Radii that are not positive and finite give nothing.  A row of an ellipsoid is
    one span, so x is only grouped.
    """
    sz, sy, sx = scale if scale and all(0 < s < float("inf") for s in scale) else (1.0, 1.0, 1.0)
    keys = [c for c in stamps.columns if c not in ("cz", "cy", "cx", "r", "plane_axis", "plane_index")]
    out = stamps.where("r > 0 AND r < double('Infinity')").withColumns({"rz": F.col("r") * sx / sz, "ry": F.col("r") * sx / sy, "rx": F.col("r") * 1.0})
    for axis, size in zip("zyx", dims, strict=True):
        low, high = F.floor(F.col(f"c{axis}") - F.col(f"r{axis}") - 0.5), F.floor(F.col(f"c{axis}") + F.col(f"r{axis}"))
        out = out.withColumns({f"{axis}_lo": F.greatest(low, F.lit(0)), f"{axis}_hi": F.least(high, F.lit(size - 1))}).where(F.col(f"{axis}_lo") <= F.col(f"{axis}_hi"))
        if "plane_axis" in stamps.columns:
            pinned = F.col("plane_axis") == axis
            out = out.where(~F.coalesce(pinned, F.lit(False)) | F.col("plane_index").between(F.col(f"{axis}_lo"), F.col(f"{axis}_hi")))
            out = out.withColumns({f"{axis}_lo": F.when(pinned, F.col("plane_index")).otherwise(F.col(f"{axis}_lo")), f"{axis}_hi": F.when(pinned, F.col("plane_index")).otherwise(F.col(f"{axis}_hi"))})
    square = F.lit(0.0)
    for axis in "zyx":
        out = out.withColumn(axis, F.explode(F.sequence(f"{axis}_lo", f"{axis}_hi")))
        d = (F.col(axis) + 0.5 - F.col(f"c{axis}")) / F.col(f"r{axis}")
        square = square + d * d
        out = out.where(square <= 1.0)
    return out.groupBy(*keys, "z", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))


def rasterize_strokes(stamps: DataFrame, dims: tuple[int, int, int], scale: tuple[float, float, float] | None = None, stroke: str = "stroke", limit: int = 4096) -> DataFrame:
    """Runs of each stroke: the union of its stamps; more than ``limit`` stamps of one stroke raise."""
    if not stamps.groupBy(*by(stamps), stroke).count().where(F.col("count") > limit).isEmpty():
        raise ValueError(f"a stroke has more than {limit} stamps")
    keys = [c for c in stamps.columns if c not in ("cz", "cy", "cx", "r", "plane_axis", "plane_index", "stamp")]
    return merge_runs(stamp_runs(stamps, dims, scale), (*keys, "z", "y"))


def apply_strokes(runs: DataFrame, strokes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs after, changes) of many strokes, in ``seq`` order.

    ``strokes``: t, z, y, x0, x1, seq, mode (paint, erase, scoped), label, only.
    ``changes``: t, z, y, x0, x1, old, new of spans that differ.

    Rows of voxels that strokes meet are swept tile by tile: all spans are cut at
    tile borders and at each other's ends, so a tile has at most :data:`TILE`
    elementary spans however many strokes cross it, and the pairs that meet grow
    with the strokes, not with their square.  What a span holds in the end follows
    from the last paint or erase over it (else its old value) and from whether a
    scoped erase of just that value comes after.  Other rows pass through.
    """
    own = by(runs, strokes)
    row = [*own, "t", "z", "y"]
    met = strokes.select(row).distinct()
    quiet, busy = runs.join(met, row, "left_anti"), runs.join(met, row, "left_semi")
    key = [*row, "tile"]
    have, work = tiled(busy.select(*row, "x0", "x1", "label")), tiled(strokes.select(*row, "x0", "x1", "seq", "mode", "label", "only"))
    cuts = have.select(*key, "x0", "x1").unionByName(work.select(*key, "x0", "x1")).select(*key, F.explode(F.array(F.col("x0"), F.col("x1") + 1)).alias("x0")).distinct()
    spans = cuts.withColumn("x1", F.lead("x0").over(Window.partitionBy(*key).orderBy("x0")) - 1).where("x1 IS NOT NULL")

    def over(cover: DataFrame, *columns: str) -> tuple[DataFrame, Column]:
        """``cover`` under other names, and the condition that it lies over a span."""
        named = cover.select(*[F.col(c).alias(f"k_{c}") for c in (*key, "x0", "x1", *columns)])
        same = F.col("k_tile") == F.col("tile")
        for c in row:
            same = same & (F.col(f"k_{c}") == F.col(c))
        return named, same & (F.col("k_x0") <= F.col("x0")) & (F.col("k_x1") >= F.col("x1"))

    named, lies = over(have, "label")
    old = spans.join(named, lies, "left").groupBy(*key, "x0", "x1").agg(F.coalesce(F.max("k_label"), F.lit(0)).alias("old"))
    put = work.where("mode IN ('paint', 'erase')").withColumn("label", F.when(F.col("mode") == "paint", F.col("label")).otherwise(0))
    named, lies = over(put, "seq", "label")
    last = F.max(F.when(F.col("k_seq").isNotNull(), F.struct("k_seq", "k_label")))
    told = old.join(named, lies, "left").groupBy(*key, "x0", "x1", "old").agg(last.alias("last")).select(*key, "x0", "x1", "old", F.coalesce("last.k_label", "old").alias("value"), F.col("last.k_seq").alias("since"))
    named, lies = over(work.where("mode = 'scoped'"), "seq", "only")
    wiped = lies & (F.col("k_only") == F.col("value")) & (F.col("since").isNull() | (F.col("k_seq") > F.col("since")))
    done = told.join(named, wiped, "left").groupBy(*key, "x0", "x1", "old", "value").agg(F.count("k_seq").alias("n"))
    done = done.withColumn("new", F.when(F.col("n") > 0, F.lit(0).cast("long")).otherwise(F.col("value")))
    after = merge_runs(done.where("new <> 0").select(*row, "x0", "x1", F.col("new").alias("label")), (*row, "label"))
    changes = merge_runs(done.where("new <> old").select(*row, "x0", "x1", "old", "new"), (*row, "old", "new"))
    return quiet.unionByName(after.select(quiet.columns)), changes.select(*row, "x0", "x1", "old", "new")


def change_deltas(changes: DataFrame) -> DataFrame:
    """(t, label, area, sum_z, sum_y, sum_x) gained or lost by each label; background is not reported."""
    n = _count()
    both = changes.select("*", F.explode(F.array(F.struct(F.col("old").alias("label"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("label"), F.lit(1).alias("sign")))).alias("side"))
    sign = F.col("side.sign")
    sums = [F.sum(sign * n).alias("area"), F.sum(sign * F.col("z") * n).alias("sum_z"), F.sum(sign * F.col("y") * n).alias("sum_y"), F.sum(sign * F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")).alias("sum_x")]
    return both.where("side.label <> 0").groupBy(*by(changes), "t", F.col("side.label").alias("label")).agg(*sums)


def clear_label(runs: DataFrame, t: int, label: int, box: tuple[int, int, int, int, int, int]) -> DataFrame:
    """Runs without ``label`` on frame ``t`` inside the box z0, z1, y0, y1, x0, x1; spans are cut at its sides."""
    z0, z1, y0, y1, bx0, bx1 = box
    hit = (F.col("t") == t) & (F.col("label") == label) & F.col("z").between(z0, z1) & F.col("y").between(y0, y1) & (F.col("x0") <= bx1) & (F.col("x1") >= bx0)
    sides = F.array(F.struct(F.col("x0"), F.least(F.col("x1"), F.lit(bx0 - 1)).alias("x1")), F.struct(F.greatest(F.col("x0"), F.lit(bx1 + 1)).alias("x0"), F.col("x1")))
    kept = F.when(hit, F.filter(sides, lambda s: s.x0 <= s.x1)).otherwise(F.array(F.struct("x0", "x1")))
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*rest, F.explode(kept).alias("s")).select(*rest, "s.x0", "s.x1").select(runs.columns)


def affected_chunks(runs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Distinct (t, gz, gy, gx) that the runs touch."""
    cz, cy, cx = shape
    x = F.explode(F.sequence(F.expr(f"x0 div {cx}"), F.expr(f"x1 div {cx}")))
    return runs.select(*by(runs), "t", F.expr(f"z div {cz}").alias("gz"), F.expr(f"y div {cy}").alias("gy"), x.alias("gx")).distinct()


def regenerate_coarse(runs: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Point samples at multiples of the factors; ids are never averaged."""
    fz, fy, fx = (max(1, f) for f in factors)
    rest = [c for c in runs.columns if c not in ("z", "y", "x0", "x1")]
    out = runs.where((F.col("z") % fz == 0) & (F.col("y") % fy == 0))
    return out.select(*rest, F.expr(f"z div {fz}").alias("z"), F.expr(f"y div {fy}").alias("y"), F.expr(f"(x0 + {fx - 1}) div {fx}").alias("x0"), F.expr(f"x1 div {fx}").alias("x1")).where("x0 <= x1")


def label_pyramid(runs: DataFrame, full: tuple[int, int, int], level: tuple[int, int, int]) -> DataFrame:
    """Runs of a level whose index i samples floor(i * full / level) on each axis; differs from
    :func:`regenerate_coarse` where the ratio is not whole.

    The indices that sample a voxel v are those from ceil(v * level / full) up to that
    of v + 1, so a run stays a run and nothing is joined.
    """
    rest = [c for c in runs.columns if c not in ("z", "y", "x0", "x1")]

    def first(c: str, axis: int, plus: int = 0) -> Column:
        n, m = full[axis], level[axis]
        return F.expr(f"(({c} + {plus}) * {m} + {n - 1}) div {n}")

    out = runs
    for axis, name in enumerate("zy"):
        low, high = first(name, axis), first(name, axis, 1) - 1
        out = out.withColumns({"tl_low": low, "tl_high": high}).where("tl_low <= tl_high").withColumn(name, F.explode(F.sequence("tl_low", "tl_high"))).drop("tl_low", "tl_high")
    out = out.select(*rest, "z", "y", first("x0", 2).alias("x0"), (first("x1", 2, 1) - 1).alias("x1")).where("x0 <= x1")
    keys = (*[c for c in rest if c != "label"], "z", "y", "label")
    return merge_runs(out, keys).select(*rest, "z", "y", "x0", "x1")


def plane_spans(runs: DataFrame, axis: str, index: int, factors: tuple[int, int, int]) -> DataFrame:
    """Spans on one plane of a coarse level, (t, label, row, a0, a1); nothing if the plane is no sample point."""
    own = by(runs)
    coarse = regenerate_coarse(runs, factors)
    if axis == "z":
        return coarse.where(F.col("z") == index).select(*own, "t", "label", F.col("y").alias("row"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    if axis == "y":
        return coarse.where(F.col("y") == index).select(*own, "t", "label", F.col("z").alias("row"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    return coarse.where((F.col("x0") <= index) & (F.col("x1") >= index)).select(*own, "t", "label", F.col("z").alias("row"), F.col("y").alias("a0"), F.col("y").alias("a1"))


def label_outline(runs: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(t, y, x, owner) of the outline of highlighted labels, from their runs (t, y, x0, x1, label; z too where there is one).

    A highlighted pixel with a 4-neighbour of another value is outline, and so is
    that neighbour unless another highlighted cell owns it (the smallest label wins
    a contested pixel).  The array edge is no boundary.  Rows are compared as
    intervals: a run less the runs of its label in the row above or below is
    outline, and less all runs of that row it is the outline beyond it; only
    outline pixels become rows.
    """
    height, width = size
    plane = [*by(runs), "t", *[c for c in ("z",) if c in runs.columns]]
    runs = merge_runs(runs.select(*plane, "y", "x0", "x1", "label"), (*plane, "y", "label"))
    row = Window.partitionBy(*plane, "y").orderBy("x0")
    sides = runs.withColumns({"left": F.lag("x1").over(row), "right": F.lead("x0").over(row)})
    at = [
        F.when(F.col("x0") > 0, F.col("x0")), F.when((F.col("x0") > 0) & ~F.col("left").eqNullSafe(F.col("x0") - 1), F.col("x0") - 1),
        F.when(F.col("x1") < width - 1, F.col("x1")), F.when((F.col("x1") < width - 1) & ~F.col("right").eqNullSafe(F.col("x1") + 1), F.col("x1") + 1),
    ]
    ends = sides.select(*plane, "y", F.explode(F.array_compact(F.array(*at))).alias("x"), F.col("label").alias("owner"))
    cut = tiled(runs)
    near = cut.select(*plane, "tile", F.col("y").alias("own_y"), "x0", "x1", F.col("label").alias("owner"), F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y")).where(F.col("y").between(0, height - 1))
    other = cut.select(*plane, "y", "tile", F.col("x0").alias("u0"), F.col("x1").alias("u1"), "label")
    mine = [*plane, "tile", "own_y", "y", "x0", "x1", "owner"]
    # a tile is as wide as a long: what lies over a piece of a run is a mask of its pixels, and masks add up without lists
    same_row = [F.col(c).alias(f"k_{c}") for c in (*plane, "y", "tile")]
    meets = (F.col("u0") <= F.col("x1")) & (F.col("u1") >= F.col("x0"))
    for c in (*plane, "y", "tile"):
        meets = meets & (F.col(f"k_{c}") == F.col(c))
    low, high = F.greatest("x0", "u0"), F.least("x1", "u1")
    bits = near.join(other.select(*same_row, "u0", "u1", "label"), meets, "left").select(*mine, "label", (low - F.col("tile") * TILE).cast("int").alias("at"), F.when(F.col("u0").isNotNull(), high - low + 1).cast("int").alias("n"))
    bits = bits.withColumn("mask", F.expr(f"if(n IS NULL, 0L, shiftleft(shiftrightunsigned(-1L, {TILE} - n), at))"))
    over = bits.groupBy(*mine).agg(F.bit_or(F.when(F.col("label") == F.col("owner"), F.col("mask")).otherwise(0)).alias("same"), F.bit_or("mask").alias("any"))

    def left_of(mask: str) -> Column:
        return F.explode(F.expr(f"filter(sequence(x0, x1), x -> (shiftright({mask}, CAST(x - tile * {TILE} AS INT)) & 1L) = 0)")).alias("x")

    inner = over.select(*plane, F.col("own_y").alias("y"), left_of("same"), "owner")
    outer = over.select(*plane, "y", left_of("any"), "owner")
    return ends.unionByName(inner).unionByName(outer).groupBy(*plane, "y", "x").agg(F.min("owner").alias("owner"))


def set_digest(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, digest): FNV-1a over the sorted (z, y, x) of each voxel set as little-endian u32.

    The hash takes its bytes one after the other, so a set is one task's work; rows
    are sorted by Spark and streamed, and no set is held.
    """
    import numpy as np
    import pyarrow as pa

    keys = tuple(dict.fromkeys((*by(runs), *keys)))
    schema = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, 0
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            z, y, x0, x1 = (batch.column(c).to_numpy() for c in ("z", "y", "x0", "x1"))
            done, kind = [], batch.select(keys).schema
            for i, name in enumerate(names):
                if name != now:
                    done += [(*now, h)] if now is not None else []
                    now, h = name, 0x811C9DC5
                n = int(x1[i] - x0[i] + 1)
                span = np.stack([np.full(n, z[i]), np.full(n, y[i]), np.arange(x0[i], x1[i] + 1)], 1)
                for b in span.astype("<u4").tobytes():
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), [*kind, pa.field("digest", pa.int64())], strict=True)], [*keys, "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, h), [*kind, pa.field("digest", pa.int64())], strict=True)], [*keys, "digest"])

    spans = merge_runs(runs, (*keys, "z", "y")).repartition(*keys).sortWithinPartitions(*keys, "z", "y", "x0")
    return spans.select(*keys, "z", "y", "x0", "x1").mapInArrow(run, f"{schema}, digest long")


def thin_stamps(points: DataFrame, stroke: str, radius: float, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), limit: int = 4096) -> DataFrame:
    """(stroke, part, seq, z, y, x): along each path keep a point only if it moved a third of the radius from the last kept one.

    Distances use the ellipsoid's axes.  A stroke ends at ``limit`` kept points and the
    next begins at the same point, which stands in both parts.  ``plane_axis`` and
    ``plane_index`` columns (optional) pin a kept point's axis to the middle of that
    voxel.  The rule looks back at what was kept, so the points of a path pass one
    task in order; only the last kept one is held.
    """
    import pyarrow as pa

    own = [*by(points), stroke]
    sz, sy, sx = scale
    least = (radius / 3) ** 2
    pinned = "plane_axis" in points.columns
    columns = [*own, "seq", "z", "y", "x", *(("plane_axis", "plane_index") if pinned else ())]
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in own) + ", place long, seq long, z double, y double, x double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last, k = None, None, 0
        for batch in batches:
            kept, places, moved = [], [], []
            names = list(zip(*[batch.column(c).to_pylist() for c in own], strict=True))
            at = list(zip(*[batch.column(c).to_pylist() for c in "zyx"], strict=True))
            pins = list(zip(batch.column("plane_axis").to_pylist(), batch.column("plane_index").to_pylist(), strict=True)) if pinned else None
            for i, ((z, y, x), name) in enumerate(zip(at, names, strict=True)):
                if name != path:
                    path, last, k = name, None, 0
                if last is None or ((z - last[0]) * sz / sx) ** 2 + ((y - last[1]) * sy / sx) ** 2 + (x - last[2]) ** 2 >= least:
                    last = (z, y, x)
                    if pins and pins[i][0]:
                        last = tuple(pins[i][1] + 0.5 if a == pins[i][0] else v for a, v in zip("zyx", last, strict=True))
                    kept.append(i)
                    places.append(k)
                    moved.append(last)
                    k += 1
            if kept:
                rows = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in own], pa.array(places, pa.int64()), rows.column("seq"), *[pa.array(c, pa.float64()) for c in zip(*moved, strict=True)]], [*own, "place", "seq", *"zyx"])

    ordered = points.select(*[F.col(c).cast("double").alias(c) if c in ("z", "y", "x") else F.col(c).cast("long").alias(c) if c == "seq" else F.col(c) for c in columns]).repartition(*own).sortWithinPartitions(*own, "seq")
    step = max(limit - 1, 1)  # new points of a part after the first
    here = F.expr(f"place div {step}")
    parts = F.when((F.col("place") > 0) & (F.col("place") % step == 0), F.array(here - 1, here)).otherwise(F.array(here))
    return ordered.mapInArrow(walk, schema).select(*own, F.explode(parts).alias("part"), "seq", "z", "y", "x")
