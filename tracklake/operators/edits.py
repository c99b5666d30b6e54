"""Incremental statistics, cell upserts and the edit journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.operators.keys import by
from tracklake.operators.labels import label_inventory, regenerate_coarse

KEY = ["t", "label"]
BOX = ("z0", "z1", "y0", "y1", "x0", "x1")
SUMS = ("sum_z", "sum_y", "sum_x")


def _box(sides: tuple[str, ...] = BOX) -> list[Column]:
    return [(F.min if c.endswith("0") else F.max)(c).alias(c) for c in sides]


def fold_extents(extent: DataFrame, deltas: DataFrame) -> DataFrame:
    """Extent plus deltas (t, label, area, sums, box or null): areas and sums add, sums are 0 at area 0, boxes only grow.

    Deltas of label 0 are passed over: an erasure writes it, and it is no object.
    ``error`` marks rows whose area would be negative.
    """
    key = [*by(extent, deltas), *KEY]
    both = extent.select(*key, "area", *SUMS, *BOX).unionByName(deltas.where("label <> 0").select(*key, "area", *SUMS, *BOX))
    out = both.groupBy(*key).agg(F.sum("area").alias("area"), *[F.sum(c).alias(c) for c in SUMS], *_box())
    return out.withColumns({c: F.when(F.col("area") == 0, F.lit(0)).otherwise(F.col(c)) for c in SUMS} | {"error": F.col("area") < 0})


def ensure_extent(extent: DataFrame, runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Scans only the asked labels that have no row; rows that exist are never overwritten."""
    key = [*by(extent, runs, keys), *KEY]
    missing = keys.select(*key).distinct().join(extent.select(*key), key, "left_anti")
    seen = label_inventory(runs.join(missing, key, "left_semi"))
    return extent.select(*key, "area", *SUMS, *BOX).unionByName(seen.select(*key, "area", *SUMS, *BOX))


def before_edit(scan: DataFrame, delta: DataFrame) -> DataFrame:
    """The row before an edit: the scan after it minus the edit's own delta; sums 0 at area 0."""
    key = [*by(scan, delta), *KEY]
    d = delta.select(*key, *[F.col(c).alias(f"d_{c}") for c in ("area", *SUMS)])
    out = scan.select(*key, "area", *SUMS).join(d, key, "left").withColumns({c: F.col(c) - F.coalesce(f"d_{c}", F.lit(0)) for c in ("area", *SUMS)})
    return out.select(*key, "area", *[F.when(F.col("area") == 0, F.lit(0)).otherwise(F.col(c)).alias(c) for c in SUMS])


def upsert_cells(cells: DataFrame, extent: DataFrame) -> DataFrame:
    """Cells with centroid and area of their extent; labels without a cell get one."""
    own = by(cells, extent)
    e = extent.where("area > 0").select(*own, F.col("label").alias("id"), F.col("t").alias("e_t"), F.col("area").alias("e_area"), *[(F.col(f"sum_{a}") / F.col("area")).alias(f"e_{a}") for a in "zyx"])
    out = cells.join(e, [*own, "id"], "full")
    new = {"t": F.coalesce("t", "e_t"), "area": F.coalesce("e_area", "area")} | {a: F.coalesce(f"e_{a}", a) for a in "zyx"}
    return out.withColumns(new).select(cells.columns)


def put_mask_labels(mask_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, label): the mask's labels and those of ``labels`` that it has not yet."""
    key = [*by(mask_labels, labels), *KEY]
    return mask_labels.select(*key).unionByName(labels.select(*key).distinct().join(mask_labels.select(*key), key, "left_anti"))


def apply_extents(cells: DataFrame, links: DataFrame, mask_labels: DataFrame, touched: DataFrame) -> dict[str, DataFrame]:
    """Tables after an edit whose labels have the folded extents ``touched``, as :func:`remove_cells` returns them.

    Labels without an area lose their cell with its links and mask label; the others
    get centroid and area of their extent, a cell where they had none, and their mask label.
    """
    own = by(cells, links, mask_labels, touched)
    seen = touched.where("label <> 0")
    out = remove_cells(cells, links, mask_labels, seen.where("area = 0").select(*own, F.col("label").alias("id"), "t"))
    return out | {"cells": upsert_cells(out["cells"], seen), "mask_labels": put_mask_labels(out["mask_labels"], seen.where("area > 0"))}


def remove_cells(cells: DataFrame, links: DataFrame, mask_labels: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Cells, links and mask labels without ``ids``, and the snapshots that restore them.

    Where ``ids`` has t, mask labels go on that frame only.
    """
    own = by(cells, links, mask_labels, ids)
    marks = [*own, *(["t"] if "t" in ids.columns else []), "label"]
    gone = ids.select(*own, "id").distinct()
    pair = [*own, "parent", "child"]
    cut = links.join(gone.withColumnRenamed("id", "parent"), [*own, "parent"], "left_anti").join(gone.withColumnRenamed("id", "child"), [*own, "child"], "left_anti")
    lost = links.join(cut.select(pair), pair, "left_anti")
    return {
        "cells": cells.join(gone, [*own, "id"], "left_anti"), "links": cut, "mask_labels": mask_labels.join(ids.withColumnRenamed("id", "label").select(marks).distinct(), marks, "left_anti"),
        "lost_cells": cells.join(gone, [*own, "id"], "left_semi"), "lost_links": lost,
    }


def restore_cells(cells: DataFrame, links: DataFrame, mask_labels: DataFrame, lost_cells: DataFrame, lost_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, links, mask labels) with exact rows back; a cell that exists by now is replaced by its snapshot, a link that exists stays as it is."""
    own = by(cells, links, mask_labels, lost_cells, lost_links)
    pair = [*own, "parent", "child"]
    back = cells.join(lost_cells.select(*own, "id"), [*own, "id"], "left_anti").unionByName(lost_cells)
    kept = links.unionByName(lost_links.select(links.columns).dropDuplicates(pair).join(links.select(pair), pair, "left_anti").select(links.columns))
    return back, kept, put_mask_labels(mask_labels, lost_cells.select(*own, "t", F.col("id").alias("label")))


def materialize(staged_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """Import upsert: file fields (features too, where both tables have them) replace, centroids only where the file has them, area and reviewed stay, src_id is the id."""
    key = [*by(staged_cells, cells), "id"]
    fields = ["t", "detection_confidence", "state", "track_id", "seg_id", "labels", "track_labels"]
    fields += ["features"] if "features" in staged_cells.columns and "features" in cells.columns else []
    s = staged_cells.select(*key, *[F.col(c).alias(f"s_{c}") for c in (*fields, "z", "y", "x")], F.lit(True).alias("staged"))
    out = cells.join(s, key, "full")
    new = {c: F.when(F.col("staged"), F.col(f"s_{c}")).otherwise(F.col(c)) for c in fields} | {a: F.coalesce(f"s_{a}", a) for a in "zyx"}
    new |= {"src_id": F.when(F.col("staged"), F.col("id")).otherwise(F.col("src_id")), "reviewed": F.coalesce("reviewed", F.lit(False))}
    return out.withColumns(new).select(cells.columns)


def negate(deltas: DataFrame) -> DataFrame:
    """Deltas that undo; an undo never widens a box."""
    return deltas.select(*by(deltas), *KEY, *[(-F.col(c)).alias(c) for c in ("area", *SUMS)], *[F.lit(None).cast("long").alias(c) for c in BOX])


def check_frame(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """(label, t, lives_at): edits on a label that lives on another frame."""
    own = by(cells, deltas)
    home = cells.select(*own, F.col("id").alias("label"), F.col("t").alias("lives_at"))
    return deltas.select(*own, "label", "t").distinct().join(home, [*own, "label"]).where("t <> lives_at")


def import_blocker(links: DataFrame, edits: DataFrame) -> DataFrame:
    """One row (a movie): number of links, of graph edits, and whether an import is refused."""
    own = by(links, edits)
    a = links.groupBy(*own).agg(F.count("*").alias("links"))
    b = edits.groupBy(*own).agg(F.coalesce(F.sum((F.col("domain") == "graph").cast("long")), F.lit(0)).alias("graph_edits"))
    both = a.join(b, own, "full").fillna(0, ["links", "graph_edits"]) if own else a.join(b)  # one row each
    return both.withColumn("blocked", (F.col("links") > 0) | (F.col("graph_edits") > 0))


def delta_affected(deltas: DataFrame) -> DataFrame:
    """(seq, tracks, cells): distinct sorted tracks and cells of graph deltas (seq, id, old, new)."""
    tracks = F.array_sort(F.array_union(F.collect_set("old"), F.collect_set("new")))
    return deltas.groupBy(*by(deltas), "seq").agg(tracks.alias("tracks"), F.array_sort(F.collect_set("id")).alias("cells"))


# --- journal ---------------------------------------------------------------


def clear_redo(edits: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undone rows go, and snapshots of rows that are gone."""
    key = [*by(edits, blobs), "seq"]
    kept = edits.where("NOT undone")
    return kept, blobs.join(kept.select(key), key, "left_semi")


def record(edits: DataFrame, blobs: DataFrame, op: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends ``op`` rows under new seqs after clearing undone rows; ``op`` has seq from 1 up in its own order (of each movie)."""
    own = by(edits, blobs, op)
    kept, snapshots = clear_redo(edits, blobs)
    top = edits.groupBy(*own).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("tl_top"))
    fresh = op.join(top, own, "left") if own else op.join(F.broadcast(top))  # one row
    return kept.unionByName(fresh.withColumn("seq", F.col("seq") + F.coalesce("tl_top", F.lit(0))).select(edits.columns)), snapshots


def mark_undone(edits: DataFrame, seqs: DataFrame, undone: bool) -> DataFrame:
    key = [*by(edits, seqs), "seq"]
    hit = edits.join(seqs.select(*key, F.lit(True).alias("hit")), key, "left")
    return hit.withColumn("undone", F.when(F.col("hit"), F.lit(undone)).otherwise(F.col("undone"))).select(edits.columns)


def delete_edits(edits: DataFrame, blobs: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = [*by(edits, blobs, seqs), "seq"]
    return edits.join(seqs.select(key), key, "left_anti"), blobs.join(seqs.select(key), key, "left_anti")


def _live(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of committed edits that are not undone."""
    key = [*by(edits, rows), "seq"]
    return rows.join(edits.where("NOT undone AND NOT pending").select(key), key, "left_semi")


def replay_extents(base: DataFrame, edits: DataFrame, deltas: DataFrame) -> DataFrame:
    """Extents after every committed edit that is not undone: sums commute, so one aggregation folds all; ``deltas`` has seq."""
    return fold_extents(base, _live(edits, deltas))


def replay_last(edits: DataFrame, writes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the last committed write of each key; ``writes`` has seq."""
    live = _live(edits, writes)
    return live.groupBy(*by(live), key).agg(F.max_by(value, "seq").alias(value))


def replay_graph(cells: DataFrame, links: DataFrame, edits: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, links) after every committed edit that is not undone, in ``seq`` order.

    ``ops``, one row for each step of an edit (seq, step, kind, id, other, value, names):

    * ``link`` (parent id, child other, confidence value; not reviewed) and ``cut`` (id, other);
    * ``track`` (id, track other or null);
    * ``label`` and ``unlabel`` (id, names), ``track_label`` and ``track_unlabel``;
    * ``remove`` (id): the cell goes, with all its links;
    * ``restore`` (id, track other, names its labels): the cell is there as it was.

    Steps on different keys commute, and on one key the last write counts, so each
    kind folds by its key with a maximum and no history is gathered:  a cell by its
    last remove or restore, a link by its last link, cut or removal of an end, a
    track by its last track or restore.  Labels fold name by name.
    """
    own = by(cells, links, edits, ops)
    at = F.struct("seq", "step")
    live = _live(edits, ops).withColumn("at", at)
    gone = live.where("kind IN ('remove', 'restore')").groupBy(*own, "id").agg(F.max(F.struct("at", "kind")).alias("life"), F.max(F.when(F.col("kind") == "remove", F.col("at"))).alias("removed"))
    gone = gone.select(*own, "id", (F.col("life.kind") == "remove").alias("dead"), "removed")
    # links: the last of link and cut, unless an end was removed after it
    last = live.where("kind IN ('link', 'cut')").groupBy(*own, F.col("id").alias("parent"), F.col("other").alias("child")).agg(F.max(F.struct("at", "kind", "value")).alias("w"))
    every = links.select(*own, "parent", "child", F.col("confidence").alias("was"), F.col("reviewed").alias("was_reviewed"), F.lit(True).alias("had")).join(last, [*own, "parent", "child"], "full")
    for end in ("parent", "child"):
        every = every.join(gone.select(*own, F.col("id").alias(end), F.col("removed").alias(f"{end}_removed")), [*own, end], "left")
    wiped = F.greatest("parent_removed", "child_removed")
    written = F.col("w").isNotNull()
    there = F.when(written, (F.col("w.kind") == "link") & (wiped.isNull() | (wiped < F.col("w.at")))).otherwise(F.col("had") & wiped.isNull())
    links_after = every.where(there).select(*own, "parent", "child", F.when(written, F.col("w.value")).otherwise(F.col("was")).alias("confidence"), F.when(written, F.lit(False)).otherwise(F.col("was_reviewed")).alias("reviewed"))
    # tracks: the last of track and restore
    track = live.where("kind IN ('track', 'restore')").groupBy(*own, "id").agg(F.max(F.struct("at", F.col("other").alias("track"))).alias("w")).select(*own, "id", F.col("w.track").alias("new_track"), F.lit(True).alias("moved"))
    restored = live.where("kind = 'restore'").groupBy(*own, "id").agg(F.max(F.struct("at", "names")).alias("r")).select(*own, "id", F.col("r.at").alias("restored"), F.col("r.names").alias("restored_names"))
    out = cells.join(gone, [*own, "id"], "left").where("dead IS NULL OR NOT dead").drop("dead", "removed").join(track, [*own, "id"], "left").join(restored, [*own, "id"], "left")
    out = out.withColumns({"track_id": F.when(F.col("moved"), F.col("new_track")).otherwise(F.col("track_id")), "labels": F.when(F.col("restored").isNotNull(), F.col("restored_names")).otherwise(F.col("labels"))})
    for column, add, remove in (("labels", "label", "unlabel"), ("track_labels", "track_label", "track_unlabel")):
        steps = live.where(F.col("kind").isin(add, remove)).select(*own, "id", F.explode("names").alias("name"), "at", (F.col("kind") == add).alias("has"))
        if column == "labels":  # what came before a restore is part of the restored cell
            steps = steps.join(restored.select(*own, "id", "restored"), [*own, "id"], "left").where("restored IS NULL OR at > restored").drop("restored")
        state = steps.groupBy(*own, "id", "name").agg(F.max_by("has", "at").alias("has"))
        sets = state.groupBy(*own, "id").agg(F.collect_list(F.when(F.col("has"), F.col("name"))).alias("put"), F.collect_list(F.when(~F.col("has"), F.col("name"))).alias("cut"))
        empty = F.array().cast("array<string>")
        now = F.array_sort(F.array_union(F.array_except(F.coalesce(column, empty), "cut"), "put"))
        out = out.join(sets, [*own, "id"], "left").withColumn(column, F.when(F.col("put").isNotNull(), now).otherwise(F.col(column))).drop("put", "cut")
    return out.select(cells.columns), links_after.select(links.columns)


def recover(edits: DataFrame, chunks: DataFrame, blobs: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Chunks (chunk_key, data) with pending edits rolled back: of each chunk the oldest pending snapshot is the state to return to.

    ``stores`` (store, covered) names the store on disk and the one that the
    inventory covers, a row for each movie: where they differ or one is null, the
    pending edits were journaled against another store and restore nothing.
    """
    key = [*by(edits, chunks, blobs), "seq"]
    undo = blobs.join(pending_against(edits, stores).select(key), key, "left_semi")
    oldest = undo.groupBy(*key[:-1], "chunk_key").agg(F.min_by(F.struct("existed", "before"), "seq").alias("s")).select(*key[:-1], "chunk_key", "s.existed", F.col("s.before").alias("data"))
    return restore_chunks(chunks, oldest)


def pending_against(edits: DataFrame, stores: DataFrame | None) -> DataFrame:
    """Pending edits that may be rolled back: those of a store that is still the one in place."""
    pending = edits.where("pending")
    if stores is None:
        return pending
    own = by(edits, stores)
    good = stores.where("store = covered").select(*own)
    if own:
        return pending.join(good, own, "left_semi")
    return pending.join(F.broadcast(good.limit(1)))  # one row or none


def recover_runs(edits: DataFrame, runs: DataFrame, before: DataFrame, levels: list[tuple[int, tuple[int, int, int]]], stores: DataFrame | None = None) -> DataFrame:
    """Runs of all levels (level, t, z, y, x0, x1, label) after a recovery: level 0 rows that pending edits touched go back to their oldest snapshot, and coarse levels are made anew from them.

    ``before``: seq, t, z, y and the rows' old runs as ``spans`` (x0, x1, label).
    ``levels``: coarse levels with their factors from level 0.
    """
    own = by(edits, runs, before)
    row = [*own, "t", "z", "y"]
    undo = before.join(pending_against(edits, stores).select(*own, "seq"), [*own, "seq"], "left_semi")
    oldest = undo.groupBy(*row).agg(F.min_by("spans", "seq").alias("spans"))
    back = oldest.select(*row, F.explode("spans").alias("s")).select(*row, "s.x0", "s.x1", "s.label")
    base = runs.where("level = 0").select(*row, "x0", "x1", "label").join(oldest.select(row), row, "left_anti").unionByName(back)
    out = base.withColumn("level", F.lit(0))
    for level, factors in levels:
        fz, fy = (max(1, f) for f in factors[:2])
        touched = oldest.where((F.col("z") % fz == 0) & (F.col("y") % fy == 0)).select(*own, "t", F.expr(f"z div {fz}").alias("z"), F.expr(f"y div {fy}").alias("y")).distinct()
        kept = runs.where(F.col("level") == level).select(*row, "x0", "x1", "label").join(touched, row, "left_anti")
        made = regenerate_coarse(base, factors).join(touched, row, "left_semi")
        out = out.unionByName(kept.unionByName(made.select(kept.columns)).withColumn("level", F.lit(level)))
    return out


def restore_chunks(chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Old bytes back; a chunk that did not exist is deleted."""
    key = [*by(chunks, snapshots), "chunk_key"]
    kept = chunks.join(snapshots.select(key), key, "left_anti")
    return kept.unionByName(snapshots.where("existed").select(*key, "data"))


def versions(edits: DataFrame) -> DataFrame:
    """(counter, version): bumps by committed edits; a mask edit that removes or restores cells (``touches_cells``) bumps graph too."""
    own = by(edits)
    bump = F.when(F.col("domain") == "mask", F.when(F.col("touches_cells"), F.array(F.lit("labels"), F.lit("graph"))).otherwise(F.array(F.lit("labels")))).otherwise(F.array(F.col("domain")))
    return edits.where("NOT pending").select(*own, F.explode(bump).alias("counter")).groupBy(*own, "counter").agg(F.count("*").alias("version"))
