"""Windows, lookups, checks and top-k over cells, links, staged files and the edit journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import scalars
from tracklake.operators.graph import carries, with_parent
from tracklake.operators.keys import by
from tracklake.schemas import MAX_LABEL_ID, MAX_U32

Box = tuple[float, float, float, float]


def parse_bbox(text: str) -> Box:
    """``y0,y1,x0,x1``, swapped where reversed."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box is four numbers y0,y1,x0,x1")
    return min(parts[0:2]), max(parts[0:2]), min(parts[2:4]), max(parts[2:4])


def cells_window(cells: DataFrame, links: DataFrame, t0: int, t1: int, box: Box | None = None, z: tuple[float, float] | None = None) -> DataFrame:
    """Cells of frames t0 to t1 with their parent; a box drops cells without a centroid.  The filter reaches the scan before the join."""
    hit = F.col("t").between(t0, t1)
    if box:
        hit = hit & F.col("y").between(box[0], box[1]) & F.col("x").between(box[2], box[3])
    if z:
        hit = hit & F.col("z").between(*z)
    return with_parent(cells.where(hit), links)


def cell_by_id(cells: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    key = [*by(cells, links, ids), "id"]
    return with_parent(cells.join(ids.select(key).distinct(), key, "left_semi"), links)


def in_slab(cells: DataFrame, orientation: str, index: float, radius: float) -> DataFrame:
    """Cells within ``radius`` of the plane: xy looks along z, xz along y, yz along x; no centroid, no hit."""
    normal = {"xy": "z", "xz": "y", "yz": "x"}[orientation]
    return cells.where(F.abs(F.col(normal) - index) <= radius)


def trail_window(cells: DataFrame, t: int, trail: int) -> DataFrame:
    return cells.where(F.col("t").between(t - trail, t))


def carriers(cells: DataFrame, name: str) -> DataFrame:
    return cells.where(carries(name))


def has_graph(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg((F.count("*") > 0).alias("has_graph"))


def export_record(cells: DataFrame) -> DataFrame:
    """Adds the stored seg_id (null where equal to the id) and what a reader resolves it to."""
    return cells.withColumn("stored_seg", F.nullif("seg_id", "id")).withColumn("resolved_seg", F.coalesce("stored_seg", "id"))


def _fault(frame: DataFrame, rule: str, cell: str, message: Column) -> DataFrame:
    return frame.select(*by(frame), F.lit(rule).alias("rule"), F.col(cell).alias("cell_id"), message.alias("message"))


def check_dangling(links: DataFrame, cells: DataFrame, side: str) -> DataFrame:
    """Links declared on ``side`` (children or parent) whose other end has no record."""
    own = by(links, cells)
    end, near = ("child", "parent") if side == "children" else ("parent", "child")
    lost = links.where(F.col("side") == side).select(*own, "parent", "child").distinct().join(cells.select(*own, F.col("id").alias(end)), [*own, end], "left_anti")
    return _fault(lost, f"dangling_{end}", near, F.concat(F.lit("names missing cell "), F.col(end)))


def check_forward(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Links whose child, the offender, is not strictly later; ends without a record are another rule's matter."""
    own = by(links, cells)
    pairs = links.select(*own, "parent", "child").distinct().join(cells.select(*own, F.col("id").alias("parent"), F.col("t").alias("pt")), [*own, "parent"]).join(cells.select(*own, F.col("id").alias("child"), F.col("t").alias("ct")), [*own, "child"])
    return _fault(pairs.where("ct <= pt"), "not_forward", "child", F.concat_ws(" ", F.lit("on frame"), "ct", F.lit("its parent"), "parent", F.lit("on"), "pt"))


def check_sides_agree(links: DataFrame) -> DataFrame:
    """Links declared on both sides with different confidences (null-safe); the child is the offender, once for each link."""
    key = [*by(links), "parent", "child"]
    a = links.where("side = 'children'").select(*key, F.col("confidence").alias("a"))
    b = links.where("side = 'parent'").select(*key, F.col("confidence").alias("b"))
    return _fault(a.join(b, key).where("NOT (a <=> b)").select(*key).distinct(), "sides_disagree", "child", F.concat(F.lit("with parent "), F.col("parent")))


def check_mask_resolution(cells: DataFrame, mask_labels: DataFrame) -> DataFrame:
    """Cells whose label (seg_id, or the id) is not in the mask of their frame."""
    own = by(cells, mask_labels)
    want = cells.select(*own, "id", "t", F.coalesce("seg_id", "id").alias("label"))
    return _fault(want.join(mask_labels, [*own, "t", "label"], "left_anti"), "no_mask", "id", F.concat_ws(" ", F.lit("label"), "label", F.lit("on frame"), "t"))


def check_degree(links: DataFrame) -> DataFrame:
    """Parents with more than two children, children with more than one parent (distinct)."""
    own = by(links)
    many = links.groupBy(*own, "parent").agg(F.countDistinct("child").alias("n")).where("n > 2")
    several = links.groupBy(*own, "child").agg(F.countDistinct("parent").alias("n")).where("n > 1")
    return _fault(many, "many_children", "parent", F.concat(F.col("n"), F.lit(" children"))).unionByName(_fault(several, "many_parents", "child", F.concat(F.col("n"), F.lit(" parents"))))


def check_confidence(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Confidences outside 0 to 1; null and NaN pass."""
    own = by(links, cells)

    def out(c: str) -> Column:
        x = F.nanvl(F.col(c), F.lit(None).cast("double"))
        return (x < 0) | (x > 1)

    bad = links.where(out("confidence")).select(*own, "parent", "child", "confidence").distinct()
    return _fault(bad, "link_confidence", "parent", F.concat(F.lit("link to "), F.col("child"))).unionByName(_fault(cells.where(out("confidence")), "detection_confidence", "id", F.lit("out of range")))


def check_track_ceiling(cells: DataFrame) -> DataFrame:
    return _fault(cells.where(F.col("track_id") > MAX_LABEL_ID), "track_ceiling", "id", F.concat(F.lit("track "), F.col("track_id")))


def cap(offenders: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` offenders of each rule (and movie), in cell and message order; a report, not a filter of data."""
    order = Window.partitionBy(*by(offenders), "rule").orderBy("cell_id", "message")
    return offenders.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)


def validate_staged(cells: DataFrame, links: DataFrame, mask_labels: DataFrame | None = None) -> DataFrame:
    """All rules as one table (rule, cell_id, message)."""
    found = check_dangling(links, cells, "children").unionByName(check_dangling(links, cells, "parent")).unionByName(check_forward(links, cells)).unionByName(check_sides_agree(links))
    found = found.unionByName(check_degree(links)).unionByName(check_confidence(links, cells)).unionByName(check_track_ceiling(cells))
    return found.unionByName(check_mask_resolution(cells, mask_labels)) if mask_labels is not None else found


def staging_duplicates(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, other, n): cell ids and same-side links staged more than once."""
    own = by(cells, links)
    a = cells.groupBy(*own, "id").agg(F.count("*").alias("n")).where("n > 1").select(*own, F.lit("cell").alias("kind"), "id", F.lit(None).cast("long").alias("other"), "n")
    b = links.groupBy(*own, "parent", "child", "side").agg(F.count("*").alias("n")).where("n > 1").select(*own, F.concat(F.lit("link on "), F.col("side")).alias("kind"), F.col("parent").alias("id"), F.col("child").alias("other"), "n")
    return a.unionByName(b)


def collapse_links(links: DataFrame) -> DataFrame:
    return links.select(*by(links), "parent", "child", "confidence").distinct()


def _beside(own: list[str], *summaries: DataFrame) -> DataFrame:
    """One-row summaries side by side; of many movies, one row for each movie that any of them has."""
    out = summaries[0]
    for other in summaries[1:]:
        out = out.join(other, own, "full") if own else out.join(other)
    return out


def graph_summary(cells: DataFrame, links: DataFrame) -> DataFrame:
    """One row (a movie): cells, distinct links, distinct tracks, divisions (exactly two children)."""
    own = by(cells, links)
    pairs = links.select(*own, "parent", "child").distinct()
    divided = pairs.groupBy(*own, "parent").agg(F.count("*").alias("n"))
    c = cells.groupBy(*own).agg(F.count("*").alias("cells"), F.countDistinct("track_id").alias("tracks"))
    lk = divided.groupBy(*own).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum((F.col("n") == 2).cast("long")), F.lit(0)).alias("divisions"))
    return _beside(own, c, lk).fillna(0, ["cells", "tracks", "links", "divisions"])


def label_definitions(stored: DataFrame, cells: DataFrame) -> DataFrame:
    """(name, color, uses): stored names and names on cells; a cell counts once."""
    own = by(stored, cells)
    empty = F.array().cast("array<string>")
    names = cells.select(*own, F.explode(F.array_distinct(F.concat(F.coalesce("labels", empty), F.coalesce("track_labels", empty)))).alias("name"))
    key = [*own, "name"]
    return stored.select(*key, "color").join(names.groupBy(*key).agg(F.count("*").alias("uses")), key, "full").select(*key, "color", F.coalesce("uses", F.lit(0)).alias("uses"))


def merge_definitions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Adds names; a colour applies only where none is stored.  Names that are blank, and colours that are none, are dropped."""
    own = by(stored, new)
    key = [*own, "name"]
    tidy = new.select(*own, scalars.label_name(F.col("name")).alias("name"), scalars.label_color(F.col("color")).alias("new_color")).where("name IS NOT NULL").groupBy(*key).agg(F.min("new_color").alias("new_color"))
    return stored.join(tidy, key, "full").select(*key, F.coalesce("color", "new_color").alias("color"))


def highlight_slots(cells: DataFrame, t: int, names: list[str], slots: int = 8) -> DataFrame:
    """(id, slot): the first listed name that a cell of frame ``t`` carries in either scope; names past ``slots`` are no feature of the display."""
    empty = F.array().cast("array<string>")
    all_names = F.concat(F.coalesce("labels", empty), F.coalesce("track_labels", empty))
    slot = F.coalesce(*[F.when(F.array_contains(all_names, n), F.lit(i)) for i, n in enumerate(names[:slots])], F.lit(None).cast("int"))
    return cells.where(F.col("t") == t).select(*by(cells), "id", slot.alias("slot")).where("slot IS NOT NULL")


def existing(ids: DataFrame, cells: DataFrame) -> DataFrame:
    key = [*by(ids, cells), "id"]
    return ids.join(cells.select(key), key, "left_semi")


def _first(frame: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, of each movie: one top-k, no full sort."""
    own = by(frame)
    if not own:
        return frame.orderBy(*order).limit(limit)
    return frame.withColumn("tl_k", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("tl_k") <= limit).drop("tl_k")


def review_queue(links: DataFrame, limit: int) -> DataFrame:
    """Unreviewed first, then by confidence with nulls last."""
    return _first(links, [F.col("reviewed"), F.col("confidence").asc_nulls_last(), F.col("parent"), F.col("child")], limit)


def edit_history(edits: DataFrame, blobs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, pending ones too: seq, ts (if edits have it), domain, scope, undone, undoable (not a mask edit, or its snapshots are kept)."""
    key = [*by(edits, blobs), "seq"]
    newest = _first(edits, [F.col("seq").desc()], limit)
    kept = blobs.select(*key, F.lit(True).alias("kept")).distinct()
    return newest.join(kept, key, "left").select(*key, *(["ts"] if "ts" in edits.columns else []), "domain", scalars.op_scope(F.col("op")).alias("scope"), "undone", ((F.col("domain") != "mask") | F.coalesce("kept", F.lit(False))).alias("undoable"))


def undo_redo(edits: DataFrame) -> DataFrame:
    """One row (a movie): the edit undo takes next, and the one redo does."""
    done = ~F.col("pending")
    return edits.groupBy(*by(edits)).agg(F.max(F.when(done & ~F.col("undone"), F.col("seq"))).alias("undo_seq"), F.min(F.when(done & F.col("undone"), F.col("seq"))).alias("redo_seq"))


def prune_blobs(edits: DataFrame, blobs: DataFrame, keep: int = 50) -> DataFrame:
    """Snapshots of the newest ``keep`` mask edits."""
    key = [*by(edits, blobs), "seq"]
    newest = _first(edits.where("domain = 'mask'"), [F.col("seq").desc()], keep).select(key)
    return blobs.join(newest if len(key) > 1 else F.broadcast(newest), key, "left_semi")


def pending_edits(edits: DataFrame) -> DataFrame:
    return edits.where("pending").orderBy(*by(edits), "seq")


def choose_level(levels: DataFrame, budget: int, bytes_per_voxel: int = 2) -> DataFrame:
    """(dataset, level): the finest level that fits the budget, else the coarsest; ``levels`` has dataset, level, z, y, x."""
    size = F.col("z") * F.col("y") * F.col("x") * bytes_per_voxel
    return levels.groupBy("dataset").agg(F.coalesce(F.min(F.when(size <= budget, F.col("level"))), F.max("level")).alias("level"))


def _all_ids(cells: DataFrame, mask_labels: DataFrame) -> DataFrame:
    own = by(cells, mask_labels)
    return cells.select(*own, "id").unionByName(mask_labels.select(*own, F.col("label").alias("id")))


def max_label_id(cells: DataFrame, mask_labels: DataFrame) -> DataFrame:
    ids = _all_ids(cells, mask_labels)
    return ids.groupBy(*by(ids)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def ids_in_use(cells: DataFrame, mask_labels: DataFrame, first: int, last: int) -> DataFrame:
    return _all_ids(cells, mask_labels).where(F.col("id").between(first, last)).distinct()


def reserve_ids(cells: DataFrame, mask_labels: DataFrame, stored: int, count: int) -> DataFrame:
    """One row (a movie) of (first, last, ok): a block after every id in use; past the ceiling it is refused; count 0 only peeks."""
    first = F.greatest(F.lit(stored), F.col("max_id") + 1, F.lit(1))
    top = max_label_id(cells, mask_labels)
    return top.select(*by(top), first.alias("first"), (first + max(count, 1) - 1).alias("last")).withColumn("ok", F.col("last") <= MAX_LABEL_ID)


def translate_parents(nodes: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent_id of each node, error rows): source ids of parents become the new ids; ``numbered`` is (src, id)."""
    own = by(nodes, numbered)
    up = numbered.select(*own, F.col("src").alias("parent_src"), F.col("id").alias("parent_id"))
    mine = nodes.join(numbered, [*own, "src"])
    lost = mine.where("parent_src IS NOT NULL").join(up, [*own, "parent_src"], "left_anti").select(*own, "src", "parent_src")
    return mine.join(up, [*own, "parent_src"], "left").select(*own, "id", "parent_id"), lost


def latency_stats(spans: DataFrame, budgets: dict[str, float], last: int = 200) -> DataFrame:
    """Per interaction over its last ``last`` samples (the feature's own window): n, nearest-rank p50 and p95, max, over budget."""
    key = [*by(spans), "interaction"]
    recent = spans.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("at").desc(), F.col("id").desc()))).where(F.col("k") <= last)
    ranked = recent.withColumns({"r": F.row_number().over(Window.partitionBy(*key).orderBy("ms")), "n": F.count("*").over(Window.partitionBy(*key))})
    at = [F.max(F.when(F.col("r") == F.ceil(F.col("n") * q), F.col("ms"))).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))]
    out = ranked.groupBy(*key).agg(F.max("n").alias("n"), *at, F.max("ms").alias("max"))
    limit = F.coalesce(*[F.when(F.col("interaction") == k, F.lit(v)) for k, v in budgets.items()], F.lit(None).cast("double"))
    return out.withColumn("over", F.coalesce(F.col("p95") > limit, F.lit(False)))


def frame_interval(stamps: DataFrame) -> DataFrame:
    """(dataset, seconds): median of the positive steps between neighbours in stored order, 1.0 without any.

    ``stamps``: dataset, k (place in the store), at.  A stamp that is null, or earlier
    than the one before, has no step to either side that counts.
    """
    order = Window.partitionBy("dataset").orderBy("k")
    step = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(order).cast("timestamp"))
    steps = stamps.select("dataset", step.alias("step"))
    return steps.groupBy("dataset").agg(F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))) / 1e6, F.lit(1.0)).alias("seconds"))


def tracking_summary(tracks: DataFrame, splits: DataFrame, merges: DataFrame, approximate: bool = False) -> DataFrame:
    """One row (a movie): distinct tracks, splits, merges."""
    own = by(tracks, splits, merges)
    count = F.approx_count_distinct("track_id") if approximate else F.countDistinct("track_id")
    parts = [tracks.groupBy(*own).agg(count.alias("tracks")), splits.groupBy(*own).agg(F.count("*").alias("splits")), merges.groupBy(*own).agg(F.count("*").alias("merges"))]
    return _beside(own, *parts).fillna(0, ["tracks", "splits", "merges"])


def valid_id(column: Column) -> Column:
    return column.between(0, MAX_U32)
