"""Queries over the derived fixtures, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import scalars as S
from tracklake.functions.settings import Threshold, settings
from tracklake.operators import arrays as A
from tracklake.operators import edits as E
from tracklake.operators import graph as G
from tracklake.operators import labels as L
from tracklake.operators import linking as K
from tracklake.operators import relational as R
from tracklake.plans import fixtures as X
from tracklake.plans.staging import fresh_folder, staged
from tracklake.sources import manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _longs(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in frame.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _longs(f(spark, sf_dir))
        if sql:
            ORACLES[name] = X.oracle(sql)
        return f

    return add


def _joined(column: str):
    return F.array_join(F.array_sort(F.coalesce(F.col(column), F.array().cast("array<string>"))), ",")


# --- projections, filters ------------------------------------------------------

_WINDOW_SQL = """SELECT c.id, c.t, c.z, c.y, c.x, c.state, (SELECT min(parent) FROM links WHERE child = c.id) AS parent_id FROM cells c WHERE c.t BETWEEN 3 AND 20 AND c.y BETWEEN 50 AND 400 AND c.x BETWEEN 20 AND 420"""


def _window(s, d, box):
    return R.cells_window(X.cells(s, d, False), X.links(s, d), 3, 20, box).select("id", "t", "z", "y", "x", "state", "parent_id")


@query("p1_cells_window", _WINDOW_SQL)
def p1(s, d):
    return _window(s, d, (50, 400, 20, 420))


@query("p2_parse_bbox", _WINDOW_SQL)
def p2(s, d):
    return _window(s, d, R.parse_bbox("400,50,420,20"))


@query("p3_cell_by_id", "SELECT c.id, c.t, c.state, (SELECT min(parent) FROM links WHERE child = c.id) AS parent_id FROM cells c WHERE c.id IN (SELECT o_custkey FROM orders)")
def p3(s, d):
    ids = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"))
    return R.cell_by_id(X.cells(s, d, False), X.links(s, d), ids).select("id", "t", "state", "parent_id")


@query("p4_slab", "SELECT id, t, 'xy' AS view FROM cells WHERE abs(z - 4) <= 1 UNION ALL SELECT id, t, 'xz' FROM cells WHERE abs(y - 200) <= 40 UNION ALL SELECT id, t, 'yz' FROM cells WHERE abs(x - 100) <= 25.5")
def p4(s, d):
    c = X.cells(s, d, False)
    out = [R.in_slab(c, v, i, r).select("id", "t", F.lit(v).alias("view")) for v, i, r in (("xy", 4, 1), ("xz", 200, 40), ("yz", 100, 25.5))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("p5_trail_window", "SELECT id, t FROM cells WHERE t BETWEEN 8 AND 15")
def p5(s, d):
    return R.trail_window(X.cells(s, d, False), 15, 7).select("id", "t")


@query("p6_low_confidence", "SELECT parent, child, confidence FROM links WHERE confidence < 0.7")
def p6(s, d):
    return X.links(s, d).where(S.is_low_confidence(F.col("confidence"))).select("parent", "child", "confidence")


@query("p7_carriers", "SELECT id, t FROM cells WHERE list_contains(labels, 'treated') OR list_contains(track_labels, 'treated')")
def p7(s, d):
    return R.carriers(X.cells(s, d, False), "treated").select("id", "t")


@query("p8_has_graph", "SELECT parent % 10 AS dataset, count(*) > 0 AS has_graph FROM links GROUP BY 1")
def p8(s, d):
    return R.has_graph(X.links(s, d).withColumn("dataset", F.col("parent") % 10), "dataset")


@query("p9_effective_track", "SELECT id, coalesce(track_id, id) AS track FROM cells")
def p9(s, d):
    return X.cells(s, d).select("id", S.track_of(F.col("track_id"), F.col("id")).alias("track"))


@query("p10_export_projection", "SELECT id, nullif(seg_id, id) AS stored_seg, coalesce(nullif(seg_id, id), id) AS resolved_seg FROM (SELECT id, CASE WHEN id % 4 = 0 THEN id + 1 ELSE seg_id END AS seg_id FROM cells)")
def p10(s, d):
    c = X.cells(s, d, False).withColumn("seg_id", F.when(F.col("id") % 4 == 0, F.col("id") + 1).otherwise(F.col("seg_id")))
    return R.export_record(c).select("id", "stored_seg", "resolved_seg")


@query("p11_foreground", "SELECT t, z, y, x0, x1, label FROM (SELECT t, z, y, x0, x1, CASE WHEN label % 5 = 0 THEN 0 ELSE label END AS label FROM runs) WHERE label <> 0")
def p11(s, d):
    return L.foreground(X.runs(s, d).withColumn("label", F.when(F.col("label") % 5 == 0, 0).otherwise(F.col("label"))))


# --- joins -----------------------------------------------------------------------


@query("j1_parent_lookup", "SELECT c.id, l.parent AS parent_id FROM base c LEFT JOIN links l ON l.child = c.id")
def j1(s, d):
    return G.with_parent(X.base(s, d), X.links(s, d)).select("id", "parent_id")


@query("j2_dangling_child", "SELECT DISTINCT 'dangling_child' AS rule, parent AS cell_id, 'names missing cell ' || child AS message FROM stg_links WHERE side = 'children' AND child NOT IN (SELECT id FROM stg_cells)")
def j2(s, d):
    return R.check_dangling(X.stg_links(s, d), X.stg_cells(s, d), "children")


@query("j3_dangling_parent", "SELECT DISTINCT 'dangling_parent' AS rule, child AS cell_id, 'names missing cell ' || parent AS message FROM stg_links WHERE side = 'parent' AND parent NOT IN (SELECT id FROM stg_cells)")
def j3(s, d):
    return R.check_dangling(X.stg_links(s, d), X.stg_cells(s, d), "parent")


@query("j4_forward", "SELECT DISTINCT 'not_forward' AS rule, l.child AS cell_id, 'on frame ' || c.t || ' its parent ' || l.parent || ' on ' || p.t AS message FROM stg_links l JOIN stg_cells p ON p.id = l.parent JOIN stg_cells c ON c.id = l.child WHERE c.t <= p.t")
def j4(s, d):
    return R.check_forward(X.stg_links(s, d), X.stg_cells(s, d))


@query("j5_sides_agree", "SELECT DISTINCT 'sides_disagree' AS rule, a.child AS cell_id, 'with parent ' || a.parent AS message FROM stg_links a JOIN stg_links b ON a.parent = b.parent AND a.child = b.child WHERE a.side = 'children' AND b.side = 'parent' AND a.confidence IS DISTINCT FROM b.confidence")
def j5(s, d):
    return R.check_sides_agree(X.stg_links(s, d))


@query("j6_mask_resolution", "SELECT 'no_mask' AS rule, id AS cell_id, 'label ' || coalesce(seg_id, id) || ' on frame ' || t AS message FROM stg_cells c WHERE NOT EXISTS (SELECT 1 FROM mask_labels m WHERE m.t = c.t AND m.label = coalesce(c.seg_id, c.id))")
def j6(s, d):
    return R.check_mask_resolution(X.stg_cells(s, d), X.mask_labels(s, d))


_NUMBERED = "numbered AS (SELECT src, row_number() OVER (ORDER BY t, track, src) AS id FROM nodes)"


@query("j7_translate_parents", f"WITH {_NUMBERED} SELECT n.id, p.id AS parent_id FROM nodes x JOIN numbered n ON n.src = x.src LEFT JOIN numbered p ON p.src = x.parent_src")
def j7(s, d):
    n = staged(X.nodes(s, d), "nodes")
    return R.translate_parents(n, K.assign_ids(n))[0]


@query("j8_relabel", f"WITH {_NUMBERED} SELECT r.t, r.z, r.y, r.x0, r.x1, m.id AS label FROM runs r JOIN chains c ON c.id = r.label JOIN nodes n ON n.t = r.t AND n.track = c.head JOIN numbered m ON m.src = n.src")
def j8(s, d):
    n = staged(X.nodes(s, d), "nodes")
    tracked = X.runs(s, d).join(n.select(F.expr("src div 10").alias("label"), F.col("track").alias("to")), "label").drop("label").withColumnRenamed("to", "label")
    return L.relabel(tracked, n.join(K.assign_ids(n), "src").select("t", "track", "id")).select("t", "z", "y", "x0", "x1", "label")


@query("j9_relabel_by_track", "SELECT r.t, r.z, r.y, r.x0, r.x1, c.track_id + 1 AS label FROM runs r JOIN cells c ON c.id = r.label WHERE c.track_id IS NOT NULL")
def j9(s, d):
    tracks = X.cells(s, d).where("track_id IS NOT NULL").select("t", F.col("id").alias("label"), "track_id")
    return L.relabel_by_track(X.runs(s, d), tracks).select("t", "z", "y", "x0", "x1", "label")


@query("j10_display_remap", "SELECT r.t, r.z, r.y, r.x0, r.x1, CASE WHEN list_contains(c.labels, 'control') AND c.t = 4 THEN 16777216 WHEN c.t = 4 AND list_contains(c.track_labels, 'cell type 1') THEN 16777216 + 1024 ELSE coalesce(c.track_id, c.id) END AS value FROM runs r JOIN cells c ON c.id = r.label")
def j10(s, d):
    c = X.cells(s, d)
    slots = R.highlight_slots(c, 4, ["control", "cell type 1"])
    return L.remap_to_tracks(X.runs(s, d), c, slots).select("t", "z", "y", "x0", "x1", "value")


_OVERLAP = """ov AS (SELECT a.t AS t1, b.t AS t2, a.label AS label1, b.label AS label2, count(*) AS overlap FROM voxels a JOIN voxels b ON b.t - a.t BETWEEN 1 AND 2 AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY ALL),
ar AS (SELECT label, count(*) AS area FROM voxels GROUP BY label),
ovc AS (SELECT ov.*, overlap / (p.area + q.area - overlap) AS iou, overlap / p.area AS ratio_1, overlap / q.area AS ratio_2, 1.0 + (-1.0) * (overlap / q.area) AS cost FROM ov JOIN ar p ON p.label = label1 JOIN ar q ON q.label = label2)"""


@query("j11_overlap_costs", f"WITH {_OVERLAP} SELECT t1, t2, label1, label2, overlap, iou, ratio_1, ratio_2, cost FROM ovc WHERE cost <= 0.9")
def j11(s, d):
    return K.overlap_costs(_runs(s, d), max_gap=2).select("t1", "t2", "label1", "label2", "overlap", "iou", "ratio_1", "ratio_2", "cost")


_NEAR = """near AS (SELECT a.t AS t1, b.t AS t2, a.id AS id1, b.id AS id2, (a.z-b.z)*(a.z-b.z) + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) AS d2 FROM cells a JOIN cells b ON b.t = a.t + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY d2, id1) AS k FROM near WHERE d2 <= 225) WHERE k <= 5)"""


@query("j12_distance_candidates", f"WITH {_NEAR} SELECT t1, t2, id1, id2, d2 FROM cand")
def j12(s, d):
    return K.distance_candidates(X.cells(s, d, False), 15.0, 5)


@query("j13_mutual_best", f"""WITH {_NEAR}, rk AS (SELECT id1 AS parent, id2 AS child, d2 AS cost, row_number() OVER (PARTITION BY id1 ORDER BY d2, id2) AS p, row_number() OVER (PARTITION BY id2 ORDER BY d2, id1) AS c FROM cand WHERE d2 <= 225),
main AS (SELECT parent, child, cost FROM rk WHERE p = 1 AND c = 1 AND cost <= 150),
rest AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY cost, child) AS s FROM rk WHERE c = 1 AND parent IN (SELECT parent FROM main) AND child NOT IN (SELECT child FROM main))
SELECT parent, child, cost, 'link' AS kind FROM main UNION ALL SELECT parent, child, cost, 'split' FROM rest WHERE s = 1""")
def j13(s, d):
    near = K.distance_candidates(X.cells(s, d, False), 15.0, 5).select(F.col("id1").alias("parent"), F.col("id2").alias("child"), F.col("d2").alias("cost"))
    return K.link_mutual_best(near, 150.0, 225.0)


@query("j14_highlight", "SELECT id, CASE WHEN list_contains(labels, 'treated') OR list_contains(track_labels, 'treated') THEN 1 WHEN list_contains(labels, 'cell type 1') OR list_contains(track_labels, 'cell type 1') THEN 2 END AS slot FROM cells WHERE t = 5 AND (list_contains(labels, 'treated') OR list_contains(track_labels, 'cell type 1'))")
def j14(s, d):
    return R.highlight_slots(X.cells(s, d, False), 5, ["missing", "treated", "cell type 1"])


@query("j15_existing", "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM cells)")
def j15(s, d):
    ids = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    return R.existing(ids, X.base(s, d))


@query("j16_relabel_mismatch", """WITH a AS (SELECT DISTINCT t, label AS value FROM voxels WHERE label % 50 <> 0), b AS (SELECT DISTINCT t, id AS value FROM base WHERE id % 70 <> 0)
SELECT coalesce(a.t, b.t) AS t, coalesce(a.value, b.value) AS value, CASE WHEN b.value IS NULL THEN 'no_node' ELSE 'no_voxels' END AS problem FROM a FULL JOIN b ON a.t = b.t AND a.value = b.value WHERE a.value IS NULL OR b.value IS NULL ORDER BY 1, 2 LIMIT 20""")
def j16(s, d):
    return L.relabel_mismatches(X.runs(s, d).where("label % 50 <> 0"), X.base(s, d).where("id % 70 <> 0").select("t", F.col("id").alias("track")))


# --- aggregations --------------------------------------------------------------

_INV = "SELECT t, label, area, CAST(sum_z AS BIGINT) AS sum_z, CAST(sum_y AS BIGINT) AS sum_y, CAST(sum_x AS BIGINT) AS sum_x, z0, z1, y0, y1, x0, x1 FROM inventory"


@query("a1_label_inventory", _INV)
def a1(s, d):
    return L.label_inventory(X.runs(s, d))


@query("a2_scan_label", "WITH w AS (SELECT 3 AS t, (SELECT min(id) FROM base WHERE t = 3) AS label UNION ALL SELECT 3, 0) SELECT w.t, coalesce(w.label, 0) AS label, coalesce(i.area, 0) AS area, CAST(coalesce(i.sum_z, 0) AS BIGINT) AS sum_z, CAST(coalesce(i.sum_y, 0) AS BIGINT) AS sum_y, CAST(coalesce(i.sum_x, 0) AS BIGINT) AS sum_x, z0, z1, y0, y1, x0, x1 FROM w LEFT JOIN inventory i ON i.t = w.t AND i.label = w.label")
def a2(s, d):
    label = X.base(s, d).where("t = 3").agg(F.min("id")).first()[0] or 0
    r = X.runs(s, d)
    return L.scan_label(r, 3, label).unionByName(L.scan_label(r, 3, 0))


@query("a3_inventory_flags", "WITH i AS (SELECT t, label FROM inventory UNION ALL SELECT t + 1, label FROM inventory WHERE label % 40 = 0) SELECT DISTINCT label, 'too_large' AS flag FROM i WHERE label > 3000 UNION ALL SELECT label, 'many_frames' FROM i GROUP BY label HAVING count(DISTINCT t) > 1")
def a3(s, d):
    i = L.label_inventory(X.runs(s, d)).select("t", "label")
    return L.inventory_flags(i.unionByName(i.where("label % 40 = 0").withColumn("t", F.col("t") + 1)), 3000)


@query("a4_publish_inventory", """WITH iv AS (SELECT t, label, area, sum_x FROM inventory UNION ALL SELECT t + 1, label, area, sum_x FROM inventory WHERE label % 40 = 0) SELECT 'cell' AS kind, id, t, x, area FROM cells WHERE id % 3 <> 0 UNION ALL SELECT 'cell', label, t, sum_x / area, area FROM inventory WHERE label % 3 = 0 UNION ALL SELECT 'label', label, t, NULL, NULL FROM iv
UNION ALL SELECT 'extent', label, t, CAST(sum_x AS DOUBLE), area FROM iv UNION ALL SELECT 'next', greatest(max(label) + 1, 5000), NULL, NULL, NULL FROM inventory UNION ALL SELECT 'edit', seq, NULL, NULL, NULL FROM edits WHERE domain <> 'mask'""")
def a4(s, d):
    """Published as one table set and read back; the set of the scan before is gone, and a second publication of it does nothing.  Every fortieth label is on two frames."""
    folder = fresh_folder(s, "inventory")
    cells = staged(X.cells(s, d, False).where("id % 3 <> 0").select("id", "t", "z", "y", "x", "area"), "cells")
    old = {"mask_labels": s.createDataFrame([(0, 7)], "t long, label long"), "mask_extent": s.createDataFrame([(0, 7)], "t long, label long")}
    manifest.publish(s, folder, old, "scan", 0, store="old store")
    inv = L.label_inventory(X.runs(s, d)).withColumn("t", F.expr("explode(if(label % 40 = 0, array(t, t + 1), array(t)))"))
    tables = L.publish_inventory(inv, cells, X.edits(s, d), X.blobs(s, d), 5000)
    assert manifest.publish(s, folder, tables, "scan", 1, store="new store") and not manifest.publish(s, folder, old, "scan", 1)

    def rows(kind, name, *columns):
        return manifest.table(s, folder, name).select(F.lit(kind).alias("kind"), *[F.col(c).alias(n) if c else F.lit(None).cast(k).alias(n) for c, (n, k) in zip(columns, (("id", "long"), ("t", "long"), ("x", "double"), ("area", "long")), strict=True)])

    out = rows("cell", "cells", "id", "t", "x", "area").union(rows("label", "mask_labels", "label", "t", None, None)).union(rows("extent", "mask_extent", "label", "t", "sum_x", "area"))
    out = out.union(rows("next", "next_id", "next_id", None, None, None)).union(rows("edit", "edits", "seq", None, None, None))
    return out.withColumn("x", F.col("x").cast("double"))


@query("a5_region_centroids", "SELECT t, label, sum_z / area AS z, sum_y / area AS y, sum_x / area AS x FROM inventory")
def a5(s, d):
    return L.region_props(X.runs(s, d))


@query("a6_graph_summary", "SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(DISTINCT track_id) FROM cells) AS tracks, (SELECT count(*) FROM (SELECT DISTINCT parent, child FROM links)) AS links, (SELECT count(*) FROM kids WHERE n = 2) AS divisions")
def a6(s, d):
    return R.graph_summary(X.cells(s, d), X.links(s, d))


@query("a7_degree", "WITH l AS (SELECT parent, child FROM links UNION ALL SELECT parent, child + 50000000 FROM links WHERE parent % 9 = 0 UNION ALL SELECT parent + 1, child FROM links WHERE child % 31 = 0) SELECT 'many_children' AS rule, parent AS cell_id, count(DISTINCT child) || ' children' AS message FROM l GROUP BY parent HAVING count(DISTINCT child) > 2 UNION ALL SELECT 'many_parents', child, count(DISTINCT parent) || ' parents' FROM l GROUP BY child HAVING count(DISTINCT parent) > 1")
def a7(s, d):
    lk = X.links(s, d).select("parent", "child")
    more = lk.where("parent % 9 = 0").select("parent", (F.col("child") + 50000000).alias("child"))
    return R.check_degree(lk.unionByName(more).unionByName(lk.where("child % 31 = 0").select((F.col("parent") + 1).alias("parent"), "child")))


@query("a8_confidence", "SELECT DISTINCT 'link_confidence' AS rule, parent AS cell_id, 'link to ' || child AS message FROM stg_links WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT 'detection_confidence', id, 'out of range' FROM stg_cells WHERE confidence < 0 OR confidence > 1")
def a8(s, d):
    return R.check_confidence(X.stg_links(s, d), X.stg_cells(s, d))


@query("a9_track_ceiling", "SELECT 'track_ceiling' AS rule, id AS cell_id, 'track ' || track_id AS message FROM stg_cells WHERE track_id > 16777215")
def a9(s, d):
    return R.check_track_ceiling(X.stg_cells(s, d))


@query("a10_collapse_links", "SELECT DISTINCT parent, child, confidence FROM stg_links")
def a10(s, d):
    return R.collapse_links(X.stg_links(s, d))


@query("a11_label_vocabulary", """WITH st AS (SELECT 'treated' AS name, '#ff0000' AS color UNION ALL SELECT 'unused', '#00ff00'), n AS (SELECT id, unnest(list_distinct(list_concat(coalesce(labels, []), coalesce(track_labels, [])))) AS name FROM cells), u AS (SELECT name, count(*) AS uses FROM n GROUP BY name)
SELECT coalesce(st.name, u.name) AS name, st.color, coalesce(u.uses, 0) AS uses FROM st FULL JOIN u ON u.name = st.name""")
def a11(s, d):
    return R.label_definitions(s.createDataFrame([("treated", "#ff0000"), ("unused", "#00ff00")], "name string, color string"), X.cells(s, d, False))


@query("a12_label_states", """WITH m AS (SELECT c.id, coalesce(c.labels, []) AS labels, CASE WHEN c.id % 5 = 0 THEN [] ELSE coalesce(c.track_labels, []) END AS own, h.head FROM cells c JOIN chains h ON h.id = c.id), f AS (SELECT * FROM m WHERE id % 10 = 0),
x AS (SELECT head, unnest(list_distinct(list_concat(labels, own))) AS name, own FROM m), cv AS (SELECT head, name, sum(CASE WHEN list_contains(own, name) THEN 1 ELSE 0 END) AS covered FROM x GROUP BY ALL), sz AS (SELECT head, count(*) AS n FROM m GROUP BY head)
SELECT f.id, cv.name, list_contains(f.labels, cv.name) AS on_cell, CASE WHEN covered = sz.n THEN 'all' WHEN covered > 0 THEN 'some' ELSE 'none' END AS on_track FROM f JOIN cv USING (head) JOIN sz USING (head)""")
def a12(s, d):
    c = X.cells(s, d, False).withColumn("track_labels", F.when(F.col("id") % 5 != 0, F.col("track_labels")))
    return G.label_states(c, G.chains(X.base(s, d), X.links(s, d)), c.where("id % 10 = 0"))


@query("a12_label_states_of_vocabulary", """WITH m AS (SELECT c.id, CASE WHEN c.id % 3 = 0 THEN [] ELSE coalesce(c.labels, []) END AS labels, CASE WHEN c.id % 5 <> 0 OR c.user_id % 2 = 0 THEN [] ELSE coalesce(c.track_labels, []) END AS own, h.head FROM cells c JOIN chains h ON h.id = c.id), v AS (SELECT unnest(labels) AS name FROM m UNION SELECT unnest(own) FROM m UNION SELECT unnest(['never', 'seen'])),
x AS (SELECT head, unnest(list_distinct(list_concat(labels, own))) AS name, own FROM m), cv AS (SELECT head, name, sum(CASE WHEN list_contains(own, name) THEN 1 ELSE 0 END) AS covered FROM x GROUP BY ALL), sz AS (SELECT head, count(*) AS n FROM m GROUP BY head)
SELECT f.id, v.name, list_contains(f.labels, v.name) AS on_cell, CASE WHEN covered = sz.n THEN 'all' WHEN covered > 0 THEN 'some' ELSE 'none' END AS on_track FROM m f CROSS JOIN v LEFT JOIN cv ON cv.head = f.head AND cv.name = v.name JOIN sz ON sz.head = f.head""")
def a12b(s, d):
    """Every cell against the whole vocabulary, in which two names are defined that may be on no cell."""
    own = F.when((F.col("id") % 5 == 0) & (F.col("user_id") % 2 != 0), F.col("track_labels"))
    c = X.cells(s, d, False).withColumns({"labels": F.when(F.col("id") % 3 != 0, F.col("labels")), "track_labels": own})
    names = R.label_definitions(s.createDataFrame([("never", None), ("seen", None)], "name string, color string"), c)
    return G.label_states(c, G.chains(X.base(s, d), X.links(s, d)), c, names)


@query("a13_histogram", "WITH h AS (SELECT t, c, CAST(value * 256 // 65536 AS BIGINT) AS bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM image GROUP BY ALL) SELECT t, c, bin, n, CAST(min(lo) OVER w AS BIGINT) AS least, CAST(max(hi) OVER w AS BIGINT) AS most, CAST(sum(n) OVER w AS BIGINT) AS samples FROM h WINDOW w AS (PARTITION BY t, c)")
def a13(s, d):
    return A.histogram(X.image(s, d))


@query("a13_histogram_strided", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY t, c, z // 2, y // 8, x // 8 ORDER BY z, y, x) - 1 AS k, count(*) OVER (PARTITION BY t, c) AS al FROM image), h AS (SELECT t, c, CAST(value * 256 // 65536 AS BIGINT) AS bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM o WHERE k % CAST(ceil(al / 300) AS BIGINT) = 0 GROUP BY ALL)
SELECT t, c, bin, n, CAST(min(lo) OVER w AS BIGINT) AS least, CAST(max(hi) OVER w AS BIGINT) AS most, CAST(sum(n) OVER w AS BIGINT) AS samples FROM h WINDOW w AS (PARTITION BY t, c)""")
def a13s(s, d):
    return A.histogram(X.image(s, d), brick=(2, 8, 8), max_samples=300)


@query("a13_histogram_budgeted", """WITH b AS (SELECT *, (z // 2) * 9 + (y // 8) * 3 + x // 8 AS brick, ((z % 2) * least(8, 17 - (y // 8) * 8) + y % 8) * least(8, 17 - (x // 8) * 8) + x % 8 AS place FROM image), h AS (SELECT t, c, value * 256 // 65536 AS bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM b WHERE brick % 4 = 0 AND place % 4 = 0 GROUP BY ALL)
SELECT t, c, CAST(bin AS BIGINT) AS bin, n, min(lo) OVER w AS least, max(hi) OVER w AS most, CAST(sum(n) OVER w AS BIGINT) AS samples FROM h WINDOW w AS (PARTITION BY t, c)""")
def a13b(s, d):
    """18 bricks of 256 bytes within a budget of 1,500: every fourth; their 640 voxels within one of 200 samples: every fourth."""
    level = {"level": 0, "z": 4, "y": 17, "x": 17, "cz": 2, "cy": 8, "cx": 8, "item_bytes": 2}
    plan = A.histogram_plan(s.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in level.items()]), 1500, 200)
    return A.sampled_histogram(A.to_chunks(X.image(s, d), (2, 8, 8), (4, 17, 17)), plan)


@query("a14_histogram_sampled", "SELECT t, c, count(*) AS samples, count(*) < 9000 AS sampled FROM image GROUP BY t, c")
def a14(s, d):
    return A.histogram_meta(A.histogram(X.image(s, d)), 0, 9000)


_SPANS = """cp AS (SELECT c.*, coalesce(c.track_id, c.id) AS track, l.parent AS parent_id FROM cells c LEFT JOIN links l ON l.child = c.id),
spans AS (SELECT a.track, min(a.t) AS first, max(a.t) AS last, arg_min(CASE WHEN p.track <> a.track THEN p.track END, CASE WHEN p.track <> a.track THEN a.t * 100000000 + a.id END) AS parent FROM cp a LEFT JOIN cp p ON p.id = a.parent_id GROUP BY a.track)"""


@query("a15_track_spans", f"WITH {_SPANS} SELECT track, first, last, parent FROM spans")
def a15(s, d):
    return G.track_spans(G.with_parent(X.cells(s, d), X.links(s, d)))


@query("a16_object_counts", "SELECT t, count(DISTINCT label) AS objects FROM voxels GROUP BY t")
def a16(s, d):
    return L.object_counts(X.runs(s, d))


@query("a17_drop_small", "SELECT t, z, y, x0, x1, label FROM runs r WHERE (SELECT area FROM inventory i WHERE i.t = r.t AND i.label = r.label) >= 31")
def a17(s, d):
    return L.drop_small(X.runs(s, d), 31).select("t", "z", "y", "x0", "x1", "label")


@query("a18_frame_interval", "WITH g AS (SELECT user_id AS dataset, date_diff('microseconds', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS step FROM events) SELECT dataset, coalesce(median(step) FILTER (step > 0) / 1000000.0, 1.0) AS seconds FROM g GROUP BY dataset")
def a18(s, d):
    return R.frame_interval(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("dataset"), F.col("event_id").alias("k"), F.col("ts").alias("at")))


@query("a19_percentile_normalize", "WITH p AS (SELECT t, c, quantile_cont(CAST(value AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(value AS DOUBLE), 0.998) AS hi FROM image GROUP BY t, c) SELECT i.t, i.c, i.z, i.y, i.x, CAST(round(1000 * (value - lo) / (hi - lo)) AS BIGINT) AS norm FROM image i JOIN p ON p.t = i.t AND p.c = i.c")
def a19(s, d):
    return A.percentile_normalize(X.image(s, d)).select("t", "c", "z", "y", "x", F.round(1000 * F.col("norm")).cast("long").alias("norm"))


@query("a20_projection", "SELECT t, c, y, x, CAST(max(value) AS BIGINT) AS value, 'max' AS mode FROM image GROUP BY t, c, y, x UNION ALL SELECT t, c, y, x, CAST(min(value) AS BIGINT), 'min' FROM image GROUP BY t, c, y, x UNION ALL SELECT t, c, y, x, CAST(sum(value) AS BIGINT), 'sum' FROM image GROUP BY t, c, y, x")
def a20(s, d):
    v = X.image(s, d)
    parts = [A.z_project(v, m).withColumn("mode", F.lit(m)) for m in ("max", "min", "sum")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a21_downsample", "SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(value), 0) AS BIGINT) AS value FROM image WHERE y < 16 AND x < 16 GROUP BY t, c, z, y // 2, x // 2")
def a21(s, d):
    return A.downsample_yx(X.image(s, d), 17, 17)


_DELTAS = "dl AS (SELECT id // 40 AS seq, id, user_id AS old, CASE WHEN id % 3 = 0 THEN NULL ELSE user_id + 1 END AS new FROM base)"


@query("a22_delta_affected", f"WITH {_DELTAS}, v AS (SELECT seq, old AS track FROM dl UNION SELECT seq, new FROM dl WHERE new IS NOT NULL) SELECT a.seq, a.tracks, b.cells FROM (SELECT seq, string_agg(CAST(track AS VARCHAR), ',' ORDER BY track) AS tracks FROM v GROUP BY seq) a JOIN (SELECT seq, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS cells FROM dl GROUP BY seq) b ON a.seq = b.seq")
def a22(s, d):
    deltas = X.base(s, d).select(F.expr("id div 40").alias("seq"), "id", F.col("user_id").alias("old"), F.when(F.col("id") % 3 != 0, F.col("user_id") + 1).alias("new"))
    return E.delta_affected(deltas).select("seq", F.array_join("tracks", ",").alias("tracks"), F.array_join("cells", ",").alias("cells"))


@query("a23_latency", """WITH k AS (SELECT event_type AS interaction, abs(value) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY interaction ORDER BY ms) AS r, count(*) OVER (PARTITION BY interaction) AS n FROM k WHERE k <= 200),
a AS (SELECT interaction, max(n) AS n, max(CASE WHEN r = ceil(n * 0.5) THEN ms END) AS p50, max(CASE WHEN r = ceil(n * 0.95) THEN ms END) AS p95, max(ms) AS max FROM r GROUP BY interaction)
SELECT *, coalesce(p95 > CASE interaction WHEN 'view' THEN 20 WHEN 'click' THEN 1000 END, false) AS over FROM a""")
def a23(s, d):
    spans = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("interaction"), F.abs("value").alias("ms"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return R.latency_stats(spans, {"view": 20.0, "click": 1000.0})


@query("a24_z_size", "WITH v AS (SELECT t, c, z, CASE WHEN z = 3 AND t % 2 = 0 THEN 0 ELSE value END AS v FROM image) SELECT t, c, CASE WHEN max(CASE WHEN v <> 0 THEN z ELSE -1 END) >= 3 THEN 4 ELSE 3 END AS z_size, 3 AS declared FROM v GROUP BY t, c UNION ALL SELECT DISTINCT t, c, 4, d.d FROM v, (SELECT unnest([0, 4, 9]) AS d) d")
def a24(s, d):
    v = X.image(s, d).withColumn("value", F.when((F.col("z") == 3) & (F.col("t") % 2 == 0), 0).otherwise(F.col("value")))
    parts = [A.choose_z_size(v, n, 4).withColumn("declared", F.lit(n)) for n in (3, 0, 4, 9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a25_tracking_summary", "SELECT (SELECT count(DISTINCT track_id) FROM cells) AS tracks, (SELECT count(*) FROM links l JOIN kids k ON k.parent = l.parent WHERE k.n = 2) AS splits, 0 AS merges")
def a25(s, d):
    lk = X.links(s, d)
    splits = lk.join(lk.groupBy("parent").count().where("count = 2"), "parent", "left_semi")
    return R.tracking_summary(X.cells(s, d), splits, lk.where("false"))


# --- windows -------------------------------------------------------------------


@query("w1_sequential_ids", f"WITH {_NUMBERED} SELECT src, id FROM numbered")
def w1(s, d):
    return K.assign_ids(X.nodes(s, d))


_SHOWN = """shown(track) AS (SELECT track FROM spans WHERE first <= 12 AND last >= 12 UNION SELECT s.parent FROM shown JOIN spans s ON s.track = shown.track WHERE s.parent IN (SELECT track FROM spans))"""


@query("w2_trail_segments", f"""WITH {_SPANS}, {_SHOWN}, past AS (SELECT id, t, parent_id, track FROM cp WHERE t <= 12 AND z IS NOT NULL), st AS (SELECT *, lag(id) OVER w AS from_id, row_number() OVER w AS k FROM past WHERE track IN (SELECT track FROM shown) WINDOW w AS (PARTITION BY track ORDER BY t, id))
SELECT track, from_id, id AS to_id, t FROM st WHERE k > 1 AND t >= 6 UNION ALL SELECT st.track, st.parent_id, st.id, st.t FROM st JOIN past p ON p.id = st.parent_id WHERE k = 1 AND p.track <> st.track AND st.t >= 6""")
def w2(s, d):
    c = staged(G.with_parent(X.cells(s, d), X.links(s, d)), "cells")
    return G.trail_segments(c, G.shown_tracks(G.track_spans(c), 12), 12, 6)


@query("w3_track_heads", "SELECT track, src, t FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, src) AS k FROM nodes) WHERE k = 1")
def w3(s, d):
    return G.track_heads(X.nodes(s, d)).select("track", "src", "t")




@query("w4_parent_tracks", """WITH hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, src) AS k FROM nodes) WHERE k = 1), act AS (SELECT hd.track, coalesce(p.track, -1) AS actual FROM hd LEFT JOIN nodes p ON p.src = hd.parent_src),
od AS (SELECT n.track, CASE WHEN n.src % 370 = 3 THEN 7 ELSE a.actual END AS declared FROM nodes n JOIN act a ON a.track = n.track)
SELECT od.track, string_agg(DISTINCT CAST(declared AS VARCHAR), ',' ORDER BY CAST(declared AS VARCHAR)) AS declared, any_value(actual) AS actual FROM od JOIN act ON act.track = od.track GROUP BY od.track HAVING count(DISTINCT declared) > 1 OR min(declared) <> any_value(actual)""")
def w4(s, d):
    n = staged(X.nodes(s, d), "nodes")
    up = G.track_heads(n).select("track", F.col("parent_src").alias("p")).join(n.select(F.col("src").alias("p"), F.col("track").alias("up")), "p", "left").select("track", "up")
    odd = n.drop("parent_track").join(up, "track").withColumn("parent_track", F.when(F.col("src") % 370 == 3, 7).otherwise(F.col("up"))).drop("up")
    return G.check_parent_tracks(odd).select("track", F.array_join(F.array_sort(F.transform("declared", lambda x: x.cast("string"))), ",").alias("declared"), "actual")


@query("w5_fresh_ids", "SELECT head, 9999 + row_number() OVER (ORDER BY head) AS track_id FROM (SELECT DISTINCT head FROM chains)")
def w5(s, d):
    return G.fresh_track_ids(G.chains(X.base(s, d), X.links(s, d)), 10000)


@query("w6_merge_runs", "WITH v AS (SELECT DISTINCT t, z, y, x FROM voxels), i AS (SELECT *, x - row_number() OVER (PARTITION BY t, z, y ORDER BY x) AS g FROM v) SELECT t, z, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY t, z, y, g")
def w6(s, d):
    r = X.runs(s, d).select("t", "z", "y", "x0", "x1")
    return L.merge_runs(r.unionByName(r.where("x0 % 2 = 0")), ("t", "z", "y"))


@query("w7_runs", "SELECT t, z, y, x0, x1, label FROM runs")
def w7(s, d):
    return L.to_runs(X.voxels(s, d))


@query("w7_explode_runs", "SELECT t, z, y, x, label FROM voxels")
def w7b(s, d):
    return L.explode_runs(X.runs(s, d)).select("t", "z", "y", "x", "label")


@query("w8_trail_alpha", "SELECT id, CASE WHEN 20 - t <= 0 THEN 0.9 WHEN 20 - t >= 8 THEN 0.1 ELSE 0.9 - (0.9 - 0.1) * (20 - t) / 8 END AS alpha FROM base WHERE t BETWEEN 12 AND 20")
def w8(s, d):
    return R.trail_window(X.base(s, d), 20, 8).select("id", S.trail_alpha(F.col("t"), 20, 8, 0.9, 0.1).alias("alpha"))


# --- sorts, limits, sets -------------------------------------------------------------


@query("k1_review_queue", "SELECT parent, child, confidence, reviewed FROM links ORDER BY reviewed, confidence ASC NULLS LAST, parent, child LIMIT 50")
def k1(s, d):
    return R.review_queue(X.links(s, d), 50)


@query("k2_edit_history", "SELECT e.seq, e.ts, e.domain, coalesce(json_extract_string(op, '$.scope'), json_extract_string(op, '$.kind')) AS scope, e.undone, e.domain <> 'mask' OR e.seq IN (SELECT seq FROM blobs) AS undoable FROM (SELECT * FROM edits ORDER BY seq DESC LIMIT 100) e")
def k2(s, d):
    return R.edit_history(X.edits(s, d), X.blobs(s, d))


@query("k3_undo_redo", "SELECT max(seq) FILTER (NOT pending AND NOT undone) AS undo_seq, min(seq) FILTER (NOT pending AND undone) AS redo_seq FROM edits")
def k3(s, d):
    return R.undo_redo(X.edits(s, d))


_ALL_RULES = """f AS (SELECT DISTINCT 'dangling_child' AS rule, parent AS cell_id, 'names missing cell ' || child AS message FROM stg_links WHERE side = 'children' AND child NOT IN (SELECT id FROM stg_cells)
UNION ALL SELECT DISTINCT 'dangling_parent', child, 'names missing cell ' || parent FROM stg_links WHERE side = 'parent' AND parent NOT IN (SELECT id FROM stg_cells)
UNION ALL SELECT DISTINCT 'not_forward', l.child, 'on frame ' || c.t || ' its parent ' || l.parent || ' on ' || p.t FROM stg_links l JOIN stg_cells p ON p.id = l.parent JOIN stg_cells c ON c.id = l.child WHERE c.t <= p.t
UNION ALL SELECT DISTINCT 'sides_disagree', a.child, 'with parent ' || a.parent FROM stg_links a JOIN stg_links b ON a.parent = b.parent AND a.child = b.child WHERE a.side = 'children' AND b.side = 'parent' AND a.confidence IS DISTINCT FROM b.confidence
UNION ALL SELECT 'many_children', parent, count(DISTINCT child) || ' children' FROM stg_links GROUP BY parent HAVING count(DISTINCT child) > 2
UNION ALL SELECT 'many_parents', child, count(DISTINCT parent) || ' parents' FROM stg_links GROUP BY child HAVING count(DISTINCT parent) > 1
UNION ALL SELECT 'link_confidence', parent, 'link to ' || child FROM (SELECT DISTINCT parent, child, confidence FROM stg_links) WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'detection_confidence', id, 'out of range' FROM stg_cells WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'track_ceiling', id, 'track ' || track_id FROM stg_cells WHERE track_id > 16777215
UNION ALL SELECT 'no_mask', id, 'label ' || coalesce(seg_id, id) || ' on frame ' || t FROM stg_cells c WHERE NOT EXISTS (SELECT 1 FROM mask_labels m WHERE m.t = c.t AND m.label = coalesce(c.seg_id, c.id)))"""


@query("k4_offender_cap", f"WITH {_ALL_RULES} SELECT rule, cell_id, message, k FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY cell_id, message) AS k FROM f) WHERE k <= 2")
def k4(s, d):
    return R.cap(R.validate_staged(X.stg_cells(s, d), X.stg_links(s, d), X.mask_labels(s, d)), 2)


@query("k5_prune_blobs", "SELECT seq, chunk_key, existed, before FROM blobs WHERE seq IN (SELECT seq FROM edits WHERE domain = 'mask' ORDER BY seq DESC LIMIT 50)")
def k5(s, d):
    return R.prune_blobs(X.edits(s, d), X.blobs(s, d))


def _levels(s, d):
    """A pyramid of each customer's image, sizes by key."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("dataset"))
    lv = c.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    side = {a: F.expr(f"(512 + dataset % {m} * 64) div cast(pow(2, level) as bigint)") for a, m in (("y", 7), ("x", 11))}
    return lv.withColumns({"z": 4 + F.col("dataset") % 64, **side, "item_bytes": F.lit(2).cast("long"), "cz": F.when(F.col("dataset") % 3 == 0, 1).otherwise(16).cast("long"), "cy": F.lit(256).cast("long"), "cx": (64 + F.col("dataset") % 5 * 64)})


_LEVELS = "lv AS (SELECT c_custkey AS dataset, level, 4 + c_custkey % 64 AS z, (512 + c_custkey % 7 * 64) // CAST(pow(2, level) AS BIGINT) AS y, (512 + c_custkey % 11 * 64) // CAST(pow(2, level) AS BIGINT) AS x, 2 AS item_bytes, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 16 END AS cz, 256 AS cy, 64 + c_custkey % 5 * 64 AS cx FROM customer, (SELECT unnest(range(0, 4)) AS level))"


@query("k6_level_choice", f"WITH {_LEVELS} SELECT dataset, coalesce(min(level) FILTER (z * y * x * 2 <= 8000000), max(level)) AS level FROM lv GROUP BY dataset")
def k6(s, d):
    return R.choose_level(_levels(s, d), 8000000)


@query("k7_pending", "SELECT seq, domain FROM edits WHERE pending ORDER BY seq")
def k7(s, d):
    return R.pending_edits(X.edits(s, d)).select("seq", "domain")


@query("u1_max_label", "SELECT greatest((SELECT max(id) FROM base), (SELECT max(label) FROM mask_labels)) AS max_id")
def u1(s, d):
    return R.max_label_id(X.base(s, d), X.mask_labels(s, d))


@query("u2_ids_in_use", "SELECT id FROM base WHERE id BETWEEN 100 AND 400 UNION SELECT label FROM mask_labels WHERE label BETWEEN 100 AND 400")
def u2(s, d):
    return R.ids_in_use(X.base(s, d), X.mask_labels(s, d), 100, 400)


_STAMPS = """stm AS (SELECT id AS stroke, t, z + 0.5 AS cz, y + 0.5 AS cy, x + 0.5 + k * 1.25 AS cx, 1 + user_id % 4 AS r FROM base, (SELECT unnest(range(0, 2)) AS k)),
sv AS (SELECT DISTINCT stroke, t, z, y, x FROM stm, (SELECT unnest(range(0, 8)) AS z), (SELECT unnest(range(-6, 8)) AS dy), (SELECT unnest(range(-6, 8)) AS dx), LATERAL (SELECT CAST(floor(cy) AS BIGINT) + dy AS y, CAST(floor(cx) AS BIGINT) + dx AS x)
WHERE y BETWEEN 0 AND 511 AND x BETWEEN 0 AND 511 AND ((z + 0.5 - cz) / (r * 1.0 / 2.0)) * ((z + 0.5 - cz) / (r * 1.0 / 2.0)) + ((y + 0.5 - cy) / r) * ((y + 0.5 - cy) / r) + ((x + 0.5 - cx) / r) * ((x + 0.5 - cx) / r) <= 1.0)"""


def _stamps(s, d, *more):
    b = X.base(s, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return b.select(*[F.expr(m) for m in more], F.col("id").alias("stroke"), "t", (F.col("z") + 0.5).alias("cz"), (F.col("y") + 0.5).alias("cy"), (F.col("x") + 0.5 + F.col("k") * 1.25).alias("cx"), (1 + F.col("user_id") % 4).cast("double").alias("r"))


_AS_RUNS = "SELECT stroke, t, z, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY stroke, t, z, y ORDER BY x) AS g FROM sv) GROUP BY stroke, t, z, y, g"


@query("u3_voxel_union", f"WITH {_STAMPS}, b AS (SELECT DISTINCT t, z, y, x FROM sv UNION SELECT t, z, y, x FROM voxels) SELECT t, z, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY t, z, y ORDER BY x) AS g FROM b) GROUP BY t, z, y, g")
def u3(s, d):
    cols = ["t", "z", "y", "x0", "x1"]
    return L.union_sets(L.stamp_runs(_stamps(s, d), (8, 512, 512), (2.0, 1.0, 1.0)).select(cols), X.runs(s, d).select(cols), keys=("t", "z", "y"))


@query("u4_label_edit", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(labels, []), ['new', 'a']), lambda x: x <> 'treated'))), ',') AS labels FROM cells")
def u4(s, d):
    return X.cells(s, d, False).select("id", F.array_join(G.edit_labels(F.col("labels"), F.array(F.lit("new"), F.lit("a")), F.array(F.lit("treated"))), ",").alias("labels"))


@query("u5_vocabulary_merge", """WITH st AS (SELECT DISTINCT event_type AS name, CASE WHEN event_type < 'd' THEN '#010203' END AS color FROM events), nw AS (SELECT trim(name) AS name, min(CASE WHEN regexp_full_match(color, '#[0-9a-fA-F]{6}') THEN lower(color) END) AS color FROM (SELECT ' ' || event_type || ' ' AS name, '#AABB' || lpad(CAST(user_id % 5 AS VARCHAR), 2, '0') AS color FROM events UNION ALL SELECT '  ', '#000000' UNION ALL SELECT 'extra', 'red') WHERE trim(name) <> '' GROUP BY 1)
SELECT coalesce(st.name, nw.name) AS name, coalesce(st.color, nw.color) AS color FROM st FULL JOIN nw ON nw.name = st.name""")
def u5(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    stored = e.select(F.col("event_type").alias("name"), F.when(F.col("event_type") < "d", "#010203").alias("color")).distinct()
    new = e.select(F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("name"), F.concat(F.lit("#AABB"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")).alias("color"))
    more = s.createDataFrame([("  ", "#000000"), ("extra", "red")], "name string, color string")
    return R.merge_definitions(stored, new.unionByName(more))


_AFTER = "aft AS (SELECT parent, child, confidence, reviewed FROM links WHERE child % 8 <> 0 UNION ALL SELECT a.id, b.id, NULL, true FROM base a JOIN base b ON b.id = a.id + 700 AND b.t > a.t WHERE b.id NOT IN (SELECT child FROM links) AND a.id NOT IN (SELECT parent FROM links))"


def _after(b, lk):
    free_parent = b.select("id", "t").join(lk.select(F.col("parent").alias("id")), "id", "left_anti")
    free_child = b.select(F.col("id").alias("child"), F.col("t").alias("ct")).join(lk.select("child"), "child", "left_anti")
    new = free_parent.withColumn("child", F.col("id") + 700).join(free_child, "child").where("ct > t")
    return lk.where("child % 8 <> 0").unionByName(new.select(F.col("id").alias("parent"), "child", F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("reviewed")))


@query("u6_link_delta", f"WITH {_AFTER} SELECT parent, child, confidence, 'added' AS change FROM aft WHERE (parent, child) NOT IN (SELECT (parent, child) FROM links) UNION ALL SELECT parent, child, confidence, 'removed' FROM links WHERE (parent, child) NOT IN (SELECT (parent, child) FROM aft)")
def u6(s, d):
    b, lk = X.forest(s, d)
    return G.diff_links(lk, _after(b, lk)).select("parent", "child", "confidence", "change")


@query("u7_incident_links", "SELECT parent, child FROM links WHERE parent IN (SELECT id FROM base WHERE user_id % 3 = 0 AND n < 5) OR child IN (SELECT id FROM base WHERE user_id % 3 = 0 AND n < 5)")
def u7(s, d):
    return G.chain_links(X.links(s, d), X.base(s, d).where("user_id % 3 = 0 AND n < 5")).select("parent", "child")


# --- graph -------------------------------------------------------------------------


@query("g1_chains", "SELECT id, head, pos, count(*) OVER (PARTITION BY head) AS length FROM chains")
def g1(s, d):
    return G.chains(X.base(s, d), X.links(s, d))


@query("g2_lineage", "SELECT r.id, r.root, r.depth, l.parent FROM roots r LEFT JOIN links l ON l.child = r.id WHERE r.root IN (SELECT root FROM roots WHERE id % 20 = 0)")
def g2(s, d):
    b, lk = X.base(s, d), X.links(s, d)
    members, links = G.lineage(b, lk, b.where("id % 20 = 0"))
    return members.join(links.select(F.col("child").alias("id"), "parent"), "id", "left").select("id", "root", "depth", "parent")


_PROPOSALS = "pr AS (SELECT row_number() OVER (ORDER BY b.id) AS seq, CASE WHEN b.id % 6 = 0 THEN b.id + 1000000 ELSE b.id END AS parent, CASE WHEN b.id % 6 = 1 THEN coalesce((SELECT min(child) FROM links WHERE parent = b.id), b.id + 1) WHEN b.id % 6 = 2 THEN greatest(b.id - 1, 1) WHEN b.id % 6 = 3 THEN coalesce((SELECT min(id) FROM base x WHERE x.id NOT IN (SELECT child FROM links) AND x.id > b.id AND x.id // 1000 = b.id // 1000), 1) ELSE b.id + 30 END AS child FROM base b)"


@query("g3_validate_links", f"""WITH {_PROPOSALS}, q AS (SELECT pr.*, p.t AS pt, c.t AS ct, coalesce((SELECT min(parent) FROM links l WHERE l.child = pr.child), first_value(pr.parent) OVER (PARTITION BY pr.child ORDER BY pr.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS taken,
coalesce((SELECT n FROM kids k WHERE k.parent = pr.parent), 0) + count(*) OVER (PARTITION BY pr.parent ORDER BY pr.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS num FROM pr LEFT JOIN base p ON p.id = pr.parent LEFT JOIN base c ON c.id = pr.child)
SELECT seq, parent, child, CASE WHEN pt IS NULL OR ct IS NULL THEN 'unknown_cell' WHEN ct <= pt THEN 'not_forward' WHEN taken = parent THEN 'duplicate' WHEN taken IS NOT NULL THEN 'has_parent' WHEN num >= 2 THEN 'two_children' WHEN ct - pt > 5 THEN 'gap' END AS reason FROM q""")
def g3(s, d):
    b, lk = X.base(s, d), X.links(s, d)
    first = lk.groupBy(F.col("parent").alias("id")).agg(F.min("child").alias("first"))
    free = b.select("id").join(lk.select(F.col("child").alias("id")), "id", "left_anti").select(F.col("id").alias("free"), F.lit(1).alias("isfree"))
    nxt = b.select("id").join(free, F.col("id") == F.col("free"), "left")
    nxt = nxt.withColumn("next_free", F.first("free", ignorenulls=True).over(Window.partitionBy(F.expr("id div 1000")).orderBy("id").rowsBetween(1, Window.unboundedFollowing)))
    m, i = F.col("id") % 6, F.col("id")
    child = F.when(m == 1, F.coalesce("first", i + 1)).when(m == 2, F.greatest(i - 1, F.lit(1))).when(m == 3, F.coalesce("next_free", F.lit(1))).otherwise(i + 30)
    pr = nxt.select("id", "next_free").join(first, "id", "left").select("id", F.when(m == 0, i + 1000000).otherwise(i).alias("parent"), child.alias("child"))
    return G.validate_links(G.number_rows(pr, ["id"], "seq").select("seq", "parent", "child"), b, lk, 5)


def _remat(chain_sql: str, seeds: str) -> str:
    """Identity rule over the link set ``aft``, for ``seeds`` of ids."""
    return f"""{chain_sql}, akids AS (SELECT parent, count(*) AS n FROM aft GROUP BY parent),
ach(id, head) AS (SELECT b.id, b.id FROM base b LEFT JOIN aft l ON l.child = b.id LEFT JOIN akids k ON k.parent = l.parent WHERE l.parent IS NULL OR k.n > 1 UNION ALL SELECT l.child, c.head FROM ach c JOIN akids k ON k.parent = c.id AND k.n = 1 JOIN aft l ON l.parent = c.id),
seeds AS ({seeds}), tou AS (SELECT DISTINCT head FROM ach WHERE id IN (SELECT id FROM seeds)),
hd AS (SELECT head, CASE WHEN head IN (SELECT id FROM chains WHERE pos = 0) THEN (SELECT track_id FROM cells WHERE id = head) END AS kept FROM tou),
ids AS (SELECT head, coalesce(kept, 19999 + row_number() OVER (PARTITION BY kept IS NULL ORDER BY head)) AS new FROM hd)
SELECT a.id, c.track_id AS old, i.new FROM ach a JOIN ids i ON i.head = a.head JOIN cells c ON c.id = a.id"""


_CHANGED = "(SELECT parent, child FROM aft EXCEPT SELECT parent, child FROM links) UNION ALL (SELECT parent, child FROM links EXCEPT SELECT parent, child FROM aft)"
_SEEDS = f"WITH ch AS ({_CHANGED}) SELECT parent AS id FROM ch UNION SELECT child FROM ch UNION SELECT child FROM aft WHERE parent IN (SELECT parent FROM ch)"


@query("g4_rematerialize", "WITH " + _remat(_AFTER, _SEEDS))
def g4(s, d):
    b, lk = X.forest(s, d)
    return G.rematerialize(staged(X.cells_of(b, lk), "cells"), lk, staged(_after(b, lk), "after"), 20000)


_LINKED = """pr AS (SELECT arg_max(a.id, a.t) AS parent, b.id AS child FROM base b JOIN base a ON a.user_id = b.user_id - 1 AND a.t < b.t WHERE b.id NOT IN (SELECT child FROM links) GROUP BY b.id),
aft AS (SELECT parent, child FROM links UNION ALL SELECT parent, child FROM pr WHERE parent IN (SELECT parent FROM kids WHERE n = 1))"""


@query("g5_link", "WITH " + _remat(_LINKED, _SEEDS))
def g5(s, d):
    b, lk = X.forest(s, d)
    roots = b.select(F.col("id").alias("child"), (F.col("user_id") - 1).alias("user_id"), F.col("t").alias("ct")).join(lk.select("child"), "child", "left_anti")
    near = b.join(roots, "user_id").where("t < ct").groupBy("child").agg(F.max_by("id", "t").alias("parent"))
    single = lk.groupBy("parent").count().where("count = 1").select("parent")
    new = near.join(single, "parent", "left_semi").select(F.col("child").alias("seq"), "parent", "child")
    return G.graph_link(staged(X.cells_of(b, lk), "cells"), lk, new, 20000)[1]


@query("g6_cut", "WITH " + _remat("aft AS (SELECT parent, child FROM links WHERE child % 8 <> 0)", _SEEDS))
def g6(s, d):
    b, lk = X.forest(s, d)
    return G.graph_cut(staged(X.cells_of(b, lk), "cells"), lk, lk.where("child % 8 = 0"), 20000)[1]


@query("g7_unlink", "WITH " + _remat("mine AS (SELECT id FROM chains WHERE head IN (SELECT head FROM chains WHERE id % 30 = 0)), gone AS (SELECT parent, child FROM links WHERE parent IN (SELECT id FROM mine) OR child IN (SELECT id FROM mine)), aft AS (SELECT parent, child FROM links WHERE (parent, child) NOT IN (SELECT (parent, child) FROM gone))", "SELECT parent AS id FROM gone UNION SELECT child FROM gone UNION SELECT child FROM aft WHERE parent IN (SELECT parent FROM gone) UNION SELECT id FROM mine"))
def g7(s, d):
    b, lk = X.forest(s, d)
    c = staged(X.cells_of(b, lk), "cells")
    return G.graph_unlink(c, lk, c.where("id % 30 = 0"), 20000)[1]


@query("g8_set_labels", "WITH m AS (SELECT c.id, list_sort(coalesce(track_labels, [])) AS before FROM cells c JOIN chains h ON h.id = c.id WHERE h.head IN (SELECT head FROM chains WHERE id % 12 = 0)), a AS (SELECT id, before, list_sort(list_distinct(list_filter(list_concat(before, ['late']), lambda x: x <> 'cell type 1'))) AS after FROM m) SELECT id, array_to_string(before, ',') AS before, array_to_string(after, ',') AS after FROM a WHERE before <> after")
def g8(s, d):
    c = X.cells(s, d, False)
    out = G.set_labels(c, X.links(s, d), c.where("id % 12 = 0"), "track", ["late"], ["cell type 1"])
    return out.select("id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("g9_strip_label", "SELECT id, array_to_string(list_filter(coalesce(labels, []), lambda x: x <> 'treated'), ',') AS labels, array_to_string(coalesce(track_labels, []), ',') AS track_labels FROM cells WHERE list_contains(labels, 'treated')")
def g9(s, d):
    return G.strip_label(X.cells(s, d, False), "treated").select("id", F.array_join("labels", ",").alias("labels"), F.array_join("track_labels", ",").alias("track_labels"))


@query("g10_apply_delta", f"WITH {_AFTER} SELECT parent, child, 0 AS track_id FROM aft UNION ALL SELECT id, -1, CASE WHEN id % 10 = 0 THEN user_id ELSE track_id END FROM cells WHERE track_id IS NOT NULL OR id % 10 = 0")
def g10(s, d):
    b, lk = X.forest(s, d)
    c = staged(X.cells_of(b, lk), "cells")
    change = G.diff_links(lk, _after(b, lk))
    moves = c.where("id % 10 = 0").select("id", F.col("track_id").alias("old"), F.col("user_id").alias("new"))
    once = G.apply_delta(lk, moves, c, change, False)
    back = G.apply_delta(staged(once[0], "links"), moves, staged(once[1], "cells"), change, True)
    again = G.apply_delta(staged(back[0], "links"), moves, staged(back[1], "cells"), change, False)
    return again[0].select("parent", "child", F.lit(0).cast("long").alias("track_id")).unionByName(again[1].where("track_id IS NOT NULL").select(F.col("id").alias("parent"), F.lit(-1).cast("long").alias("child"), "track_id"))


@query("g11_lineage_rows", "SELECT c.id, c.t, CASE WHEN l.child IS NOT NULL THEN l.confidence ELSE c.detection_confidence END AS confidence, coalesce(k.n >= 2, false) AS division, c.id % 9 = 0 AS selected FROM cells c LEFT JOIN links l ON l.child = c.id LEFT JOIN kids k ON k.parent = c.id")
def g11(s, d):
    c = X.cells(s, d, False)
    return G.lineage_rows(c, X.links(s, d), c.where("id % 9 = 0"))


@query("g12_lineage_layout", """WITH paths AS (SELECT b.id AS root, b.id, b.t, b.t AS top, [b.t * 1000000000 + b.id] AS path FROM base b LEFT JOIN links l ON l.child = b.id WHERE l.parent IS NULL
UNION ALL SELECT p.root, b.id, b.t, p.top, list_append(p.path, b.t * 1000000000 + b.id) FROM paths p JOIN links l ON l.parent = p.id JOIN base b ON b.id = l.child),
leaves AS (SELECT id, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS col FROM paths WHERE id NOT IN (SELECT parent FROM links)),
ends AS (SELECT DISTINCT parent, unnest([arg_min(child, c.path), arg_max(child, c.path)]) AS child, CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM links l JOIN paths c ON c.id = l.child GROUP BY parent),
reach AS (SELECT id, id AS down, 1.0::DOUBLE AS weight FROM paths UNION ALL SELECT r.id, e.child, r.weight * e.share FROM reach r JOIN ends e ON e.parent = r.down)
SELECT p.root, p.id, w.col, p.t - p.top AS row FROM paths p JOIN (SELECT r.id, sum(r.weight * v.col) AS col FROM reach r JOIN leaves v ON v.id = r.down GROUP BY r.id) w ON w.id = p.id""")
def g12(s, d):
    b, lk = X.base(s, d), X.links(s, d)
    b, lk = staged(b.select("id", "t"), "cells"), staged(lk, "links")
    return G.lineage_layout(b.join(G.tree_roots(b, lk), "id"), lk)


@query("g13_shown_tracks", f"WITH {_SPANS}, {_SHOWN} SELECT track FROM shown")
def g13(s, d):
    return G.shown_tracks(G.track_spans(G.with_parent(X.cells(s, d), X.links(s, d))), 12)


@query("g14_division_edges", "WITH c AS (SELECT id, t, coalesce(track_id, id) AS track FROM cells WHERE z IS NOT NULL) SELECT l.parent, l.child, b.track, b.t FROM links l JOIN c a ON a.id = l.parent JOIN c b ON b.id = l.child WHERE a.track <> b.track AND b.t BETWEEN 10 AND 20")
def g14(s, d):
    return G.division_edges(X.cells(s, d), X.links(s, d), 20, 10)


@query("g15_track_identity", "WITH c AS (SELECT id, CASE WHEN id % 25 = 0 THEN 1 ELSE track_id END AS track_id FROM cells) SELECT track_id, count(DISTINCT head) AS chains FROM c JOIN chains h ON h.id = c.id WHERE track_id IS NOT NULL GROUP BY track_id HAVING count(DISTINCT head) > 1")
def g15(s, d):
    c = X.cells(s, d).withColumn("track_id", F.when(F.col("id") % 25 == 0, 1).otherwise(F.col("track_id")))
    return G.check_track_identity(c, X.links(s, d))


# --- arrays and voxels -----------------------------------------------------------------


@query("v1_layout", f"""WITH {_LEVELS}, g AS (SELECT *, greatest(1, CAST(ceil(z / cz) AS BIGINT)) AS gz, greatest(1, CAST(ceil(y / cy) AS BIGINT)) AS gy, greatest(1, CAST(ceil(x / cx) AS BIGINT)) AS gx, least(cz, greatest(z, 1)) * least(cy, greatest(y, 1)) * least(cx, greatest(x, 1)) * item_bytes AS cb FROM lv),
v AS (SELECT dataset, level, 'xy' AS view, y * x * item_bytes AS bytes_needed, gy * gx AS chunks_decoded, 1 AS column_chunks, cb FROM g UNION ALL SELECT dataset, level, 'xz', z * x * item_bytes, gz * gx, gz, cb FROM g UNION ALL SELECT dataset, level, 'yz', z * y * item_bytes, gz * gy, gz, cb FROM g)
SELECT dataset, level, view, bytes_needed, chunks_decoded * cb AS bytes_decoded, chunks_decoded, column_chunks, CASE WHEN bytes_needed = 0 THEN 1.0 ELSE chunks_decoded * cb / bytes_needed END AS amplification, CASE WHEN view = 'xy' THEN chunks_decoded * cb / bytes_needed > 4 ELSE column_chunks > 8 END AS hostile FROM v""")
def v1(s, d):
    return A.analyze_layout(_levels(s, d))


@query("v2_level_factors", f"""WITH {_LEVELS}, k AS (SELECT *, 0.5::DOUBLE * pow(2, level) AS sc, CASE WHEN dataset % 3 = 1 OR (dataset % 3 = 2 AND level = 2) THEN NULL ELSE 0.5::DOUBLE * pow(2, level) END AS sz, CASE WHEN dataset % 3 = 2 AND level = 2 THEN NULL WHEN dataset % 12 = 3 AND level > 0 THEN 'nan'::DOUBLE ELSE 0.5::DOUBLE * pow(2, level) END AS sy FROM lv)
SELECT a.dataset, a.level, CASE WHEN ok THEN coalesce(a.sz / b.sz, 1.0) ELSE b.z / a.z END AS fz, CASE WHEN ok THEN a.sy / b.sy ELSE b.y / a.y END AS fy, CASE WHEN ok THEN a.sc / b.sc ELSE b.x / a.x END AS fx FROM (SELECT *, sy IS NOT NULL AND NOT isnan(sy) AS ok FROM k) a JOIN k b ON b.dataset = a.dataset AND b.level = 0""")
def v2(s, d):
    scale, at = F.pow(F.lit(2.0), "level") * 0.5, F.col("dataset")
    gap = (at % 3 == 2) & (F.col("level") == 2)
    odd = F.when(gap, None).when((at % 12 == 3) & (F.col("level") > 0), float("nan")).otherwise(scale)
    return A.level_factors(_levels(s, d).withColumns({"scale_z": F.when((at % 3 == 1) | gap, None).otherwise(scale), "scale_y": odd, "scale_x": scale}))


_STORE_NAMES = [list("tczyx"), ["time", " Y", "x"], ["y", "t", "x"], None, None, None, ["tile", "cat", "yak", "xor"], ["time", "depth", "y", "x"], None, ["z", "Z", "y", "x"]]
_STORE_DIMS = [None, ["z", "y", "x"], None, None, None, ["t", "Depth", "y", "x"], None, None, ["a", "b", "y", "x"], None]


def _list_sql(values: list | None) -> str:
    return "NULL" if values is None else "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _by_ten(values: list[str]) -> str:
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))


_STORE_SHAPES = ["[1, 2, 3, 4, 5 + c_custkey]", "[7, 8, c_custkey]", "[1, 2, 3]", "[4, 5]", *["[2, 3, 4, c_custkey]"] * 6]
_LETTER = "CASE lower(trim(x)) WHEN 't' THEN 't' WHEN 'time' THEN 't' WHEN 'c' THEN 'c' WHEN 'channel' THEN 'c' WHEN 'ch' THEN 'c' WHEN 'z' THEN 'z' WHEN 'depth' THEN 'z' WHEN 'y' THEN 'y' WHEN 'x' THEN 'x' ELSE '?' END"
_STORES = f"stores AS (SELECT c_custkey AS id, CASE c_custkey % 10 {_by_ten([_list_sql(v) for v in _STORE_NAMES])} END AS names, CASE c_custkey % 10 {_by_ten([_list_sql(v) for v in _STORE_DIMS])} END AS dims, CASE c_custkey % 10 {_by_ten(_STORE_SHAPES)} END AS shape FROM customer)"


@query("v3_axes", f"""WITH {_STORES}, s AS (SELECT id, shape, array_to_string(list_transform(names, lambda x: {_LETTER}), '') AS named, array_to_string(list_transform(dims, lambda x: {_LETTER}), '') AS own FROM stores),
a AS (SELECT id, shape, coalesce(named, CASE WHEN length(own) = len(shape) AND strpos(own, '?') = 0 THEN own END, CASE len(shape) WHEN 2 THEN 'yx' WHEN 3 THEN 'zyx' WHEN 4 THEN 'czyx' WHEN 5 THEN 'tczyx' END) AS axes FROM s), b AS (SELECT *, regexp_full_match(axes, 't?c?z?yx') AND length(axes) = len(shape) AS ok FROM a)
SELECT id, axes, ok, CASE WHEN ok THEN coalesce(shape[nullif(strpos(axes, 't'), 0)], 1) END AS t, CASE WHEN ok THEN coalesce(shape[nullif(strpos(axes, 'c'), 0)], 1) END AS c, CASE WHEN ok THEN coalesce(shape[nullif(strpos(axes, 'z'), 0)], 1) END AS z, CASE WHEN ok THEN shape[strpos(axes, 'y')] END AS y, CASE WHEN ok THEN shape[strpos(axes, 'x')] END AS x FROM b""")
def v3(s, d):
    k = F.col("c_custkey")
    shapes = [[1, 2, 3, 4, 5 + k], [7, 8, k], [1, 2, 3], [4, 5], *[[2, 3, 4, k]] * 6]

    def pick(values, kind):
        out = F.lit(None).cast(kind)
        for i, v in enumerate(values):
            if v is not None:
                out = F.when(k % 10 == i, F.array(*[x if not isinstance(x, (int, str)) else F.lit(x) for x in v]).cast(kind)).otherwise(out)
        return out

    stores = s.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), pick(_STORE_NAMES, "array<string>").alias("names"), pick(_STORE_DIMS, "array<string>").alias("dim_names"), pick(shapes, "array<bigint>").alias("shape"))
    return A.resolve_axes(stores).select("id", "axes", "ok", *"tczyx")


@query("v4_planes", "SELECT c, y AS row, x AS col, value, 'z' AS axis FROM image WHERE t = 1 AND z = 2 UNION ALL SELECT c, z, x, value, 'y' FROM image WHERE t = 1 AND y = 5 UNION ALL SELECT c, z, y, value, 'x' FROM image WHERE t = 1 AND x = 9")
def v4(s, d):
    v = X.image(s, d)
    parts = [A.ortho_plane(v, a, 1, i, [0, 1]).withColumn("axis", F.lit(a)) for a, i in (("z", 2), ("y", 5), ("x", 9))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("v4_planes_of_chunks", "SELECT t, c, y AS row, x AS col, value FROM image WHERE z = 2")
def v4b(s, d):
    return A.chunk_plane(A.to_chunks(X.image(s, d), (2, 8, 8), (4, 17, 17)), "z", 2)


@query("v5_volume", "SELECT z, y, x, value FROM image WHERE t = 2 AND c = 1")
def v5(s, d):
    levels = s.range(1).select(F.lit(4).alias("z"), F.lit(17).alias("y"), F.lit(17).alias("x"), F.lit(2).alias("item_bytes"))
    return A.volume(X.image(s, d), levels, 2, 1)


_POINTS = "pts AS (SELECT c_custkey AS id, c_custkey // 8 AS t, c_custkey % 3 AS c, c_custkey % 4 AS z, c_custkey % 19 AS y, c_custkey % 17 AS x FROM customer)"


@query("v6_samples", f"WITH {_POINTS}, b AS (SELECT *, CASE WHEN t > (SELECT max(t) FROM image) THEN 't' WHEN c > 1 THEN 'c' WHEN y > 16 THEN 'y' END AS bad_axis FROM pts) SELECT b.id, CASE WHEN bad_axis IS NULL THEN coalesce(i.value, 0) END AS value, bad_axis FROM b LEFT JOIN image i USING (t, c, z, y, x)")
def v6(s, d):
    k = F.col("c_custkey")
    points = s.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.expr("c_custkey div 8").alias("t"), (k % 3).alias("c"), (k % 4).alias("z"), (k % 19).alias("y"), (k % 17).alias("x"))
    frames = (X.base(s, d).agg(F.max("user_id")).first()[0] or 0) + 1
    return A.sample_points(X.image(s, d), points, {"t": frames, "c": 2, "z": 4, "y": 17, "x": 17})


@query("v7_rechunk", "SELECT t, c, z, y, x, value FROM image")
def v7(s, d):
    return A.chunk_voxels(A.rechunk(A.to_chunks(X.image(s, d), (2, 8, 8), (4, 17, 17)), (3, 10, 20), (4, 17, 17)))


@query("v8_proxy", "SELECT t, c, z, y, x, value FROM image")
def v8(s, d):
    proxy = A.build_proxy(_bricks(s, d), (4, 17, 17))
    return A.chunk_voxels(proxy.where("nz = 4 AND ny = 17 AND nx = 17"))


@query("v9_stamps", f"WITH {_STAMPS} {_AS_RUNS}")
def v9(s, d):
    return L.merge_runs(L.stamp_runs(_stamps(s, d), (8, 512, 512), (2.0, 1.0, 1.0)), ("stroke", "t", "z", "y"))


@query("v10_strokes", f"WITH {_STAMPS}, pv AS (SELECT sv.* FROM sv JOIN base b ON b.id = sv.stroke WHERE b.user_id % 2 = 1 OR sv.z = b.z) {_AS_RUNS.replace('FROM sv', 'FROM pv')}")
def v10(s, d):
    """Every other user's strokes are pinned to the plane of their own z."""
    pinned = F.col("stroke_user") % 2 == 0
    stamps = _stamps(s, d, "user_id AS stroke_user").withColumns({"plane_axis": F.when(pinned, "z"), "plane_index": F.when(pinned, F.floor("cz"))}).drop("stroke_user")
    return L.rasterize_strokes(stamps, (8, 512, 512), (2.0, 1.0, 1.0))


_EDITED = f"""{_STAMPS}, km AS (SELECT sv.*, CASE stroke % 3 WHEN 0 THEN 'paint' WHEN 1 THEN 'erase' ELSE 'scoped' END AS mode FROM sv),
un AS (SELECT t, z, y, x, label FROM voxels UNION ALL SELECT t, z, y, x, 0 FROM km), ol AS (SELECT t, z, y, x, max(label) AS old FROM un GROUP BY ALL),
ks AS (SELECT t, z, y, x, list(struct_pack(s := stroke, m := mode) ORDER BY stroke) AS ops FROM km GROUP BY ALL),
nv AS (SELECT ol.t, ol.z, ol.y, ol.x, old, list_reduce(list_concat([struct_pack(s := old, m := 'old')], coalesce(ops, [])), lambda a, e: CASE WHEN e.m = 'paint' THEN struct_pack(s := e.s + 500000, m := 'v') WHEN e.m = 'erase' OR a.s = e.s THEN struct_pack(s := CAST(0 AS BIGINT), m := 'v') ELSE a END).s AS new FROM ol LEFT JOIN ks USING (t, z, y, x))"""


def _runs(s, d):
    """The label volume as a stored table, as an operator's input is."""
    return staged(X.runs(s, d), "runs")


def _bricks(s, d):
    return staged(A.to_chunks(X.image(s, d), (2, 8, 8), (4, 17, 17)), "bricks")


def _strokes(s, d):
    r = L.rasterize_strokes(_stamps(s, d), (8, 512, 512), (2.0, 1.0, 1.0))
    m = F.col("stroke") % 3
    return staged(r, "strokes").select("t", "z", "y", "x0", "x1", F.col("stroke").alias("seq"), F.when(m == 0, "paint").when(m == 1, "erase").otherwise("scoped").alias("mode"), (F.col("stroke") + 500000).alias("label"), F.col("stroke").alias("only"))


@query("v11_apply_strokes", f"WITH {_EDITED} SELECT t, z, y, x, new AS label FROM nv WHERE new <> 0")
def v11(s, d):
    return L.explode_runs(L.apply_strokes(_runs(s, d), _strokes(s, d))[0]).select("t", "z", "y", "x", "label")


_STROKE_DELTAS = "sd AS (SELECT t, label, CAST(sum(n) AS BIGINT) AS area, CAST(sum(n * z) AS BIGINT) AS sum_z, CAST(sum(n * y) AS BIGINT) AS sum_y, CAST(sum(n * x) AS BIGINT) AS sum_x FROM (SELECT t, z, y, x, old AS label, -1 AS n FROM nv WHERE old <> new UNION ALL SELECT t, z, y, x, new, 1 FROM nv WHERE old <> new) WHERE label <> 0 GROUP BY t, label)"


@query("v11_stroke_deltas", f"WITH {_EDITED}, {_STROKE_DELTAS} SELECT t, label, area, sum_z, sum_y, sum_x FROM sd")
def v11b(s, d):
    return L.change_deltas(L.apply_strokes(_runs(s, d), _strokes(s, d))[1])


@query("v12_clear_label", "WITH w AS (SELECT min(label) AS label FROM voxels WHERE t = 2), b AS (SELECT min(x) AS x0, max(y) AS y1 FROM voxels WHERE label = (SELECT label FROM w)) SELECT t, z, y, x, label FROM voxels WHERE NOT (t = 2 AND label = (SELECT label FROM w) AND y <= (SELECT y1 FROM b) AND x BETWEEN (SELECT x0 + 1 FROM b) AND (SELECT x0 + 2 FROM b))")
def v12(s, d):
    r = X.runs(s, d)
    w = r.where("t = 2").agg(F.min("label")).first()[0] or 0
    b = r.where(F.col("label") == w).agg(F.min("x0").alias("x0"), F.max("y").alias("y1")).first()
    x0, y1 = b.x0 or 0, b.y1 or 0
    return L.explode_runs(L.clear_label(r, 2, w, (0, 7, 0, y1, x0 + 1, x0 + 2))).select("t", "z", "y", "x", "label")


@query("v13_affected_chunks", "SELECT DISTINCT t, z // 4 AS gz, y // 128 AS gy, x // 128 AS gx FROM voxels")
def v13(s, d):
    return L.affected_chunks(X.runs(s, d), (4, 128, 128))


@query("v14_coarse", "SELECT t, z // 2 AS z, y // 2 AS y, x // 4 AS x, label FROM voxels WHERE z % 2 = 0 AND y % 2 = 0 AND x % 4 = 0")
def v14(s, d):
    return L.explode_runs(L.regenerate_coarse(X.runs(s, d), (2, 2, 4))).select("t", "z", "y", "x", "label")


@query("v15_label_pyramid", "SELECT v.t, a.i AS z, b.i AS y, c.i AS x, label FROM voxels v JOIN (SELECT i, i * 8 // 5 AS s FROM range(0, 5) r(i)) a ON a.s = z JOIN (SELECT i, i * 512 // 200 AS s FROM range(0, 200) r(i)) b ON b.s = y JOIN (SELECT i, i * 512 // 300 AS s FROM range(0, 300) r(i)) c ON c.s = x")
def v15(s, d):
    return L.explode_runs(L.label_pyramid(X.runs(s, d), (8, 512, 512), (5, 200, 300))).select("t", "z", "y", "x", "label")


@query("v16_restore", "WITH ck AS (SELECT DISTINCT chunk_key, 'now ' || chunk_key AS data FROM blobs), sn AS (SELECT chunk_key, arg_min(existed, seq) AS existed, arg_min(before, seq) AS data FROM blobs WHERE seq % 7 = 0 GROUP BY chunk_key) SELECT chunk_key, data FROM ck WHERE chunk_key NOT IN (SELECT chunk_key FROM sn) UNION ALL SELECT chunk_key, data FROM sn WHERE existed")
def v16(s, d):
    b = X.blobs(s, d)
    chunks = b.select("chunk_key", F.concat(F.lit("now "), "chunk_key").alias("data")).distinct()
    snaps = b.where("seq % 7 = 0").groupBy("chunk_key").agg(F.min_by("existed", "seq").alias("existed"), F.min_by("before", "seq").alias("data"))
    return E.restore_chunks(chunks, snaps)


@query("v17_outline", """WITH st AS (SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0),
n AS (SELECT p.t, p.z, p.y AS oy, p.x AS ox, p.label AS owner, p.y + dy AS y, p.x + dx AS x FROM voxels p, st WHERE p.y + dy BETWEEN 0 AND 511 AND p.x + dx BETWEEN 0 AND 511),
o AS (SELECT n.*, q.label FROM n LEFT JOIN voxels q ON q.t = n.t AND q.z = n.z AND q.y = n.y AND q.x = n.x WHERE q.label IS NULL OR q.label <> owner)
SELECT t, z, y, x, min(owner) AS owner FROM (SELECT t, z, oy AS y, ox AS x, owner FROM o UNION ALL SELECT t, z, y, x, owner FROM o WHERE label IS NULL) GROUP BY t, z, y, x""")
def v17(s, d):
    return L.label_outline(_runs(s, d), (512, 512))


@query("v18_level_shapes", f"WITH RECURSIVE im AS (SELECT c_custkey AS dataset, 2 AS t, 1 AS c, 4 AS z, 200 + c_custkey % 3000 AS y, 300 + c_custkey % 2000 AS x FROM customer), lvl AS (SELECT *, 0 AS level FROM im UNION ALL SELECT dataset, t, c, z, y // 2, x // 2, level + 1 FROM lvl WHERE least(y, x) > 256) SELECT dataset, level, z, y, x, t * c * z * y * x * 2 AS bytes FROM lvl")
def v18(s, d):
    k = F.col("c_custkey")
    return A.level_shapes(s.read.parquet(f"{d}/customer.parquet").select(k.alias("dataset"), F.lit(2).cast("long").alias("t"), F.lit(1).cast("long").alias("c"), F.lit(4).cast("long").alias("z"), (200 + k % 3000).alias("y"), (300 + k % 2000).alias("x")))


@query("v18_image_pyramid", "WITH a AS (SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(value), 0) AS BIGINT) AS value FROM image WHERE y < 16 AND x < 16 GROUP BY ALL), b AS (SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(value), 0) AS BIGINT) AS value FROM a GROUP BY ALL) SELECT t, c, z, y, x, value, 0 AS level FROM image UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b")
def v18b(s, d):
    return A.build_pyramid(X.image(s, d), 17, 17, 4)


@query("v19_window_gamma", "SELECT t, c, z, y, x, CAST(round(1000000 * pow(least(1.0, greatest(0.0, (value - 1000) / (40000 - 1000))), 0.8)) AS BIGINT) AS shade FROM image")
def v19(s, d):
    return X.image(s, d).select("t", "c", "z", "y", "x", F.round(1000000 * S.window_gamma(F.col("value"), 1000, 40000, 0.8)).cast("long").alias("shade"))


@query("v20_world", "SELECT id, z * (2.0 / 0.5 * 1.5) AS wz, y * (0.5 / 0.5 * 1.0) AS wy, x * 1.0 AS wx FROM cells")
def v20(s, d):
    return A.to_world(X.cells(s, d, False), (2.0, 0.5, 0.5), (1.5, 1.0, 1.0)).select("id", "wz", "wy", "wx")


@query("v21_voxel_size", "WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 5 - 2) * 0.5 END AS e, c_custkey % 7 AS n, CASE c_custkey % 3 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e3 ELSE 1.0 END AS um FROM customer) SELECT id, CASE WHEN e <> 0 AND n <> 0 THEN abs(e) * um / n ELSE 1.0 END AS size_z, CASE WHEN e <> 0 THEN abs(e) * um / 8 ELSE 1.0 END AS size_y, CAST(1.0 AS DOUBLE) AS size_x FROM i")
def v21(s, d):
    k = F.col("c_custkey")
    e = F.when(k % 4 != 0, (k % 5 - 2) * F.lit(0.5))
    info = s.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), e.alias("ext_z"), (k % 7).alias("n_z"), e.alias("ext_y"), F.lit(8).alias("n_y"), F.lit(None).cast("double").alias("ext_x"), F.lit(5).alias("n_x"), F.when(k % 3 == 0, "nm").when(k % 3 == 1, " MM ").alias("unit"))
    return A.voxel_size_um(info).select("id", "size_z", "size_y", "size_x")


@query("v22_contract", f"WITH {_LEVELS} SELECT dataset, level, CASE WHEN dataset % 6 = 0 AND level = 3 THEN 'missing level' WHEN level = 4 THEN 'extra level' WHEN dataset % 6 = 1 THEN 'dtype' WHEN dataset % 6 = 2 AND level = 1 THEN 'axes' WHEN dataset % 6 = 3 THEN 'channels' ELSE 'extent' END AS reason FROM (SELECT dataset, level FROM lv UNION ALL SELECT dataset, 4 FROM lv WHERE level = 0 AND dataset % 6 = 5) WHERE (dataset % 6 = 0 AND level = 3) OR level = 4 OR dataset % 6 = 1 OR (dataset % 6 = 2 AND level = 1) OR dataset % 6 = 3 OR (dataset % 6 = 4 AND level = 2)")
def v22(s, d):
    image = _levels(s, d).select("dataset", "level", F.lit(30).alias("t"), F.lit(2).alias("c"), "z", "y", "x")
    m = F.col("dataset") % 6
    own = image.where(~((m == 0) & (F.col("level") == 3)))
    own = own.unionByName(image.where((F.col("level") == 0) & (m == 5)).withColumn("level", F.lit(4).cast("long")))
    own = own.withColumns({"dtype": F.when(m == 1, "u16").otherwise("u32"), "axes": F.when((m == 2) & (F.col("level") == 1), "tzcyx").otherwise("tczyx"), "c": F.when(m == 3, 2).otherwise(1), "y": F.when((m == 4) & (F.col("level") == 2), F.col("y") + 1).otherwise(F.col("y"))})
    return A.check_contract(own, image)


def _le_bytes(column: str) -> str:
    return ", ".join(f"({column} >> {8 * i}) & 255" for i in range(4))


@query("v23_set_digest", f"WITH {_STAMPS}, bytes AS (SELECT stroke, flatten(list([{_le_bytes('z')}, {_le_bytes('y')}, {_le_bytes('x')}] ORDER BY z, y, x)) AS b FROM sv GROUP BY stroke) SELECT stroke, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), b), lambda h, k: (xor(h, k) * 16777619) & 4294967295) AS digest FROM bytes")
def v23(s, d):
    return L.set_digest(L.rasterize_strokes(_stamps(s, d), (8, 512, 512), (2.0, 1.0, 1.0)), ("stroke",))


@query("v24_segment", "SELECT t, c, z, y, x, CASE WHEN value > 32768 THEN 1 ELSE 0 END AS value FROM image")
def v24(s, d):
    chunks = A.to_chunks(X.image(s, d), (2, 8, 8), (4, 17, 17))
    return A.chunk_voxels(A.segment(chunks, settings(Threshold, {"level": 32768})))


@query("v25_thin_stamps", """WITH p AS (SELECT user_id, n, CAST(z AS DOUBLE) AS z, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CASE WHEN user_id % 4 = 0 THEN 3.5 ELSE z END AS pz FROM base),
walk AS (SELECT user_id, n, z, y, x, 0 AS k, true AS kept, pz AS lz, y AS ly, x AS lx FROM p WHERE n = 1
UNION ALL SELECT b.user_id, b.n, b.z, b.y, b.x, CASE WHEN far THEN w.k + 1 ELSE w.k END, far, CASE WHEN far THEN b.pz ELSE lz END, CASE WHEN far THEN b.y ELSE ly END, CASE WHEN far THEN b.x ELSE lx END
FROM walk w JOIN p b ON b.user_id = w.user_id AND b.n = w.n + 1, LATERAL (SELECT 9 * (4 * (b.z - lz) * (b.z - lz) + (b.y - ly) * (b.y - ly) + (b.x - lx) * (b.x - lx)) >= 16 AS far))
SELECT user_id, k // 4 AS part, n AS seq, lz AS z, ly AS y, lx AS x FROM walk WHERE kept UNION ALL SELECT user_id, k // 4 - 1, n, lz, ly, lx FROM walk WHERE kept AND k > 0 AND k % 4 = 0""")
def v25(s, d):
    """Parts of five points, of which the last begins the next; every fourth user draws on the plane z = 3."""
    flat = F.col("user_id") % 4 == 0
    points = X.base(s, d).select("user_id", F.col("n").cast("long").alias("seq"), *[F.col(a).cast("double").alias(a) for a in "zyx"], F.when(flat, "z").alias("plane_axis"), F.when(flat, 3).alias("plane_index"))
    return L.thin_stamps(points, "user_id", 4.0, (2.0, 1.0, 1.0), 5)


@query("v26_plane_spans", "WITH c AS MATERIALIZED (SELECT t, label, z // 2 AS z, y // 2 AS y, x // 2 AS x FROM voxels WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0), i AS (SELECT *, x - row_number() OVER (PARTITION BY t, label, z, y ORDER BY x) AS g FROM c WHERE z = 2) SELECT t, label, y AS row, min(x) AS a0, max(x) AS a1, 'z' AS axis FROM i GROUP BY t, label, y, g UNION ALL SELECT t, label, z, y, y, 'x' FROM c WHERE x = 100")
def v26(s, d):
    r = X.runs(s, d)
    return L.plane_spans(r, "z", 2, (2, 2, 2)).withColumn("axis", F.lit("z")).unionByName(L.plane_spans(r, "x", 100, (2, 2, 2)).withColumn("axis", F.lit("x")))


@query("s11_narrow_dtype", "SELECT t, CASE WHEN max(label) * 30 < 65536 THEN 'u16' ELSE 'u32' END AS dtype FROM voxels GROUP BY t")
def s11(s, d):
    return L.narrow_dtype(X.runs(s, d).withColumn("label", F.col("label") * 30))


@query("s3_staging_duplicates", "WITH c AS (SELECT id FROM stg_cells UNION ALL SELECT id FROM stg_cells WHERE id % 60 = 0), l AS (SELECT parent, child, side FROM stg_links UNION ALL SELECT parent, child, side FROM stg_links WHERE child % 40 = 0) SELECT 'cell' AS kind, id, NULL AS other, count(*) AS n FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'link on ' || side, parent, child, count(*) FROM l GROUP BY parent, child, side HAVING count(*) > 1")
def s3(s, d):
    c, lk = X.stg_cells(s, d), X.stg_links(s, d)
    return R.staging_duplicates(c.unionByName(c.where("id % 60 = 0")), lk.unionByName(lk.where("child % 40 = 0")))


# --- incremental statistics ------------------------------------------------------------

_EXT = "ext AS (SELECT t, label, area, CAST(sum_z AS BIGINT) AS sum_z, CAST(sum_y AS BIGINT) AS sum_y, CAST(sum_x AS BIGINT) AS sum_x, z0, z1, y0, y1, x0, x1 FROM inventory)"
_DLT = "dt AS (SELECT t, label, -area + CASE WHEN label % 2 = 0 THEN 5 ELSE 0 END - CASE WHEN label % 26 = 1 THEN 9 ELSE 0 END AS area, -sum_z AS sum_z, -sum_y AS sum_y, -sum_x AS sum_x, z0 - 1 AS z0, z1 AS z1, y0 AS y0, y1 + 2 AS y1, x0 AS x0, x1 AS x1 FROM ext WHERE label % 3 = 1)"


def _extent(s, d):
    return L.label_inventory(X.runs(s, d)).select(*E.KEY, "area", *E.SUMS, *E.BOX)


def _extent_deltas(ext):
    area = -F.col("area") + F.when(F.col("label") % 2 == 0, 5).otherwise(0) - F.when(F.col("label") % 26 == 1, 9).otherwise(0)
    return ext.where("label % 3 = 1").select(*E.KEY, area.alias("area"), *[(-F.col(c)).alias(c) for c in E.SUMS], (F.col("z0") - 1).alias("z0"), "z1", "y0", (F.col("y1") + 2).alias("y1"), "x0", "x1")


_FOLDED = "fo AS (SELECT t, label, CAST(sum(area) AS BIGINT) AS area, CAST(CASE WHEN sum(area) = 0 THEN 0 ELSE sum(sum_z) END AS BIGINT) AS sum_z, CAST(CASE WHEN sum(area) = 0 THEN 0 ELSE sum(sum_y) END AS BIGINT) AS sum_y, CAST(CASE WHEN sum(area) = 0 THEN 0 ELSE sum(sum_x) END AS BIGINT) AS sum_x, min(z0) AS z0, max(z1) AS z1, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1, sum(area) < 0 AS error FROM (SELECT * FROM ext UNION ALL SELECT * FROM dt) GROUP BY t, label)"


@query("e1_fold_extents", f"WITH {_EXT}, {_DLT}, {_FOLDED} SELECT * FROM fo")
def e1(s, d):
    """The deltas hold erasures too, whose label is 0."""
    ext = _extent(s, d)
    return E.fold_extents(ext, _extent_deltas(ext).unionByName(ext.where("label % 5 = 0").withColumn("label", F.lit(0).cast("long"))))


@query("e2_ensure_extent", f"WITH {_EXT} SELECT t, label, CASE WHEN label % 2 = 0 THEN -1 ELSE area END AS area, sum_z, sum_y, sum_x, z0, z1, y0, y1, x0, x1 FROM ext WHERE label % 2 = 0 OR label % 3 = 0")
def e2(s, d):
    ext = _extent(s, d)
    have = ext.where("label % 2 = 0").withColumn("area", F.lit(-1).cast("long"))
    return E.ensure_extent(have, X.runs(s, d), ext.where("label % 3 = 0 OR label % 2 = 0").select(*E.KEY))


@query("e3_before_edit", f"WITH {_EDITED}, {_STROKE_DELTAS}, sc AS (SELECT t, new AS label, count(*) AS area, CAST(sum(z) AS BIGINT) AS sum_z, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM nv WHERE new <> 0 GROUP BY t, new), b AS (SELECT sc.t, sc.label, sc.area - coalesce(sd.area, 0) AS area, sc.sum_z - coalesce(sd.sum_z, 0) AS sum_z, sc.sum_y - coalesce(sd.sum_y, 0) AS sum_y, sc.sum_x - coalesce(sd.sum_x, 0) AS sum_x FROM sc LEFT JOIN sd ON sd.t = sc.t AND sd.label = sc.label) SELECT * FROM b")
def e3(s, d):
    after, changes = L.apply_strokes(_runs(s, d), _strokes(s, d))
    return E.before_edit(L.label_inventory(after), L.change_deltas(changes))


@query("e4_upsert_cells", f"WITH {_EXT}, c AS (SELECT id, t, z, y, x, area, state FROM cells WHERE id % 3 <> 0), e AS (SELECT * FROM ext WHERE label % 2 = 0) SELECT coalesce(c.id, e.label) AS id, coalesce(c.t, e.t) AS t, coalesce(e.sum_z / e.area, c.z) AS z, coalesce(e.sum_y / e.area, c.y) AS y, coalesce(e.sum_x / e.area, c.x) AS x, coalesce(e.area, c.area) AS area, c.state FROM c FULL JOIN e ON e.label = c.id")
def e4(s, d):
    c = X.cells(s, d, False).where("id % 3 <> 0").select("id", "t", "z", "y", "x", "area", "state")
    return E.upsert_cells(c, _extent(s, d).where("label % 2 = 0"))


@query("e5_remove_cells", "SELECT 'cell' AS kind, id AS a, t AS b FROM base WHERE id % 9 <> 0 UNION ALL SELECT 'link', parent, child FROM links WHERE parent % 9 <> 0 AND child % 9 <> 0 UNION ALL SELECT 'mask', t, label FROM mask_labels WHERE label % 9 <> 0 UNION ALL SELECT 'lost_cell', id, t FROM base WHERE id % 9 = 0 UNION ALL SELECT 'lost_link', parent, child FROM links WHERE parent % 9 = 0 OR child % 9 = 0")
def e5(s, d):
    b = X.base(s, d)
    out = E.remove_cells(b, X.links(s, d), X.mask_labels(s, d), b.where("id % 9 = 0"))
    parts = [out["cells"].select(F.lit("cell"), "id", "t"), out["links"].select(F.lit("link"), "parent", "child"), out["mask_labels"].select(F.lit("mask"), "t", "label"), out["lost_cells"].select(F.lit("lost_cell"), "id", "t"), out["lost_links"].select(F.lit("lost_link"), "parent", "child")]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.union(p)
    return all_rows.toDF("kind", "a", "b")


@query("e5_apply_extents", f"""WITH {_EXT}, c AS (SELECT id, t, x, area FROM cells WHERE id % 4 <> 0), e AS (SELECT t, label, CASE WHEN label % 6 = 0 THEN 0 ELSE area END AS area, sum_x FROM ext WHERE label % 3 <> 1), k AS (SELECT c.id, c.t, c.x, c.area FROM c WHERE id NOT IN (SELECT label FROM e WHERE area = 0))
SELECT 'cell' AS kind, coalesce(k.id, e.label) AS a, coalesce(k.t, e.t) AS b, coalesce(e.area, k.area) AS area, coalesce(e.sum_x / e.area, k.x) AS x FROM k FULL JOIN (FROM e WHERE area > 0) e ON e.label = k.id
UNION ALL SELECT 'link', parent, child, NULL, NULL FROM links WHERE parent NOT IN (SELECT label FROM e WHERE area = 0) AND child NOT IN (SELECT label FROM e WHERE area = 0)
UNION ALL SELECT 'mask', t, label, NULL, NULL FROM (SELECT t, label FROM mask_labels WHERE label % 5 <> 0 AND (t, label) NOT IN (SELECT (t, label) FROM e WHERE area = 0) UNION SELECT t, label FROM e WHERE area > 0)""")
def e5b(s, d):
    """An edit that wipes every sixth label and touches others, some of them without a cell or a mask label so far."""
    touched = _extent(s, d).where("label % 3 <> 1").withColumn("area", F.when(F.col("label") % 6 == 0, 0).otherwise(F.col("area")).cast("long"))
    out = E.apply_extents(X.cells(s, d, False).where("id % 4 <> 0").select("id", "t", "z", "y", "x", "area"), X.links(s, d), X.mask_labels(s, d).where("label % 5 <> 0"), touched)
    none = [F.lit(None).cast("long"), F.lit(None).cast("double")]
    cells = out["cells"].select(F.lit("cell").alias("kind"), F.col("id").alias("a"), F.col("t").alias("b"), "area", "x")
    return cells.union(out["links"].select(F.lit("link"), "parent", "child", *none)).union(out["mask_labels"].select(F.lit("mask"), "t", "label", *none))


@query("e6_restore_cells", "SELECT 'cell' AS kind, id AS a, t AS b FROM base UNION ALL SELECT 'link', parent, child FROM links UNION ALL SELECT 'mask', t, label FROM (SELECT t, label FROM mask_labels UNION SELECT t, id FROM base WHERE id % 9 = 0)")
def e6(s, d):
    b, lk = X.base(s, d), X.links(s, d)
    out = E.remove_cells(b, lk, X.mask_labels(s, d), b.where("id % 9 = 0"))
    cells, links, mask = E.restore_cells(out["cells"], out["links"], out["mask_labels"], out["lost_cells"], out["lost_links"])
    return cells.select(F.lit("cell").alias("kind"), F.col("id").alias("a"), F.col("t").alias("b")).union(links.select(F.lit("link"), "parent", "child")).union(mask.select(F.lit("mask"), "t", "label"))


@query("e7_import_upsert", """WITH c AS (SELECT id, t, z, y, x, area, detection_confidence, state, src_id - 1 AS src_id, reviewed FROM cells WHERE id % 3 <> 0), f AS (SELECT id, t + 1 AS t, CASE WHEN id % 4 = 0 THEN NULL ELSE z + 0.5 END AS z, state FROM cells WHERE id % 2 = 0)
SELECT coalesce(c.id, f.id) AS id, coalesce(f.t, c.t) AS t, coalesce(f.z, c.z) AS z, c.y, c.area, CASE WHEN f.id IS NOT NULL THEN 'file' ELSE c.state END AS state, CASE WHEN f.id IS NOT NULL THEN f.id ELSE c.src_id END AS src_id, coalesce(c.reviewed, false) AS reviewed FROM c FULL JOIN f ON f.id = c.id""")
def e7(s, d):
    c = X.cells(s, d, False).withColumn("track_id", F.lit(None).cast("long"))
    have = c.where("id % 3 <> 0").withColumn("src_id", F.col("src_id") - 1)
    file = c.where("id % 2 = 0").withColumns({"t": F.col("t") + 1, "z": F.when(F.col("id") % 4 != 0, F.col("z") + 0.5), "y": F.lit(None).cast("double"), "x": F.lit(None).cast("double"), "state": F.lit("file")})
    return E.materialize(file, have).select("id", "t", "z", "y", "area", "state", "src_id", "reviewed")


@query("e8_negate", f"WITH {_EXT}, {_DLT} SELECT t, label, -area AS area, -sum_z AS sum_z, -sum_y AS sum_y, -sum_x AS sum_x, CAST(NULL AS BIGINT) AS z0 FROM dt")
def e8(s, d):
    return E.negate(_extent_deltas(_extent(s, d))).select(*E.KEY, "area", *E.SUMS, "z0")


@query("e9_frame_conflict", f"WITH {_EXT} SELECT e.label, e.t + 1 AS t, b.t AS lives_at FROM ext e JOIN base b ON b.id = e.label WHERE e.label % 4 = 0")
def e9(s, d):
    moved = _extent(s, d).withColumn("t", F.when(F.col("label") % 4 == 0, F.col("t") + 1).otherwise(F.col("t")))
    return E.check_frame(X.base(s, d), moved)


@query("e10_reserve_ids", "SELECT greatest((SELECT max(id) FROM base), (SELECT max(label) FROM mask_labels)) + 1 AS first, greatest((SELECT max(id) FROM base), (SELECT max(label) FROM mask_labels)) + 64 AS last, greatest((SELECT max(id) FROM base), (SELECT max(label) FROM mask_labels)) + 64 <= 16777215 AS ok")
def e10(s, d):
    return R.reserve_ids(X.base(s, d), X.mask_labels(s, d), 0, 64)


@query("e11_import_gate", "SELECT (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM edits WHERE domain = 'graph') AS graph_edits, (SELECT count(*) FROM links) > 0 OR (SELECT count(*) FROM edits WHERE domain = 'graph') > 0 AS blocked")
def e11(s, d):
    return E.import_blocker(X.links(s, d), X.edits(s, d))


@query("e12_validate_staged", f"WITH {_ALL_RULES} SELECT rule, cell_id, message FROM f")
def e12(s, d):
    return R.validate_staged(X.stg_cells(s, d), X.stg_links(s, d), X.mask_labels(s, d))


# --- journal ---------------------------------------------------------------------------


@query("l1_record", "SELECT seq, domain FROM edits WHERE NOT undone UNION ALL SELECT (SELECT max(seq) FROM edits) + 1, 'graph' UNION ALL SELECT -count(*), 'snapshots' FROM blobs WHERE seq IN (SELECT seq FROM edits WHERE NOT undone)")
def l1(s, d):
    e = X.edits(s, d)
    op = e.limit(1).withColumns({"seq": F.lit(1).cast("long"), "domain": F.lit("graph"), "undone": F.lit(False), "pending": F.lit(False)})
    edits, blobs = E.record(e, X.blobs(s, d), op)
    return edits.select("seq", "domain").unionByName(blobs.agg((-F.count("*")).alias("seq")).withColumn("domain", F.lit("snapshots")))


_LIVE = "lw AS (SELECT w.* FROM (SELECT o_orderkey AS seq, o_custkey AS cell, o_orderkey % 1000 AS track, o_orderkey % 30 AS t FROM orders) w JOIN edits e ON e.seq = w.seq WHERE NOT undone AND NOT pending)"


@query("l2_replay", f"WITH {_LIVE} SELECT cell AS id, arg_max(track, seq) AS track_id FROM lw GROUP BY cell")
def l2(s, d):
    w = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 1000).alias("track_id"))
    return E.replay_last(X.edits(s, d), w, "id", "track_id")


@query("l2_replay_extents", f"WITH {_EXT}, dz AS (SELECT ext.*, label AS seq FROM ext WHERE label IN (SELECT seq FROM edits WHERE NOT undone AND NOT pending)) SELECT ext.t, ext.label, ext.area + coalesce(dz.area, 0) AS area, ext.sum_z + coalesce(dz.sum_z, 0) AS sum_z FROM ext LEFT JOIN dz ON dz.label = ext.label AND dz.t = ext.t")
def l2b(s, d):
    ext = _extent(s, d)
    return E.replay_extents(ext, X.edits(s, d), ext.withColumn("seq", F.col("label"))).select("t", "label", "area", "sum_z")


_OP_NAMES = "['late', 'seen', 'treated']"
_OPS = f"""ops AS (SELECT o.seq, CASE o.seq % 9 WHEN 0 THEN 'link' WHEN 1 THEN 'cut' WHEN 2 THEN 'track' WHEN 3 THEN 'label' WHEN 4 THEN 'unlabel' WHEN 5 THEN 'track_label' WHEN 6 THEN 'track_unlabel' WHEN 7 THEN 'remove' ELSE 'restore' END AS kind, o.id,
CASE o.seq % 9 WHEN 0 THEN o.id + 1 + o.seq % 2 WHEN 1 THEN CASE WHEN o.seq % 2 = 0 THEN k.child ELSE o.id + 1 END ELSE o.seq % 1000 END AS other, [{_OP_NAMES}[o.seq % 3 + 1]] AS names FROM (SELECT o_orderkey AS seq, o_custkey AS id FROM orders) o LEFT JOIN (SELECT parent, min(child) AS child FROM links GROUP BY parent) k ON k.parent = o.id),
lv AS (SELECT ops.* FROM ops JOIN edits e ON e.seq = ops.seq WHERE NOT e.undone AND NOT e.pending),
life AS (SELECT id, arg_max(kind, seq) = 'remove' AS dead, max(CASE WHEN kind = 'remove' THEN seq END) AS rm, max(CASE WHEN kind = 'restore' THEN seq END) AS rs, arg_max(CASE WHEN kind = 'restore' THEN names END, CASE WHEN kind = 'restore' THEN seq END) AS rn FROM lv WHERE kind IN ('remove', 'restore') GROUP BY id),
tr AS (SELECT id, arg_max(other, seq) AS track FROM lv WHERE kind IN ('track', 'restore') GROUP BY id),
nm AS (SELECT lv.id, kind LIKE 'track%' AS scope, names[1] AS name, arg_max(kind NOT LIKE '%unlabel', lv.seq) AS has FROM lv LEFT JOIN life ON life.id = lv.id WHERE kind LIKE '%label' AND (kind LIKE 'track%' OR rs IS NULL OR lv.seq > rs) GROUP BY ALL),
st AS (SELECT id, scope, list(name) FILTER (has) AS put, list(name) FILTER (NOT has) AS cut FROM nm GROUP BY id, scope),
lw AS (SELECT id AS parent, other AS child, arg_max(kind, seq) AS kind, max(seq) AS seq FROM lv WHERE kind IN ('link', 'cut') AND other IS NOT NULL GROUP BY id, other)"""


@query("l2_replay_graph", f"""WITH {_OPS} SELECT 'cell' AS kind, c.id AS a, CASE WHEN tr.id IS NOT NULL THEN tr.track ELSE c.track_id END AS b, array_to_string(CASE WHEN s0.id IS NULL THEN CASE WHEN rs IS NOT NULL THEN rn ELSE list_sort(coalesce(c.labels, [])) END ELSE list_sort(list_distinct(list_concat(list_filter(CASE WHEN rs IS NOT NULL THEN rn ELSE coalesce(c.labels, []) END, lambda x: NOT list_contains(coalesce(s0.cut, []), x)), coalesce(s0.put, [])))) END, ',') AS labels,
array_to_string(CASE WHEN s1.id IS NULL THEN coalesce(c.track_labels, []) ELSE list_sort(list_distinct(list_concat(list_filter(coalesce(c.track_labels, []), lambda x: NOT list_contains(coalesce(s1.cut, []), x)), coalesce(s1.put, [])))) END, ',') AS track_labels
FROM cells c LEFT JOIN life ON life.id = c.id LEFT JOIN tr ON tr.id = c.id LEFT JOIN st s0 ON s0.id = c.id AND NOT s0.scope LEFT JOIN st s1 ON s1.id = c.id AND s1.scope WHERE NOT coalesce(life.dead, false)
UNION ALL SELECT 'link', coalesce(l.parent, lw.parent), coalesce(l.child, lw.child), '', '' FROM links l FULL JOIN lw ON lw.parent = l.parent AND lw.child = l.child LEFT JOIN life p ON p.id = coalesce(l.parent, lw.parent) LEFT JOIN life q ON q.id = coalesce(l.child, lw.child)
WHERE CASE WHEN lw.seq IS NULL THEN p.rm IS NULL AND q.rm IS NULL ELSE lw.kind = 'link' AND greatest(coalesce(p.rm, 0), coalesce(q.rm, 0)) < lw.seq END""")
def l2c(s, d):
    """A journal with every kind of graph edit, folded into cells and links."""
    c, lk = X.cells(s, d), X.links(s, d)
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"))
    first = lk.groupBy(F.col("parent").alias("id")).agg(F.min("child").alias("first"))
    k = F.col("seq") % 9
    kinds = ["link", "cut", "track", "label", "unlabel", "track_label", "track_unlabel", "remove", "restore"]
    other = F.when(k == 0, F.col("id") + 1 + F.col("seq") % 2).when(k == 1, F.when(F.col("seq") % 2 == 0, F.col("first")).otherwise(F.col("id") + 1)).otherwise(F.col("seq") % 1000)
    names = F.array(F.element_at(F.array(*map(F.lit, ("late", "seen", "treated"))), (F.col("seq") % 3 + 1).cast("int")))
    ops = o.join(first, "id", "left").select("seq", F.lit(0).alias("step"), F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")).alias("kind"), "id", other.alias("other"), F.lit(None).cast("double").alias("value"), names.alias("names"))
    ops = ops.where("kind NOT IN ('link', 'cut') OR other IS NOT NULL")
    cells, links = E.replay_graph(c.withColumn("labels", F.array_sort("labels")), lk, X.edits(s, d), ops)
    one = cells.select(F.lit("cell").alias("kind"), F.col("id").alias("a"), F.col("track_id").alias("b"), _joined("labels").alias("labels"), _joined("track_labels").alias("track_labels"))
    return one.union(links.select(F.lit("link"), "parent", "child", F.lit(""), F.lit("")))


@query("l3_recover_replaced", "WITH ck AS (SELECT DISTINCT seq % 3 AS dataset, chunk_key, 'now ' || chunk_key AS data FROM blobs), sn AS (SELECT seq % 3 AS dataset, chunk_key, arg_min(existed, seq) AS existed, arg_min(before, seq) AS data FROM blobs WHERE seq % 3 = 1 AND seq IN (SELECT seq FROM edits WHERE pending) GROUP BY ALL) SELECT dataset, chunk_key, data FROM ck WHERE (dataset, chunk_key) NOT IN (SELECT (dataset, chunk_key) FROM sn) UNION ALL SELECT dataset, chunk_key, data FROM sn WHERE existed")
def l3b(s, d):
    """Three movies: only the second one's store is still the one its inventory covers."""
    movie = F.col("seq") % 3
    b = X.blobs(s, d).withColumn("dataset", movie)
    stores = s.createDataFrame([(0, "a", "b"), (1, "c", "c"), (2, None, "d")], "dataset long, store string, covered string")
    return E.recover(X.edits(s, d).withColumn("dataset", movie), b.select("dataset", "chunk_key", F.concat(F.lit("now "), "chunk_key").alias("data")).distinct(), b, stores)


@query("l3_recover_levels", """WITH lvl0 AS (SELECT t, z, y, x, label FROM voxels WHERE NOT (y % 8 = 4 AND label % 2 = 0)), hit AS (SELECT DISTINCT t, z, y FROM voxels WHERE y % 8 = 4)
SELECT 0 AS level, t, z, y, x, label FROM voxels UNION ALL SELECT 1, t, z, y // 2, x // 4, label FROM voxels WHERE y % 2 = 0 AND x % 4 = 0 AND (t, z, y) IN (SELECT (t, z, y) FROM hit) UNION ALL SELECT 1, t, z, y // 2, x // 4, -label FROM lvl0 WHERE y % 2 = 0 AND x % 4 = 0 AND (t, z, y) NOT IN (SELECT (t, z, y) FROM hit)""")
def l3c(s, d):
    """Pending strokes took the even labels from every eighth row; coarse rows that no stroke touched keep what they have, here negative labels."""
    whole = X.runs(s, d)
    hit = (F.col("y") % 8 == 4)
    now = whole.where(~(hit & (F.col("label") % 2 == 0)))
    coarse = L.regenerate_coarse(now, (1, 2, 4)).withColumn("label", -F.col("label"))
    runs = now.withColumn("level", F.lit(0)).unionByName(coarse.withColumn("level", F.lit(1)))
    before = whole.where(hit).groupBy("t", "z", "y").agg(F.collect_list(F.struct("x0", "x1", "label")).alias("spans")).withColumn("seq", F.lit(1).cast("long"))
    edits = s.createDataFrame([(1, True)], "seq long, pending boolean")
    return L.explode_runs(E.recover_runs(edits, runs, before, [(1, (1, 2, 4))])).select("level", "t", "z", "y", "x", "label")


@query("l3_recover", "WITH ck AS (SELECT DISTINCT chunk_key, 'now ' || chunk_key AS data FROM blobs), sn AS (SELECT chunk_key, arg_min(existed, seq) AS existed, arg_min(before, seq) AS data FROM blobs WHERE seq IN (SELECT seq FROM edits WHERE pending) GROUP BY chunk_key) SELECT chunk_key, data FROM ck WHERE chunk_key NOT IN (SELECT chunk_key FROM sn) UNION ALL SELECT chunk_key, data FROM sn WHERE existed")
def l3(s, d):
    b = X.blobs(s, d)
    return E.recover(X.edits(s, d), b.select("chunk_key", F.concat(F.lit("now "), "chunk_key").alias("data")).distinct(), b)


@query("l4_journal_marks", "SELECT seq, CASE WHEN seq % 4 = 0 THEN true ELSE undone END AS undone FROM edits WHERE seq % 5 <> 0")
def l4(s, d):
    e = X.edits(s, d)
    marked = E.mark_undone(e, e.where("seq % 4 = 0"), True)
    return E.delete_edits(marked, X.blobs(s, d), e.where("seq % 5 = 0"))[0].select("seq", "undone")


@query("l5_versions", "SELECT counter, count(*) AS version FROM (SELECT CASE WHEN domain = 'mask' THEN 'labels' ELSE domain END AS counter FROM edits WHERE NOT pending UNION ALL SELECT 'graph' FROM edits WHERE NOT pending AND domain = 'mask' AND seq % 6 = 0) GROUP BY counter")
def l5(s, d):
    return E.versions(X.edits(s, d).withColumn("touches_cells", F.col("seq") % 6 == 0))


# --- scalar functions --------------------------------------------------------------------


def _customer(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))


def _pick(values: list, key: str = "id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: list) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[c_custkey % {len(values)} + 1]"


_AXES = ["t", "Time", " channel ", "CH", "depth", "z", "Y", "x", "q", ""]


@query("f1_axis_slot", f"SELECT c_custkey AS id, CASE lower(trim({_pick_sql(_AXES)})) WHEN 't' THEN 0 WHEN 'time' THEN 0 WHEN 'c' THEN 1 WHEN 'channel' THEN 1 WHEN 'ch' THEN 1 WHEN 'z' THEN 2 WHEN 'depth' THEN 2 WHEN 'y' THEN 3 WHEN 'x' THEN 4 END AS slot FROM customer")
def f1(s, d):
    return _customer(s, d).select("id", S.axis_slot(_pick(_AXES)).alias("slot"))


_UNITS = ["nm", " Millimetre", "CM", "m", "angstrom", "um", "parsec"]


@query("f2_unit_factor", f"SELECT c_custkey AS id, CAST(CASE lower(trim({_pick_sql(_UNITS)})) WHEN 'nm' THEN 1e-3 WHEN 'millimetre' THEN 1e3 WHEN 'cm' THEN 1e4 WHEN 'm' THEN 1e6 WHEN 'angstrom' THEN 1e-4 ELSE 1 END AS DOUBLE) AS factor FROM customer")
def f2(s, d):
    return _customer(s, d).select("id", S.unit_micrometres(_pick(_UNITS)).alias("factor"))


@query("f3_scale_product", "SELECT c_custkey AS id, c_custkey * CAST(1.5 AS DOUBLE) AS a, c_custkey * CAST(0.25 AS DOUBLE) AS b FROM customer")
def f3(s, d):
    inner, outer = F.array(F.col("id") * F.lit(0.5), F.col("id") * F.lit(0.25)), F.array(F.lit(3.0))
    scale = S.combine_scales(inner, outer)
    return _customer(s, d).select("id", scale[0].alias("a"), scale[1].alias("b"))


@query("f4_channel_defaults", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'GFP' ELSE 'Channel ' || (c_custkey + 1) END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'AB12CD' ELSE (['FF0000', '00FF00', '0000FF', 'FFFF00', 'FF00FF', '00FFFF'])[c_custkey % 6 + 1] END AS color FROM customer")
def f4(s, d):
    return _customer(s, d).select("id", S.channel_name(F.when(F.col("id") % 3 == 0, "GFP"), F.col("id")).alias("name"), S.channel_color(F.when(F.col("id") % 4 == 0, "#ab12cd"), F.col("id")).alias("color"))


_KINDS = ["u8", "u16", "u32"]


@query("f4_channel_windows", f"""WITH w AS (SELECT c_custkey AS id, CASE {_pick_sql(_KINDS)} WHEN 'u8' THEN 255.0 WHEN 'u16' THEN 65535.0 ELSE 4294967295.0 END AS full_range FROM customer), k AS (SELECT id, CAST(CASE WHEN id % 2 = 0 THEN id ELSE 0 END AS DOUBLE) AS least, CAST(CASE WHEN id % 3 = 0 THEN id + 50 ELSE full_range END AS DOUBLE) AS most FROM w)
SELECT id, least, most, CASE WHEN id % 5 = 0 THEN id + 1.5 ELSE least END AS start, CASE WHEN id % 7 = 0 THEN id + 9.5 ELSE most END AS stop FROM k""")
def f4b(s, d):
    """Limits and windows of which some are stored, and some of those are not finite."""
    k, none = F.col("id"), F.lit(None).cast("double")
    w = S.channel_window(F.when(k % 2 == 0, k), F.when(k % 3 == 0, k + 50), F.when(k % 5 == 0, k + 1.5).otherwise(float("nan")), F.when(k % 7 == 0, k + 9.5).when(k % 11 == 0, float("inf")).otherwise(none), _pick(_KINDS))
    return _customer(s, d).select("id", w.alias("w")).select("id", "w.*")


_NAMES = [" a ", "", "  ", "ESI", "cell type 1 "]


@query("f5_label_name", f"SELECT c_custkey AS id, nullif(trim({_pick_sql(_NAMES)}), '') AS name FROM customer")
def f5(s, d):
    return _customer(s, d).select("id", S.label_name(_pick(_NAMES)).alias("name"))


_COLORS = ["#AABBCC", " #aaBBdd ", "#abc", "red", "#00ff7F", "#12345g"]


@query("f6_label_color", f"SELECT c_custkey AS id, CASE WHEN regexp_full_match(trim({_pick_sql(_COLORS)}), '#[0-9a-fA-F]{{6}}') THEN lower(trim({_pick_sql(_COLORS)})) END AS color FROM customer")
def f6(s, d):
    return _customer(s, d).select("id", S.label_color(_pick(_COLORS)).alias("color"))


_LABEL_JSON = ['["a","b"]', "[]", None, '["x y"]']


@query("f7_label_json", "SELECT c_custkey AS id, (['a|b', '', '', 'x y'])[c_custkey % 4 + 1] AS names, (['[\"a\",\"b\"]', NULL, NULL, '[\"x y\"]'])[c_custkey % 4 + 1] AS text FROM customer")
def f7(s, d):
    names = S.labels_of_json(_pick(_LABEL_JSON))
    return _customer(s, d).select("id", F.array_join(names, "|").alias("names"), S.json_of_labels(names).alias("text"))


@query("f8_op_scope", "SELECT seq, coalesce(json_extract_string(op, '$.scope'), json_extract_string(op, '$.kind')) AS scope FROM edits")
def f8(s, d):
    return X.edits(s, d).select("seq", S.op_scope(F.col("op")).alias("scope"))


@query("f9_signed_labels", "SELECT c_custkey AS id, '+a, +n' || c_custkey || ', −b' AS text FROM customer")
def f9(s, d):
    return _customer(s, d).select("id", S.signed_labels(F.array(F.lit("a"), F.concat(F.lit("n"), "id")), F.array(F.lit("b"))).alias("text"))


@query("f10_snapshot_name", "WITH b AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stem FROM orders), k AS (SELECT id, stem, row_number() OVER (PARTITION BY stem ORDER BY id) AS k FROM b) SELECT id, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END AS name FROM k")
def f10(s, d):
    stem = F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "[^0-9A-Za-z]", "")
    out = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), stem.alias("stem"))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("id"))
    return out.withColumn("k", k).select("id", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", "k")).alias("name"))


@query("f11_palette_index", "SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE (least(id * 5000, 16777215) - 1) % 1024 END AS slot FROM base")
def f11(s, d):
    return X.base(s, d).select("id", S.palette_index(F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("id") * 5000)).alias("slot"))


@query("f12_default_color", "SELECT DISTINCT event_type AS name, list_reduce(list_concat([0::BIGINT], list_transform(string_split(event_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 8 AS slot FROM events")
def f12(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name")).distinct().select("name", S.default_label_color(F.col("name")).alias("slot"))


_HEX_COLORS = {"0.5 0.25 1": "8040FF", "0.5 0.25": "804000", " 1 ": "FF0000", "0.1 0.2 0.3 0.9": "1A334C", "2 -1 0.5": "FF0080", "": "000000", "0.5 red 1": None, "nan 0 0": None}


@query("f13_color_hex", f"SELECT c_custkey AS id, {_pick_sql(list(_HEX_COLORS.values()))} AS color FROM customer")
def f13(s, d):
    return _customer(s, d).select("id", S.color_hex(_pick(list(_HEX_COLORS))).alias("color"))


_STAMPS_TEXT = {
    "2024-01-02 03:04:05": "2024/01/02 03:04:05.000000", "yesterday": None, "2024-13-01 00:00:00": None, "2023-12-31T23:59:59.25": "2023/12/31 23:59:59.250000", "2024-02-29": "2024/02/29 00:00:00.000000", "20240102T0304": "2024/01/02 03:04:00.000000",
    " 2024-01-02T03:04:05.123456789 ": "2024/01/02 03:04:05.123456", "2024-01-02T03:04:05+02:00": "2024/01/02 01:04:05.000000", "2024-01-02T03:04:05Z": "2024/01/02 03:04:05.000000", "2024-W01-2": "2024/01/02 00:00:00.000000", "2024": None, "2023-02-29": None,
}


@query("f14_timestamp", f"SELECT c_custkey AS id, {_pick_sql(list(_STAMPS_TEXT.values()))} AS at FROM customer")
def f14(s, d):
    return _customer(s, d).select("id", F.date_format(S.parse_timestamp(_pick(list(_STAMPS_TEXT))), "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("at"))


@query("f15_chunk_key", "SELECT c_custkey AS id, '2/c/' || c_custkey || '/0/1/' || c_custkey % 7 || '/3' AS key, c_custkey AS t, c_custkey % 7 AS gy FROM customer")
def f15(s, d):
    key = S.chunk_key(F.lit(2), F.lit("c"), F.col("id"), F.lit(1), F.col("id") % 7, F.lit(3))
    return _customer(s, d).select("id", key.alias("key")).select("id", "key", S.chunk_key_parts(F.col("key")).alias("p")).select("id", "key", "p.t", "p.gy")


@query("f16_grid", f"WITH {_LEVELS} SELECT dataset, level, greatest(1, CAST(ceil(x / cx) AS BIGINT)) AS n, least(cx, x - (greatest(1, CAST(ceil(x / cx) AS BIGINT)) - 1) * cx) AS last FROM lv")
def f16(s, d):
    n = S.grid_size(F.col("x"), F.col("cx"))
    return _levels(s, d).select("dataset", "level", n.alias("n"), S.clipped(F.col("x"), F.col("cx"), n - 1).alias("last"))


@query("f17_ratio", "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN c_custkey / 1e-13 WHEN 2 THEN 1.0 WHEN 3 THEN c_custkey / 0.5 ELSE 1.0 END AS r FROM customer")
def f17(s, d):
    k = F.col("id") % 5
    below = F.when(k == 0, 0.0).when(k == 1, 1e-13).when(k == 2, 1e-16).when(k == 3, 0.5).otherwise(float("inf"))
    return _customer(s, d).select("id", S.ratio(F.col("id").cast("double"), below).alias("r"))
