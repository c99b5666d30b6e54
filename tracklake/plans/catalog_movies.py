"""Queries over many movies at once: seven with ids that begin anew in each, every family of operators by ``dataset``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import arrays as A
from tracklake.operators import edits as E
from tracklake.operators import graph as G
from tracklake.operators import labels as L
from tracklake.operators import linking as K
from tracklake.operators import relational as R
from tracklake.plans import fixtures as X
from tracklake.plans.catalog import query
from tracklake.plans.staging import fresh_folder, staged
from tracklake.sources import stores


@query("m_p1_cells_window", "SELECT c.dataset, c.id, c.t, c.y, c.x, c.state, l.parent AS parent_id FROM mcells c LEFT JOIN mlinks l ON l.dataset = c.dataset AND l.child = c.id WHERE c.t BETWEEN 3 AND 20 AND c.y BETWEEN 50 AND 400 AND c.x BETWEEN 20 AND 420")
def mp1(s, d):
    return R.cells_window(X.movie_cells(s, d), X.movie_links(s, d), 3, 20, (50, 400, 20, 420)).select("dataset", "id", "t", "y", "x", "state", "parent_id")


_BROKEN = """mst AS (SELECT dataset, CASE WHEN child % 97 = 2 THEN parent + 100000000 WHEN child % 97 = 3 THEN child ELSE parent END AS parent, CASE WHEN child % 97 = 1 THEN child + 100000000 WHEN child % 97 = 3 THEN parent ELSE child END AS child, CASE WHEN child % 97 = 5 THEN 1.5 ELSE confidence END AS confidence FROM mlinks)"""


@query("m_e12_validate_staged", f"""WITH {_BROKEN} SELECT dataset, 'dangling_child' AS rule, parent AS cell_id, 'names missing cell ' || child AS message FROM mst WHERE (dataset, child) NOT IN (SELECT (dataset, id) FROM mcells)
UNION ALL SELECT DISTINCT l.dataset, 'not_forward', l.child, 'on frame ' || c.t || ' its parent ' || l.parent || ' on ' || p.t FROM mst l JOIN mcells p ON p.dataset = l.dataset AND p.id = l.parent JOIN mcells c ON c.dataset = l.dataset AND c.id = l.child WHERE c.t <= p.t
UNION ALL SELECT dataset, 'many_children', parent, count(DISTINCT child) || ' children' FROM mst GROUP BY dataset, parent HAVING count(DISTINCT child) > 2
UNION ALL SELECT dataset, 'many_parents', child, count(DISTINCT parent) || ' parents' FROM mst GROUP BY dataset, child HAVING count(DISTINCT parent) > 1
UNION ALL SELECT DISTINCT dataset, 'link_confidence', parent, 'link to ' || child FROM mst WHERE confidence > 1""")
def me12(s, d):
    fault = F.col("child") % 97
    parent = F.when(fault == 2, F.col("parent") + 100000000).when(fault == 3, F.col("child")).otherwise(F.col("parent"))
    child = F.when(fault == 1, F.col("child") + 100000000).when(fault == 3, F.col("parent")).otherwise(F.col("child"))
    links = X.movie_links(s, d).select("dataset", parent.alias("parent"), child.alias("child"), F.when(fault == 5, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.lit("children").alias("side"))
    cells = X.movie_cells(s, d).select("dataset", "id", "t", F.lit(0.9).alias("confidence"), "track_id")
    return R.validate_staged(cells, links)


@query("m_j11_overlap_costs", """WITH ov AS (SELECT a.dataset, a.t AS t1, b.t AS t2, a.label AS label1, b.label AS label2, count(*) AS overlap FROM mvoxels a JOIN mvoxels b ON a.dataset = b.dataset AND b.t = a.t + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY ALL)
SELECT ov.dataset, t1, t2, label1, label2, overlap, overlap / p.area AS ratio_1, overlap / q.area AS ratio_2 FROM ov JOIN minventory p ON p.dataset = ov.dataset AND p.label = label1 JOIN minventory q ON q.dataset = ov.dataset AND q.label = label2 WHERE 1.0 + (-1.0) * (overlap / q.area) <= 0.9""")
def mj11(s, d):
    return K.overlap_costs(staged(X.movie_runs(s, d), "runs")).select("dataset", "t1", "t2", "label1", "label2", "overlap", "ratio_1", "ratio_2")


@query("m_j12_distance_candidates", """WITH near AS (SELECT a.dataset, a.id AS id1, b.id AS id2, (a.z-b.z)*(a.z-b.z) + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) AS d2 FROM mcells a JOIN mcells b ON a.dataset = b.dataset AND b.t = a.t + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL)
SELECT dataset, id1, id2, d2 FROM (SELECT *, row_number() OVER (PARTITION BY dataset, id2 ORDER BY d2, id1) AS k FROM near WHERE d2 <= 900) WHERE k <= 3""")
def mj12(s, d):
    return K.distance_candidates(X.movie_cells(s, d), 30.0, 3).select("dataset", "id1", "id2", "d2")


@query("m_a1_label_inventory", "SELECT * FROM minventory")
def ma1(s, d):
    return L.label_inventory(X.movie_runs(s, d))


@query("m_a6_graph_summary", "WITH k AS (SELECT dataset, parent, count(*) AS n FROM mlinks GROUP BY dataset, parent) SELECT c.dataset, count(*) AS cells, count(DISTINCT track_id) AS tracks, (SELECT count(*) FROM mlinks l WHERE l.dataset = c.dataset) AS links, (SELECT count(*) FROM k WHERE k.dataset = c.dataset AND n = 2) AS divisions FROM mcells c GROUP BY c.dataset")
def ma6(s, d):
    return R.graph_summary(X.movie_cells(s, d), X.movie_links(s, d))


@query("m_a15_track_spans", """WITH cp AS (SELECT c.dataset, c.id, c.t, coalesce(c.track_id, c.id) AS track, l.parent FROM mcells c LEFT JOIN mlinks l ON l.dataset = c.dataset AND l.child = c.id)
SELECT a.dataset, a.track, min(a.t) AS first, max(a.t) AS last, arg_min(CASE WHEN p.track <> a.track THEN p.track END, CASE WHEN p.track <> a.track THEN a.t * 100000000 + a.id END) AS parent FROM cp a LEFT JOIN cp p ON p.dataset = a.dataset AND p.id = a.parent GROUP BY a.dataset, a.track""")
def ma15(s, d):
    return G.track_spans(G.with_parent(X.movie_cells(s, d), X.movie_links(s, d)))


@query("m_w1_sequential_ids", "SELECT c.dataset, c.id * 10 + 3 AS src, row_number() OVER (PARTITION BY c.dataset ORDER BY c.t, h.head, c.id) AS id FROM mcells c JOIN mchains h ON h.dataset = c.dataset AND h.id = c.id")
def mw1(s, d):
    c = X.movie_cells(s, d)
    heads = G.chains(c, X.movie_links(s, d)).select("dataset", "id", F.col("head").alias("track"))
    return K.assign_ids(c.join(heads, ["dataset", "id"]).select("dataset", (F.col("id") * 10 + 3).alias("src"), "track", "t"))


@query("m_w6_merge_runs", "WITH v AS (SELECT DISTINCT dataset, t, z, y, x FROM mvoxels), i AS (SELECT *, x - row_number() OVER (PARTITION BY dataset, t, z, y ORDER BY x) AS g FROM v) SELECT dataset, t, z, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY dataset, t, z, y, g")
def mw6(s, d):
    r = X.movie_runs(s, d).select("dataset", "t", "z", "y", "x0", "x1")
    return L.merge_runs(r.unionByName(r.where("x0 % 2 = 0")), ("t", "z", "y"))


@query("m_k1_review_queue", "SELECT dataset, parent, child, confidence, reviewed FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY reviewed, confidence ASC NULLS LAST, parent, child) AS k FROM mlinks) WHERE k <= 5")
def mk1(s, d):
    return R.review_queue(X.movie_links(s, d), 5)


@query("m_u1_max_label", "SELECT dataset, max(id) AS max_id FROM mids GROUP BY dataset")
def mu1(s, d):
    runs = X.movie_runs(s, d)
    return R.max_label_id(X.movie_cells(s, d), runs.select("dataset", "t", "label").distinct())


@query("m_g1_chains", "SELECT dataset, id, head, pos, count(*) OVER (PARTITION BY dataset, head) AS length FROM mchains")
def mg1(s, d):
    return G.chains(X.movie_cells(s, d), X.movie_links(s, d))


@query("m_g2_lineage", "WITH r AS (SELECT a.dataset, a.id, h.id AS root, r.depth FROM roots r JOIN mids a ON a.gid = r.id JOIN mids h ON h.gid = r.root) SELECT * FROM r WHERE (dataset, root) IN (SELECT (dataset, root) FROM r WHERE id % 20 = 0)")
def mg2(s, d):
    c = X.movie_cells(s, d)
    return G.lineage(c, X.movie_links(s, d), c.where("id % 20 = 0"))[0].select("dataset", "id", "root", "depth")


@query("m_g6_cut", """WITH aft AS (SELECT * FROM mlinks WHERE child % 8 <> 0), akids AS (SELECT dataset, parent, count(*) AS n FROM aft GROUP BY dataset, parent),
ach(dataset, id, head) AS (SELECT b.dataset, b.id, b.id FROM mids b LEFT JOIN aft l ON l.dataset = b.dataset AND l.child = b.id LEFT JOIN akids k ON k.dataset = l.dataset AND k.parent = l.parent WHERE l.parent IS NULL OR k.n > 1
UNION ALL SELECT l.dataset, l.child, c.head FROM ach c JOIN akids k ON k.dataset = c.dataset AND k.parent = c.id AND k.n = 1 JOIN aft l ON l.dataset = c.dataset AND l.parent = c.id),
ch AS (SELECT dataset, parent, child FROM mlinks WHERE child % 8 = 0), seeds AS (SELECT dataset, parent AS id FROM ch UNION SELECT dataset, child FROM ch UNION SELECT dataset, child FROM aft WHERE (dataset, parent) IN (SELECT (dataset, parent) FROM ch)),
tou AS (SELECT DISTINCT dataset, head FROM ach WHERE (dataset, id) IN (SELECT (dataset, id) FROM seeds)),
hd AS (SELECT t.dataset, t.head, CASE WHEN h.pos = 0 THEN c.track_id END AS kept FROM tou t JOIN mchains h ON h.dataset = t.dataset AND h.id = t.head JOIN mcells c ON c.dataset = t.dataset AND c.id = t.head),
top AS (SELECT dataset, max(track_id) AS top FROM mcells GROUP BY dataset),
ids AS (SELECT hd.dataset, head, coalesce(kept, top + row_number() OVER (PARTITION BY hd.dataset, kept IS NULL ORDER BY head)) AS new FROM hd JOIN top ON top.dataset = hd.dataset)
SELECT a.dataset, a.id, c.track_id AS old, i.new FROM ach a JOIN ids i ON i.dataset = a.dataset AND i.head = a.head JOIN mcells c ON c.dataset = a.dataset AND c.id = a.id""")
def mg6(s, d):
    """Every movie draws fresh ids from a counter of its own."""
    c, lk = X.movie_forest(s, d)
    return G.graph_cut(c, lk, lk.where("child % 8 = 0").select("dataset", "parent", "child"), G.next_track_id(c))[1]


@query("m_g12_lineage_layout", """WITH paths AS (SELECT m.dataset, m.id AS root, m.id, m.t, m.t AS top, [m.t * 1000000000 + m.id] AS path FROM mids m LEFT JOIN mlinks l ON l.dataset = m.dataset AND l.child = m.id WHERE l.parent IS NULL
UNION ALL SELECT p.dataset, p.root, m.id, m.t, p.top, list_append(p.path, m.t * 1000000000 + m.id) FROM paths p JOIN mlinks l ON l.dataset = p.dataset AND l.parent = p.id JOIN mids m ON m.dataset = l.dataset AND m.id = l.child),
leaves AS (SELECT dataset, id, row_number() OVER (PARTITION BY dataset, root ORDER BY path) - 1 AS col FROM paths WHERE (dataset, id) NOT IN (SELECT (dataset, parent) FROM mlinks)),
ends AS (SELECT DISTINCT dataset, parent, unnest([arg_min(child, path), arg_max(child, path)]) AS child, CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM (SELECT l.*, c.path FROM mlinks l JOIN paths c ON c.dataset = l.dataset AND c.id = l.child) GROUP BY dataset, parent),
reach AS (SELECT dataset, id, id AS down, 1.0::DOUBLE AS weight FROM paths UNION ALL SELECT r.dataset, r.id, e.child, r.weight * e.share FROM reach r JOIN ends e ON e.dataset = r.dataset AND e.parent = r.down)
SELECT p.dataset, p.root, p.id, w.col, p.t - p.top AS row FROM paths p JOIN (SELECT r.dataset, r.id, sum(r.weight * v.col) AS col FROM reach r JOIN leaves v ON v.dataset = r.dataset AND v.id = r.down GROUP BY r.dataset, r.id) w ON w.dataset = p.dataset AND w.id = p.id""")
def mg12(s, d):
    c, lk = staged(X.movie_cells(s, d).select("dataset", "id", "t"), "cells"), staged(X.movie_links(s, d), "links")
    return G.lineage_layout(c.join(G.tree_roots(c, lk), ["dataset", "id"]), lk)


@query("m_v7_rechunk", "SELECT 'm' || t % 7 AS dataset, t // 7 AS t, c, z, y, x, value FROM image")
def mv7(s, d):
    sizes = s.range(7).select(F.concat(F.lit("m"), "id").alias("dataset"), *[F.lit(n).cast("long").alias(a) for a, n in zip("zyx", (4, 17, 17), strict=True)])
    return A.chunk_voxels(A.rechunk(A.to_chunks(X.movie_image(s, d), (2, 8, 8), sizes), (3, 10, 20), sizes))


@query("m_v11_apply_strokes", "SELECT dataset, t, z, y, x, CASE WHEN label % 3 = 0 AND y % 2 = 0 THEN label + 500000 ELSE label END AS label FROM mvoxels WHERE NOT (label % 3 = 1 AND y % 2 = 0)")
def mv11(s, d):
    """The even rows of each third label are painted with another, those of the next third erased by strokes that take their own label only."""
    runs = staged(X.movie_runs(s, d), "runs")
    own = runs.where("y % 2 = 0 AND label % 3 < 2")
    paint = F.col("label") % 3 == 0
    strokes = own.select("dataset", "t", "z", "y", "x0", "x1", F.col("label").alias("seq"), F.when(paint, "paint").otherwise("scoped").alias("mode"), (F.col("label") + 500000).alias("label"), F.col("label").alias("only"))
    return L.explode_runs(L.apply_strokes(runs, strokes)[0]).select("dataset", "t", "z", "y", "x", "label")


@query("m_v17_outline", """WITH st AS (SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0), n AS (SELECT p.dataset, p.t, p.z, p.y AS oy, p.x AS ox, p.label AS owner, p.y + dy AS y, p.x + dx AS x FROM mvoxels p, st WHERE p.y + dy BETWEEN 0 AND 511 AND p.x + dx BETWEEN 0 AND 511),
o AS (SELECT n.*, q.label FROM n LEFT JOIN mvoxels q ON q.dataset = n.dataset AND q.t = n.t AND q.z = n.z AND q.y = n.y AND q.x = n.x WHERE q.label IS NULL OR q.label <> owner)
SELECT dataset, t, z, y, x, min(owner) AS owner FROM (SELECT dataset, t, z, oy AS y, ox AS x, owner FROM o UNION ALL SELECT dataset, t, z, y, x, owner FROM o WHERE label IS NULL) GROUP BY dataset, t, z, y, x""")
def mv17(s, d):
    return L.label_outline(staged(X.movie_runs(s, d), "runs"), (512, 512))


@query("m_e1_fold_extents", "SELECT dataset, t, label, CASE WHEN label % 3 = 1 THEN 0 ELSE area END AS area, CASE WHEN label % 3 = 1 THEN 0 ELSE sum_x END AS sum_x, x0, x1 FROM minventory")
def me1(s, d):
    ext = L.label_inventory(X.movie_runs(s, d)).select("dataset", *E.KEY, "area", *E.SUMS, *E.BOX)
    return E.fold_extents(ext, E.negate(ext.where("label % 3 = 1"))).select("dataset", "t", "label", "area", "sum_x", "x0", "x1")


@query("m_e4_upsert_cells", "SELECT coalesce(c.dataset, e.dataset) AS dataset, coalesce(c.id, e.label) AS id, coalesce(e.sum_x / e.area, c.x) AS x, coalesce(e.area, c.area) AS area, c.state FROM (SELECT * FROM mcells WHERE id % 3 <> 0) c FULL JOIN (SELECT * FROM minventory WHERE label % 2 = 0) e ON e.dataset = c.dataset AND e.label = c.id")
def me4(s, d):
    c = X.movie_cells(s, d).where("id % 3 <> 0").select("dataset", "id", "t", "z", "y", "x", "area", "state")
    return E.upsert_cells(c, L.label_inventory(X.movie_runs(s, d)).where("label % 2 = 0")).select("dataset", "id", "x", "area", "state")


@query("m_e5_remove_cells", "SELECT dataset, 'link' AS kind, parent AS a, child AS b FROM mlinks WHERE parent % 9 <> 0 AND child % 9 <> 0 UNION ALL SELECT dataset, 'lost', parent, child FROM mlinks WHERE parent % 9 = 0 OR child % 9 = 0 UNION ALL SELECT dataset, 'cell', id, t FROM mcells WHERE id % 9 <> 0")
def me5(s, d):
    c = X.movie_cells(s, d)
    out = E.remove_cells(c, X.movie_links(s, d), X.movie_runs(s, d).select("dataset", "t", "label").distinct(), c.where("id % 9 = 0"))
    rows = out["links"].select("dataset", F.lit("link").alias("kind"), F.col("parent").alias("a"), F.col("child").alias("b")).union(out["lost_links"].select("dataset", F.lit("lost"), "parent", "child"))
    return rows.union(out["cells"].select("dataset", F.lit("cell"), "id", "t"))


@query("m_l2_replay", "SELECT dataset, id, arg_max(track, seq) AS track_id FROM (SELECT 'm' || o_orderkey % 7 AS dataset, o_orderkey // 7 AS seq, o_custkey % 50 AS id, o_orderkey % 1000 AS track FROM orders) w JOIN medits e USING (dataset, seq) WHERE NOT undone AND NOT pending GROUP BY dataset, id")
def ml2(s, d):
    key = F.col("o_orderkey")
    writes = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("m"), key % 7).alias("dataset"), F.expr("o_orderkey div 7").alias("seq"), (F.col("o_custkey") % 50).alias("id"), (key % 1000).alias("track_id"))
    return E.replay_last(X.movie_edits(s, d), writes, "id", "track_id")


@query("m_l5_versions", "SELECT dataset, counter, count(*) AS version FROM (SELECT dataset, CASE WHEN domain = 'mask' THEN 'labels' ELSE domain END AS counter FROM medits WHERE NOT pending UNION ALL SELECT dataset, 'graph' FROM medits WHERE NOT pending AND domain = 'mask' AND seq % 6 = 0) GROUP BY ALL")
def ml5(s, d):
    return E.versions(X.movie_edits(s, d).withColumn("touches_cells", F.col("seq") % 6 == 0))


@query("m_s10_chunk_sink", "SELECT 'm' || t % 7 AS dataset, t // 7 AS t, c, z, y, x, value FROM image WHERE t % 7 = 3")
def ms10(s, d):
    """Chunks of all movies are written by movie; one is read back."""
    path = fresh_folder(s, "movie-chunks")
    stores.write_chunks(A.to_chunks(X.movie_image(s, d), (4, 17, 9), (4, 17, 17)), path)
    return A.chunk_voxels(stores.read_written_chunks(s, path, "string").where("dataset = 'm3'"))
