"""Hand-made cases: values worked out on paper or stated by the format."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import scalars as S
from tracklake.functions.settings import Threshold, settings
from tracklake.operators import arrays as A
from tracklake.operators import edits as E
from tracklake.operators import graph as G
from tracklake.operators import labels as L
from tracklake.operators import linking as K
from tracklake.operators import relational as R
from tracklake.sources import manifest, stores, tracking
from tracklake.streaming import streams as T


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def seeded(spark):
    """Chain 1-2-3, division at 3 into 4 and 5, 4 goes on to 6; 7 has no centroid."""
    cells = spark.createDataFrame(
        [(1, 0, 1.0, 1.0, 1.0, 10), (2, 1, 1.0, 1.0, 2.0, 10), (3, 2, 1.0, 1.0, 3.0, 10), (4, 3, 1.0, 2.0, 3.0, 11), (5, 3, 1.0, 3.0, 3.0, 12), (6, 4, 1.0, 2.0, 4.0, 11), (7, 4, None, None, None, None)],
        "id long, t long, z double, y double, x double, track_id long",
    )
    links = spark.createDataFrame([(1, 2, 0.9, False), (2, 3, 0.2, False), (3, 4, None, False), (3, 5, 0.5, True), (4, 6, 0.99, False)], "parent long, child long, confidence double, reviewed boolean")
    return cells, links


def test_chains_and_lineage(seeded):
    cells, links = seeded
    assert rows(G.chains(cells, links), "id") == [(1, 1, 0, 3), (2, 1, 1, 3), (3, 1, 2, 3), (4, 4, 0, 2), (5, 5, 0, 1), (6, 4, 1, 2), (7, 7, 0, 1)]
    members, edges = G.lineage(cells, links, cells.where("id = 6").select("id"))
    assert [r[0] for r in rows(members.select("id"), "id")] == [1, 2, 3, 4, 5, 6] and edges.count() == 5
    with pytest.raises(ValueError, match="unknown cell 99"):
        G.lineage(cells, links, cells.select((F.col("id") + 98).alias("id")).where("id = 99"))


def test_cycle_is_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        G.pointer_double(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, up long"), limit=5)


def test_review_queue_puts_reviewed_and_null_last(seeded):
    assert [tuple(r)[:2] for r in R.review_queue(seeded[1], 10).collect()] == [(2, 3), (1, 2), (4, 6), (3, 4), (3, 5)]


def test_cut_keeps_the_parent_side_and_draws_a_fresh_id(spark, seeded):
    cells, links = seeded
    after, moves = G.graph_cut(cells, links, spark.createDataFrame([(2, 3)], "parent long, child long"), 20)
    assert after.count() == 4
    assert rows(moves, "id") == [(1, 10, 10), (2, 10, 10), (3, 10, 20)]
    with pytest.raises(ValueError, match="no link"):
        G.graph_cut(cells, links, spark.createDataFrame([(1, 6)], "parent long, child long"), 20)


def test_link_makes_a_division_and_heads_the_sibling_anew(spark, seeded):
    cells, links = seeded
    after, moves = G.graph_link(cells, links, spark.createDataFrame([(1, 4, 7)], "seq long, parent long, child long"), 20)
    assert after.count() == 6
    # 6 and 7 become heads: 6 was none before and 7 never had an id
    assert rows(moves, "id") == [(4, 11, 11), (6, 11, 20), (7, None, 21)]


def test_delta_replays_and_undoes_exactly(spark, seeded):
    cells, links = seeded
    after, moves = G.graph_cut(cells, links, spark.createDataFrame([(2, 3)], "parent long, child long"), 20)
    change = G.diff_links(links, after)
    done = G.apply_delta(links, moves, cells, change, False)
    back = G.apply_delta(done[0], moves, done[1], change, True)
    assert rows(back[0].select(links.columns), "parent", "child") == rows(links, "parent", "child")
    assert rows(back[1].select(cells.columns), "id") == rows(cells, "id")


def test_link_reasons(spark, seeded):
    cells, links = seeded
    p = spark.createDataFrame([(1, 1, 99), (2, 6, 1), (3, 1, 2), (4, 1, 3), (5, 3, 7), (6, 5, 7)], "seq long, parent long, child long")
    assert [r[3] for r in rows(G.validate_links(p, cells, links, 5), "seq")] == ["unknown_cell", "not_forward", "duplicate", "has_parent", "two_children", "has_parent"]


def test_stamp_counts_of_the_shared_contract(spark):
    stamp = spark.createDataFrame([(1, 3.5, 12.25, 15.75, 3.0)], "stroke long, cz double, cy double, cx double, r double")
    r = L.stamp_runs(stamp, (8, 32, 32))
    n, z0, z1, y0, y1, x0, x1 = r.agg(F.sum(F.expr("x1 - x0 + 1")), F.min("z"), F.max("z"), F.min("y"), F.max("y"), F.min("x0"), F.max("x1")).first()
    assert (n, z0, z1, y0, y1, x0, x1) == (106, 1, 5, 9, 14, 13, 18)
    coarse = L.regenerate_coarse(r, (1, 2, 2))
    assert coarse.agg(F.sum(F.expr("x1 - x0 + 1"))).first()[0] == 29
    assert L.stamp_runs(stamp.withColumn("r", F.lit(0.0)), (8, 32, 32)).count() == 0


def test_coarse_of_union_is_union_of_coarse(spark):
    stamps = spark.createDataFrame([(1, 3.5, 12.0, 15.0, 4.0), (1, 3.5, 14.0, 18.5, 3.0)], "stroke long, cz double, cy double, cx double, r double")
    parts = L.stamp_runs(stamps.withColumn("stamp", F.col("cx")), (8, 32, 32)).select("z", "y", "x0", "x1")
    a = L.regenerate_coarse(L.merge_runs(parts), (1, 2, 2))
    b = L.merge_runs(L.regenerate_coarse(parts, (1, 2, 2)))
    assert rows(L.merge_runs(a), "z", "y", "x0") == rows(b, "z", "y", "x0")


def test_strokes_fold_in_order(spark):
    runs = spark.createDataFrame([(0, 0, 0, 0, 9, 5)], "t long, z long, y long, x0 long, x1 long, label long")
    strokes = spark.createDataFrame([(0, 0, 0, 2, 5, 1, "paint", 7, None), (0, 0, 0, 4, 7, 2, "scoped", None, 7), (0, 0, 0, 9, 12, 3, "paint", 8, None)], "t long, z long, y long, x0 long, x1 long, seq long, mode string, label long, only long")
    after, changes = L.apply_strokes(runs, strokes)
    assert rows(after.select("x0", "x1", "label"), "x0") == [(0, 1, 5), (2, 3, 7), (6, 8, 5), (9, 12, 8)]
    assert rows(L.change_deltas(changes).select("label", "area"), "label") == [(5, -5), (7, 2), (8, 4)]


def test_extent_rules(spark):
    cols = "t long, label long, area long, sum_z long, sum_y long, sum_x long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long"
    have = spark.createDataFrame([(0, 1, 5, 5, 5, 5, 0, 1, 0, 1, 0, 1), (0, 2, 1, 9, 9, 9, 0, 0, 0, 0, 0, 0)], cols)
    delta = spark.createDataFrame([(0, 1, -5, -1, -1, -1, None, None, None, None, None, None), (0, 2, -3, 0, 0, 0, 5, 6, 0, 0, 0, 0)], cols)
    out = {r.label: r for r in E.fold_extents(have, delta).collect()}
    assert (out[1].area, out[1].sum_z, out[1].z1, out[1].error) == (0, 0, 1, False)
    assert (out[2].area, out[2].z1, out[2].error) == (-2, 6, True)
    assert E.fold_extents(have, E.negate(delta)).where("label = 1").first().z1 == 1
    erased = delta.where("label = 2").withColumn("label", F.lit(0).cast("long"))
    assert sorted(r.label for r in E.fold_extents(have, delta.unionByName(erased)).collect()) == [1, 2]


def test_offenders_are_children_and_stand_once(spark):
    cells = spark.createDataFrame([(1, 5, 0.5, 1, None), (2, 5, 0.5, 1, None)], "id long, t long, confidence double, track_id long, seg_id long")
    links = spark.createDataFrame([(1, 2, 0.5, "children"), (1, 2, 0.5, "children"), (1, 2, 0.25, "parent"), (1, 9, 0.5, "children"), (1, 9, 0.5, "children"), (8, 2, 0.5, "parent"), (8, 2, 0.5, "parent")], "parent long, child long, confidence double, side string")
    found = rows(R.validate_staged(cells, links).select("rule", "cell_id"), "rule")
    assert found == [("dangling_child", 1), ("dangling_parent", 2), ("many_parents", 2), ("not_forward", 2), ("sides_disagree", 2)]


def test_edit_takes_away_restores_and_publishes(spark):
    cells = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 4), (2, 1, 2.0, 2.0, 2.0, 4), (3, 2, 3.0, 3.0, 3.0, 4)], "id long, t long, z double, y double, x double, area long")
    links = spark.createDataFrame([(1, 2, 0.5, False), (2, 3, 0.5, False)], "parent long, child long, confidence double, reviewed boolean")
    mask = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 2)], "t long, label long")
    touched = spark.createDataFrame([(1, 2, 0, 0, 0, 0), (2, 3, 2, 2, 4, 6), (4, 5, 1, 7, 8, 9), (0, 0, 3, 0, 0, 0)], "t long, label long, area long, sum_z long, sum_y long, sum_x long")
    out = E.apply_extents(cells, links, mask, touched)
    assert rows(out["cells"].select("id", "t", "x", "area"), "id") == [(1, 0, 1.0, 4), (3, 2, 3.0, 2), (5, 4, 9.0, 1)]
    assert out["links"].count() == 0 and rows(out["mask_labels"], "t") == [(0, 1), (2, 3), (4, 5), (7, 2)]  # label 2 of another frame stays
    again = spark.createDataFrame([(1, 2, 0.75, True)], links.schema)  # made anew since: not overwritten
    both = out["lost_links"].unionByName(out["lost_links"])
    back, kept, marks = E.restore_cells(out["cells"], again, out["mask_labels"], out["lost_cells"], both)
    assert rows(kept, "parent") == [(1, 2, 0.75, True), (2, 3, 0.5, False)]
    assert rows(back.where("id = 2"), "id") == [(2, 1, 2.0, 2.0, 2.0, 4)] and (1, 2) in rows(marks, "t")
    journal = spark.createDataFrame([(1, "mask")], "seq long, domain string")
    blobs = spark.createDataFrame([(1, "k")], "seq long, chunk_key string")
    twice = touched.where("label = 5").unionByName(touched.where("label = 5").withColumn("t", F.lit(3).cast("long"))).withColumns({c: F.lit(0).cast("long") for c in ("z0", "z1", "y0", "y1", "x0", "x1")})
    new = L.publish_inventory(twice, cells, journal, blobs)
    assert rows(new["cells"].where("id = 5").select("id", "t"), "id") == [(5, 3)] and new["mask_labels"].count() == 2


def test_new_links_are_not_reviewed_and_states_cover_the_vocabulary(spark):
    cells = spark.createDataFrame([(1, 0, None, ["a"], ["b"]), (2, 1, None, None, ["b"]), (3, 2, None, None, None)], "id long, t long, track_id long, labels array<string>, track_labels array<string>")
    none = spark.createDataFrame([], "parent long, child long, confidence double, reviewed boolean")
    after, _ = G.graph_link(cells, none, spark.createDataFrame([(1, 1, 2)], "seq long, parent long, child long"), 1)
    assert rows(after, "parent") == [(1, 2, None, False)]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    states = G.label_states(cells, G.chains(cells, after), cells.where("id <> 2"), names)
    assert rows(states, "id", "name") == [(1, "a", True, "none"), (1, "b", False, "all"), (1, "c", False, "none"), (3, "a", False, "none"), (3, "b", False, "none"), (3, "c", False, "none")]


def test_import_replaces_features_and_history_has_pending_edits(spark):
    schema = "id long, t long, z double, y double, x double, detection_confidence double, state string, track_id long, src_id long, seg_id long, labels array<string>, track_labels array<string>, features string, reviewed boolean, area long"
    have = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, None, "normal", None, None, None, None, None, "old", True, 9)], schema)
    file = spark.createDataFrame([(1, 2, None, None, None, 0.5, "dead", 4, None, None, ["a"], None, "new", None, None)], schema)
    r = E.materialize(file, have).first()
    assert (r.t, r.z, r.features, r.reviewed, r.area, r.src_id, r.labels) == (2, 1.0, "new", True, 9, 1, ["a"])
    edits = spark.createDataFrame([(1, "x", "mask", '{"kind": "stroke"}', False, False), (2, "y", "mask", '{"kind": "clear", "scope": "cell"}', False, True)], "seq long, ts string, domain string, op string, undone boolean, pending boolean")
    blobs = spark.createDataFrame([(2, "k")], "seq long, chunk_key string")
    assert [tuple(h) for h in R.edit_history(edits, blobs).orderBy("seq").collect()] == [(1, "x", "mask", "stroke", False, False), (2, "y", "mask", "cell", False, True)]


def test_mutual_best_and_split(spark):
    c = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 11, 3.0), (1, 12, 2.5)], "parent long, child long, cost double")
    assert rows(K.link_mutual_best(c, 5.0).select("parent", "child"), "parent") == [(1, 10)]
    assert rows(K.link_mutual_best(c, 5.0, 5.0).select("parent", "child", "kind"), "child") == [(1, 10, "link"), (1, 11, "split")]


def test_histogram_of_chunks_equals_long_form(spark):
    v = spark.range(2 * 4 * 20 * 20).select(F.lit(0).cast("long").alias("t"), F.expr("id div 1600").alias("c"), F.expr("id div 400 % 4").alias("z"), F.expr("id div 20 % 20").alias("y"), F.expr("id % 20").alias("x"), ((F.col("id") * 977) % 65536).alias("value"))
    chunks = A.to_chunks(v, (2, 16, 16), (4, 20, 20))
    assert rows(A.chunk_histogram(chunks), "c", "bin") == rows(A.histogram(v).select("t", "c", "bin", "n"), "c", "bin")
    assert A.rechunk(chunks, (4, 20, 20), (4, 20, 20)).count() == 2


def test_documents_are_read_and_bad_ones_named(spark, tmp_path):
    good = {"format": tracking.FORMAT, "version": 1, "metadata": {"a": "b"}, "cells": [{"id": 1, "t": 0, "centroid": [1, 2, 3], "children": [{"id": 2, "confidence": 0.5}]}, {"id": 2, "t": 1, "parent": {"id": 1, "confidence": 0.25}, "labels": []}]}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json.gz").write_bytes(gzip.compress(json.dumps(good).encode()))
    cells, links, report = tracking.stage(tracking.read_tracking(spark, str(tmp_path / "good"))[1])
    assert rows(links, "side") == [(1, 2, 0.5, "children"), (1, 2, 0.25, "parent")]
    assert rows(R.validate_staged(cells, links).select("rule", "cell_id"), "rule") == [("sides_disagree", 2)]
    assert tuple(report.first()) == (2, 2, 2, 2)
    for name, fault, change in (("f", "wrong format", {"format": "x"}), ("v", "wrong version", {"version": 2}), ("m", "no metadata", {"metadata": None}), ("c", "cells are no array", {"cells": None})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=fault):
            tracking.read_tracking(spark, str(tmp_path / name))
    late = {"format": tracking.FORMAT, "metadata": {}, "cells": [], "version": 1}
    (tmp_path / "late").mkdir()
    (tmp_path / "late" / "a.json").write_text(json.dumps(late))
    with pytest.raises(ValueError, match="no version before cells"):
        tracking.read_tracking(spark, str(tmp_path / "late"))


def test_negative_tracker_csv(spark, tmp_path):
    head = "track_id,t,z,y,x,id,parent_track_id,parent_id\n"
    for name, body, fault in (("twice", "1,0,0,0,0,5,-1,-1\n1,1,0,0,0,5,-1,-1\n", "repeated"), ("lost", "1,0,0,0,0,5,-1,9\n", "missing parent")):
        (tmp_path / name).write_text(head + body)
        with pytest.raises(ValueError, match=fault):
            tracking.read_tracker_csv(spark, str(tmp_path / name))


def test_store_catalog_and_chunks(spark, tmp_path):
    for version in ("v2", "v3"):
        group = tmp_path / f"{version}.zarr"
        (group / "0").mkdir(parents=True)
        scales = [{"axes": [{"name": a} for a in "tczyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 2.0, 0.5, 0.5]}]}]}]
        omero = {"channels": [{"label": "GFP", "color": "00FF00", "window": {"start": 0, "end": 100}}]}
        if version == "v2":
            (group / ".zattrs").write_text(json.dumps({"multiscales": scales, "omero": omero}))
            (group / "0" / ".zarray").write_text(json.dumps({"shape": [1, 1, 2, 3, 5], "chunks": [1, 1, 2, 2, 4], "dtype": "<u2"}))
        else:
            (group / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {"ome": {"multiscales": scales, "omero": omero}}}))
            (group / "0" / "zarr.json").write_text(json.dumps({"node_type": "array", "shape": [1, 1, 2, 3, 5], "data_type": "uint16", "chunk_grid": {"configuration": {"chunk_shape": [1, 1, 2, 2, 4]}}}))
        a = np.arange(16, dtype="<u2").reshape(1, 1, 2, 2, 4)
        name = "0.0.0.0.0" if version == "v2" else "c/0/0/0/0/0"
        (group / "0" / name).parent.mkdir(parents=True, exist_ok=True)
        (group / "0" / name).write_bytes(a.tobytes())
        edge = "0.0.0.1.1" if version == "v2" else "c/0/0/0/1/1"
        (group / "0" / edge).parent.mkdir(parents=True, exist_ok=True)
        (group / "0" / edge).write_bytes(gzip.compress(a.tobytes()))
    levels, channels = stores.catalog(spark, str(tmp_path))
    assert sorted((tuple(r.shape), tuple(r.chunks), r.dtype, tuple(r.axes), tuple(r.scale)) for r in levels.collect()) == [((1, 1, 2, 3, 5), (1, 1, 2, 2, 4), "u16", tuple("tczyx"), (1.0, 1.0, 2.0, 0.5, 0.5))] * 2
    assert {(r.label, r.color, r.high) for r in channels.collect()} == {("GFP", "00FF00", 100.0)}
    chunks = stores.read_chunks(levels)
    assert chunks.count() == 4  # two of either version
    assert rows(chunks.select("gy", "gx", "nz", "ny", "nx").distinct(), "gy") == [(0, 0, 2, 2, 4), (1, 1, 2, 1, 1)]
    assert rows(A.chunk_voxels(chunks).where("y = 2").select("z", "value").distinct(), "z") == [(0, 0), (1, 8)]


def test_faults_of_stores_are_named(spark, tmp_path):
    for name in ("empty", "bare", "dangling/0"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "bare" / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {}}))
    scales = [{"axes": [{"name": a} for a in "yx"], "datasets": [{"path": "0"}, {"path": "1"}]}]
    (tmp_path / "dangling" / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {"ome": {"multiscales": scales}}}))
    (tmp_path / "dangling" / "0" / "zarr.json").write_text(json.dumps({"node_type": "array", "shape": [3, 5], "data_type": "uint8", "chunk_grid": {"configuration": {"chunk_shape": [3, 5]}}}))
    found = stores.faults(spark, [str(tmp_path / n) for n in ("gone", "empty", "bare", "dangling")])
    assert {(r.root.rsplit("/", 1)[1], r.fault, (r.detail or "").rsplit("/", 1)[-1]) for r in found.collect()} == {("gone", "missing path", ""), ("empty", "no store", ""), ("bare", "no multiscales", ""), ("dangling", "missing level", "1")}
    levels, _ = stores.catalog(spark, str(tmp_path / "dangling"))
    assert levels.count() == 1


def test_settings_name_wrong_keys():
    assert settings(Threshold, {"level": 7}) == Threshold(7, 1)
    with pytest.raises(ValueError, match="unknown keys: blur, sigma; missing keys: level"):
        settings(Threshold, {"sigma": 1, "blur": 2})


def test_stack_of_planes(spark, tmp_path):
    for i in (2, 0, 1):
        np.save(tmp_path / f"p{i}.npy", np.full((2, 3), i, np.uint16))
    assert [(r.t, list(r.shape), np.frombuffer(r.data, r.dtype)[0]) for r in stores.read_stack(spark, str(tmp_path)).orderBy("t").collect()] == [(i, [2, 3], i) for i in range(3)]


def test_rejected_files_are_not_published(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "t": 0, "children": [{"id": 9}]}\n')
    (tmp_path / "in" / "b.json").write_text('{"id": 1, "t": 0, "children": [{"id": 2}]}\n{"id": 2, "t": 1}\n')
    to = str(tmp_path / "out")
    T.ingest_tracking(spark, str(tmp_path / "in"), to)
    assert rows(manifest.table(spark, to, "cells").select("id"), "id") == [(1,), (2,)] and manifest.table(spark, to, "links").count() == 1
    assert [r.rule for r in manifest.table(spark, to, "faults").collect()] == ["dangling_child"]


def test_table_sets_swap_whole_and_replays_do_nothing(spark, tmp_path, monkeypatch):
    to = str(tmp_path / "set")
    one = spark.createDataFrame([(1,)], "id long")
    assert manifest.publish(spark, to, {"a": one, "b": one}, "s", 0, store="first", append=True)
    assert manifest.publish(spark, to, {"a": one}, "s", 1, append=True)
    assert not manifest.publish(spark, to, {"a": one}, "s", 1, append=True)
    assert (manifest.table(spark, to, "a").count(), manifest.table(spark, to, "b").count(), manifest.store_of(spark, to)) == (2, 1, "first")

    def dies(*_):
        raise OSError("killed between the tables and the manifest")

    with monkeypatch.context() as m:
        m.setattr(manifest, "_commit", dies)
        with pytest.raises(OSError):
            manifest.publish(spark, to, {"a": one, "b": one}, "s", 2, append=True)
    assert (manifest.table(spark, to, "a").count(), manifest.table(spark, to, "b").count()) == (2, 1)
    assert manifest.publish(spark, to, {"a": one, "b": one}, "s", 2, append=True)
    assert (manifest.table(spark, to, "a").count(), manifest.table(spark, to, "b").count()) == (3, 2)
    now = manifest._newest(spark, to)
    with pytest.raises(RuntimeError, match="another writer"):
        manifest._commit(spark, to, now)
    assert manifest.publish(spark, to, {"a": one}) and manifest.table(spark, to, "a").count() == 1
    assert manifest.table(spark, to, "none", "id long").count() == 0


def test_late_edits_are_dropped_by_the_watermark(spark, tmp_path):
    for i, days in enumerate((["2024-01-20"], ["2024-01-21"], ["2024-01-01", "2024-01-22"])):  # a watermark counts from the batch after next
        (tmp_path / f"{i}.json").write_text("".join(json.dumps({"domain": "mask", "ts": f"{d}T00:00:00"}) + "\n" for d in days))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema("domain string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out = T.run_available(T.edit_activity(stream, "7 days"), mode="update")
    assert out.where("start < '2024-01-10'").count() == 0 and out.count() >= 1


def test_digest_is_fnv1a(spark):
    runs = spark.createDataFrame([(1, 0, 0, 1, 1)], "stroke long, z long, y long, x0 long, x1 long")
    h = 0x811C9DC5
    for b in b"\0" * 8 + b"\1\0\0\0":
        h = (h ^ b) * 0x01000193 % 2**32
    assert L.set_digest(runs, ("stroke",)).first().digest == h


def test_thinning_keeps_moves_from_the_last_kept_point(spark):
    p = spark.createDataFrame([(1, i, 0.0, 0.0, x) for i, x in enumerate((0.0, 0.5, 0.9, 1.1, 1.5, 2.2))], "stroke long, seq long, z double, y double, x double")
    assert [r.x for r in L.thin_stamps(p, "stroke", 3.0).orderBy("seq").collect()] == [0.0, 1.1, 2.2]


def test_thinned_strokes_begin_where_the_last_one_ended(spark):
    p = spark.createDataFrame([(1, i, 0.25, 0.0, 2.0 * i, "z", 4) for i in range(7)], "stroke long, seq long, z double, y double, x double, plane_axis string, plane_index long")
    out = rows(L.thin_stamps(p, "stroke", 3.0, limit=4).select("part", "seq", "z"), "part", "seq")
    assert out == [(0, 0, 4.5), (0, 1, 4.5), (0, 2, 4.5), (0, 3, 4.5), (1, 3, 4.5), (1, 4, 4.5), (1, 5, 4.5), (1, 6, 4.5), (2, 6, 4.5)]


def test_thinning_carries_a_path_over_batches(spark):
    p = spark.createDataFrame([(s, i, 0.0, 0.0, 0.4 * i) for s in (1, 2) for i in range(50)], "stroke long, seq long, z double, y double, x double")
    want = rows(L.thin_stamps(p, "stroke", 3.0), "stroke", "part", "seq")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(L.thin_stamps(p, "stroke", 3.0), "stroke", "part", "seq") == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_layout_centres_parents(seeded):
    cells, links = seeded
    members = cells.join(G.tree_roots(cells, links), "id")
    assert rows(G.lineage_layout(members, links).select("id", "col", "row"), "id") == [(1, 0.5, 0), (2, 0.5, 1), (3, 0.5, 2), (4, 0.0, 3), (5, 1.0, 3), (6, 0.0, 4), (7, 0.0, 0)]


def test_shown_tracks_end_on_degenerate_cycles(spark):
    spans = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 1, 3), (3, 0, 1, 1), (4, 5, 9, 3), (5, 5, 9, None), (6, 0, 2, None)], "track long, first long, last long, parent long")
    assert rows(G.shown_tracks(spans, 6), "track") == [(1,), (2,), (3,), (4,), (5,)]


# --- cases where a plain reading of the format goes wrong -------------------------------------


def test_axes_by_alias_convention_and_order(spark):
    stores_of = [
        (1, ["time", "depth", "y", "x"], None, [2, 3, 4, 5]), (2, ["tile", "cat", "yak", "xor"], None, [2, 3, 4, 5]), (3, None, None, [2, 3, 4, 5]), (4, None, ["z", "y", "x"], [3, 4, 5]), (5, None, ["q", "y", "x"], [3, 4, 5]),
        (6, ["y", "x", "z"], None, [3, 4, 5]), (7, ["z", "depth", "y", "x"], None, [1, 2, 3, 4]), (8, ["ch", " Y ", "X"], None, [7, 8, 9]), (9, ["z", "y"], None, [1, 2]), (10, None, None, [1, 1, 1, 1, 1, 1]), (11, ["y", "x"], None, [1, 2, 3]),
    ]
    out = {r.id: (r.axes, r.ok, r.t, r.c, r.z, r.y, r.x) for r in A.resolve_axes(spark.createDataFrame(stores_of, "id long, names array<string>, dim_names array<string>, shape array<bigint>")).collect()}
    assert out[1] == ("tzyx", True, 2, 1, 3, 4, 5) and out[3] == ("czyx", True, 1, 2, 3, 4, 5) and out[4][:2] == ("zyx", True) and out[5][:2] == ("zyx", True) and out[8] == ("cyx", True, 1, 7, 1, 8, 9)
    assert [k for k, v in out.items() if not v[1]] == [2, 6, 7, 9, 10, 11]


def test_factors_fall_back_for_all_axes_at_once(spark):
    cols = "dataset string, level long, z long, y long, x long, scale_z double, scale_y double, scale_x double"
    levels = spark.createDataFrame([("a", 0, 8, 64, 64, None, 0.5, 0.5), ("a", 1, 8, 32, 30, None, 1.0, 1.0), ("b", 0, 8, 64, 64, 2.0, 0.5, 0.5), ("b", 1, 8, 32, 16, 2.0, float("nan"), 1.0), ("b", 2, 0, 16, 8, 2.0, 2.0, 4.0)], cols)
    assert rows(A.level_factors(levels).where("level > 0"), "dataset", "level") == [("a", 1, 1.0, 2.0, 2.0), ("b", 1, 1.0, 2.0, 4.0), ("b", 2, 1.0, 4.0, 8.0)]


def test_sizes_intervals_and_ratios(spark):
    info = spark.createDataFrame([(0.0, 4, -3.0, 6, 5.0, 0, "um")], "ext_z double, n_z long, ext_y double, n_y long, ext_x double, n_x long, unit string")
    assert tuple(A.voxel_size_um(info).select("size_z", "size_y", "size_x").first()) == (1.0, 0.5, 1.0)
    stamps = spark.createDataFrame([("a", k, f"2024-01-01 00:00:{s:02d}" if s is not None else None) for k, s in enumerate((10, 0, 4, None, 30, 31))] + [("b", 0, "2024-01-01 00:00:00")], "dataset string, k long, at string")
    assert rows(R.frame_interval(stamps), "dataset") == [("a", 2.5), ("b", 1.0)]
    voxels = spark.createDataFrame([(0, 0, z, 0, 0, v) for z, v in ((0, 5), (1, 0))], "t long, c long, z long, y long, x long, value long")
    assert [A.choose_z_size(voxels, n, 2).first().z_size for n in (9, 0, None, 2, 1)] == [2, 2, 2, 2, 1]
    assert A.choose_z_size(voxels.withColumn("value", F.lit(1)), 1, 2).first().z_size == 2
    one = spark.range(1)
    assert [one.select(S.ratio(F.lit(2.0), F.lit(b))).first()[0] for b in (1e-13, 1e-16, 0.0, float("inf"))] == [2.0 / 1e-13, 1.0, 1.0, 1.0]


def test_colours_and_stamps_of_time(spark):
    def color(text):
        return spark.range(1).select(S.color_hex(F.lit(text).cast("string"))).first()[0]

    assert [color(x) for x in ("1 0.5", "0.1 0.2 0.3 9 9", "", "2 -1 0.002", "a 0 0", None)] == ["FF8000", "1A334C", "000000", "FF0001", None, None]

    def at(text):
        return spark.range(1).select(F.date_format(S.parse_timestamp(F.lit(text).cast("string")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]

    assert [at(x) for x in ("2024-03-01T02:03:04.5", "2024-03-01 02:03", "20240301", "2024-03-01T02:03:04,25+0130", "2020-W53-7")] == ["2024-03-01 02:03:04.500000", "2024-03-01 02:03:00.000000", "2024-03-01 00:00:00.000000", "2024-03-01 00:33:04.250000", "2021-01-03 00:00:00.000000"]
    assert [at(x) for x in ("2024-02-30", "2024-1-1", "noon", "", "2024-01-01T25:00", None)] == [None] * 6


# --- stores ------------------------------------------------------------------------------------


def _store(path, array, chunks, names=None, version=3, axes=None):
    """A store of one level; ``axes`` go to the group, ``names`` to the array."""
    (path / "0").mkdir(parents=True)
    kinds = {"uint16": "<u2", "uint32": "<u4", "uint8": "|u1"}
    scales = [{"axes": [{"name": a} for a in axes], "datasets": [{"path": "0"}]}] if axes else None
    if version == 3:
        (path / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {"ome": {"multiscales": scales}} if scales else {}}))
        (path / "0" / "zarr.json").write_text(json.dumps({"node_type": "array", "shape": array.shape, "data_type": str(array.dtype), "chunk_grid": {"configuration": {"chunk_shape": chunks}}, "dimension_names": names}))
    else:
        (path / ".zattrs").write_text(json.dumps({"multiscales": scales} if scales else {}))
        (path / "0" / ".zarray").write_text(json.dumps({"shape": array.shape, "chunks": chunks, "dtype": kinds[str(array.dtype)], "dimension_separator": "/"}))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunks, strict=True)]):
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        full = np.zeros(chunks, array.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        file = path / "0" / ("c/" if version == 3 else "") / "/".join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(full.tobytes())


@pytest.mark.parametrize(("axes", "shape", "chunks", "kind", "version"), [("tzyx", (3, 4, 5, 6), [2, 2, 3, 4], "uint32", 3), ("zyx", (3, 5, 6), [2, 3, 4], "uint16", 2), ("yx", (5, 6), [3, 4], "uint8", 3), ("tcyx", (3, 2, 5, 6), [1, 2, 3, 4], "uint16", 2), ("tczyx", (2, 2, 3, 4, 5), [2, 1, 2, 2, 3], "uint16", 3)])
def test_stores_of_two_to_five_axes_read_whole(spark, tmp_path, axes, shape, chunks, kind, version):
    array = np.arange(np.prod(shape), dtype=kind).reshape(shape) + 1
    _store(tmp_path / "a.zarr", array, chunks, axes=list(axes), version=version)
    levels, _ = stores.catalog(spark, str(tmp_path))
    full = array.reshape([shape[axes.index(a)] if a in axes else 1 for a in "tczyx"])
    got = A.chunk_voxels(stores.read_chunks(levels)).collect()
    assert len(got) == array.size and all(full[r.t, r.c, r.z, r.y, r.x] == r.value for r in got)


def test_axes_that_cannot_be_resolved_are_an_error(spark, tmp_path):
    _store(tmp_path / "odd.zarr", np.zeros((2, 2, 2), "uint8"), [2, 2, 2], axes=["y", "z", "x"])
    levels, _ = stores.catalog(spark, str(tmp_path))
    with pytest.raises(Exception, match="odd.zarr/0 cannot be resolved"):
        stores.read_chunks(levels).collect()


def test_a_plane_opens_its_chunks_only(spark, tmp_path):
    array = np.arange(2 * 4 * 6 * 6, dtype="uint16").reshape(2, 4, 6, 6)
    _store(tmp_path / "a.zarr", array, [1, 2, 3, 3], axes=list("tzyx"))
    for file in (tmp_path / "a.zarr" / "0" / "c").rglob("*"):
        if file.is_file() and tuple(map(int, file.parts[-4:]))[:2] != (1, 1):
            file.write_bytes(b"x")  # would not decode
    levels, _ = stores.catalog(spark, str(tmp_path))
    plane = A.chunk_plane(stores.read_chunks(levels, t=1, plane=("z", 3)), "z", 3)
    assert sorted((r.row, r.col, r.value) for r in plane.collect()) == [(y, x, array[1, 3, y, x]) for y in range(6) for x in range(6)]
    assert stores.chunk_grid(levels).where("t0 = 1").where(A.crosses("z", 3)).count() == 4
    with pytest.raises(Exception):
        stores.read_chunks(levels).collect()


# --- documents ---------------------------------------------------------------------------------


class _Endless:
    """A document of ``n`` cells that is made as it is read."""

    def __init__(self, n):
        self.parts, self.left = self.make(n), b""

    def make(self, n):
        yield b'{"format": "%s", "version": 1, "metadata": {"note": "a \\"cells\\": [ in a text"}, "cells": [' % tracking.FORMAT.encode()
        for i in range(n):
            yield b'%s{"id": %d, "t": 0, "features": {"a": {"b": [1, 2, {"c": "]}"}]}}, "centroid": [1.5, 2e3, %d]}' % (b", " if i else b"", i, i)
        yield b"]}"

    def read(self, n):
        while len(self.left) < n and (part := next(self.parts, None)) is not None:
            self.left += part
        out, self.left = self.left[:n], self.left[n:]
        return out


def test_documents_larger_than_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(tracking, "BLOCK", 1 << 16)
    n, size = 150_000, 0
    tracemalloc.start()
    for i, text in enumerate(tracking.document_records(_Endless(n))):
        size += len(text)
        if i % 50_000 == 0:
            assert json.loads(text)["id"] == i
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i == n - 1 and size > 12_000_000 and peak < 2_000_000


def test_broken_documents_name_the_record():
    import io

    head = '{"format": "%s", "version": 1, "metadata": {}, "cells": [' % tracking.FORMAT
    for body, fault in (('{"id": 1}, {"id" 2}]}', "record 1 is no JSON"), ('{"id": 1}', "cells do not end"), ('{"id": 1} {"id": 2}]}', "no comma after record 0"), ("7]}", "record 0 is no object"), ("", "cells do not end")):
        with pytest.raises(ValueError, match=fault):
            list(tracking.document_records(io.BytesIO((head + body).encode())))
    assert list(tracking.document_records(io.BytesIO((head + " ] , \"more\": 1}").encode()))) == []
    for block in (1, 2, 7):
        tracking.BLOCK, kept = block, tracking.BLOCK
        try:
            assert [json.loads(x) for x in tracking.document_records(io.BytesIO((head + ' {"id":1, "state":"é\u00df"} , {"id":22}]}').encode()))] == [{"id": 1, "state": "éß"}, {"id": 22}]
        finally:
            tracking.BLOCK = kept


def test_documents_come_back_as_they_went(spark, tmp_path, seeded):
    cells, links = seeded
    extra = {"seg_id": F.when(F.col("id") == 2, 5).cast("long"), "detection_confidence": F.col("id") / 10.0, "state": F.when(F.col("id") == 3, "dividing").otherwise("normal"), "labels": F.when(F.col("id") == 1, F.array(F.lit("a,b"))), "track_labels": F.lit(None).cast("array<string>"), "features": F.when(F.col("id") == 2, '{"note":"x","size":{"um":[1.5,2]}}').when(F.col("id") == 4, "{}")}
    cells = cells.withColumns(extra)
    both = cells.withColumn("dataset", F.lit("a/b")).unionByName(cells.where("id < 4").withColumn("dataset", F.lit("c")))
    lk = links.withColumn("dataset", F.lit("a/b")).unionByName(links.where("child < 4").withColumn("dataset", F.lit("c")))
    names = spark.createDataFrame([("a/b", "late", "#010203"), ("a/b", "new", None)], "dataset string, name string, color string")
    made = tracking.write_tracking(both, lk, names, "9", str(tmp_path / "out"), "2024-01-01T00:00:00Z")
    assert sorted((r.cells, r.links) for r in made.collect()) == [(3, 2), (7, 5)]
    headers, records = tracking.read_tracking(spark, str(tmp_path / "out"))
    told = sorted((json.loads(r.metadata) for r in headers.collect()), key=str)
    assert told == sorted([{"created": "2024-01-01T00:00:00Z", "app_version": "9", "label_definitions": ["late", "new"], "label_colors": {"late": "#010203"}}, {"created": "2024-01-01T00:00:00Z", "app_version": "9", "label_definitions": [], "label_colors": {}}], key=str)
    want = tracking.tracking_records(both, lk).drop("dataset")
    assert tracking.round_trip_differences(want, records.select(want.columns)).count() == 0
    first = [json.loads(x)["id"] for x in tracking.document_records(gzip.open(next((tmp_path / "out").glob("a*/tracking.json.gz"))))]
    full = {r["id"]: r for r in map(json.loads, tracking.document_records(gzip.open(next((tmp_path / "out").glob("a*/tracking.json.gz")))))}
    assert full[1]["state"] == "normal" and full[2]["features"] == {"note": "x", "size": {"um": [1.5, 2]}} and "features" not in full[4]
    back = tracking.stage(records.drop("file").where("id < 5").dropDuplicates(["id"]))[0]
    assert {r.id: r.features for r in back.collect()} == {1: None, 2: '{"note":"x","size":{"um":[1.5,2]}}', 3: None, 4: None}
    assert first == [1, 2, 3, 4, 5, 6, 7] and not list((tmp_path / "out").rglob("0*-*"))


# --- wide rows, full places, deep trees ----------------------------------------------------------


def test_row_of_ten_thousand_overlapping_strokes(spark):
    rng = np.random.default_rng(1)
    spans = [(int(a), int(a + w)) for a, w in zip(rng.integers(0, 2000, 10_000), rng.integers(0, 300, 10_000), strict=True)]
    kinds, values = rng.choice(["paint", "erase", "scoped"], 10_000), rng.integers(1, 5, (10_000, 2))
    strokes = [(0, 0, 0, a, b, i, str(k), int(v), int(o)) for i, ((a, b), k, (v, o)) in enumerate(zip(spans, kinds, values, strict=True))]
    old = np.zeros(2400, np.int64)
    old[100:900], old[900:1500] = 7, 3
    now = old.copy()
    for _, _, _, a, b, _, k, v, o in strokes:
        now[a : b + 1] = v if k == "paint" else 0 if k == "erase" else np.where(now[a : b + 1] == o, 0, now[a : b + 1])
    runs = spark.createDataFrame([(0, 0, 0, 100, 899, 7), (0, 0, 0, 900, 1499, 3), (0, 1, 0, 5, 6, 9)], "t long, z long, y long, x0 long, x1 long, label long")
    after, changes = L.apply_strokes(runs, spark.createDataFrame(strokes, "t long, z long, y long, x0 long, x1 long, seq long, mode string, label long, only long"))
    got = np.zeros(2400, np.int64)
    for r in after.where("z = 0").collect():
        got[r.x0 : r.x1 + 1] = r.label
    assert (got == now).all() and after.where("z = 1").count() == 1
    told = sum((r.x1 - r.x0 + 1) for r in changes.collect())
    assert told == (now != old).sum()


def test_outline_equals_every_pixel(spark):
    rng = np.random.default_rng(2)
    image = np.zeros((40, 150), int)
    for k in range(1, 25):
        y, x = rng.integers(0, 36), rng.integers(0, 140)
        image[y : y + rng.integers(1, 9), x : x + rng.integers(1, 90)] = k
    runs = [(0, y, int(x), int(x), int(image[y, x])) for y in range(40) for x in range(150) if image[y, x]]
    want = {}
    for y, x in np.ndindex(image.shape):
        near = [(y + a, x + b) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= y + a < 40 and 0 <= x + b < 150]
        own = image[y, x]
        if own and any(image[p] != own for p in near):
            want[y, x] = own
        elif not own and (owners := [image[p] for p in near if image[p]]):
            want[y, x] = min(owners)
    out = L.label_outline(spark.createDataFrame(runs, "t long, y long, x0 long, x1 long, label long"), (40, 150))
    assert {(r.y, r.x): r.owner for r in out.collect()} == want


def test_candidates_of_a_dense_place(spark, monkeypatch):
    monkeypatch.setattr(K, "FULL_CUBE", 10)
    rng = np.random.default_rng(3)
    cells = [(i, i % 2, *map(float, rng.random(3) * (1 if i % 3 else 40))) for i in range(300)]
    want = []
    for j, t2, *b in cells:
        near = sorted((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), i) for i, t1, *a in cells if t1 + 1 == t2)
        want += [(i, j) for d, i in [x for x in near if x[0] <= 4.0][:5]]
    out = K.distance_candidates(spark.createDataFrame(cells, "id long, t long, z double, y double, x double"), 2.0, 5)
    assert sorted((r.id1, r.id2) for r in out.collect()) == sorted(want)


def test_layout_of_caterpillars_and_bushes(spark):
    """One tree that divides at every step, one balanced, one single cell."""
    up, at, n = {}, {1: 0}, 1
    spine = 1
    for _ in range(60):
        up |= {n + 1: spine, n + 2: spine}
        at |= {n + 1: at[spine] + 1, n + 2: at[spine] + 2}
        spine, n = n + 1, n + 2
    tops = [n + 1]
    at[n + 1] = 0
    n += 1
    for _ in range(5):
        new = []
        for p in tops:
            up |= {n + 1: p, n + 2: p}
            at |= {n + 1: at[p] + 1, n + 2: at[p] + 1}
            new += [n + 1, n + 2]
            n += 2
        tops = new
    at[n + 1] = 3
    kids = {}
    for c, p in up.items():
        kids.setdefault(p, []).append(c)

    def draw(node, leaf):
        own = sorted(kids.get(node, []), key=lambda c: (at[c], c))
        if not own:
            return {node: float(leaf)}, leaf + 1
        out = {}
        for c in own:
            sub, leaf = draw(c, leaf)
            out |= sub
        return out | {node: (out[own[0]] + out[own[-1]]) / 2}, leaf

    want = {}
    for root in (i for i in at if i not in up):
        want |= draw(root, 0)[0]
    cells = spark.createDataFrame(list(at.items()), "id long, t long")
    links = spark.createDataFrame([(p, c, None, False) for c, p in up.items()], "parent long, child long, confidence double, reviewed boolean")
    out = {r.id: r.col for r in G.lineage_layout(cells.join(G.tree_roots(cells, links), "id"), links).collect()}
    assert out.keys() == want.keys() and all(abs(out[i] - want[i]) < 1e-9 for i in want)


def test_hot_tops_are_split(spark, monkeypatch):
    from tracklake.operators import skew

    monkeypatch.setattr(skew, "SMALL", 50)
    pointers = spark.createDataFrame([(0, 0)] + [(i, (i - 1) // 2 if i < 60 else 3) for i in range(1, 2000)], "id long, up long")
    out = {r.id: (r.top, r.hops) for r in G.pointer_double(pointers).collect()}
    assert len(out) == 2000 and all(top == 0 for top, _ in out.values()) and out[1999][1] == 3


def test_bricks_span_batches_and_batches_hold_many(spark):
    v = spark.range(2 * 7 * 9 * 11).select(F.lit(5).cast("long").alias("t"), F.expr("id div 693").alias("c"), F.expr("id div 99 % 7").alias("z"), F.expr("id div 11 % 9").alias("y"), F.expr("id % 11").alias("x"), ((F.col("id") * 977) % 65536).alias("value"))
    want = rows(v, "c", "z", "y", "x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for brick in ((1, 2, 2), (7, 9, 11), (3, 4, 5)):
            chunks = A.to_chunks(v, brick, (7, 9, 11))
            assert rows(A.chunk_voxels(chunks), "c", "z", "y", "x") == want
            assert rows(A.chunk_voxels(A.rechunk(chunks, (2, 9, 3), (7, 9, 11))), "c", "z", "y", "x") == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert A.to_chunks(v.where("c = 0 AND z = 6 AND x = 10"), (2, 4, 4), (7, 9, 11)).select("nz", "ny", "nx").distinct().count() == 2


def test_display_rules_where_values_are_odd(spark):
    from tracklake.functions import scalars as S

    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(S.axis_slot(F.lit("\tTime\n"))) == 0 and value(S.unit_micrometres(F.lit("\tNM "))) == 1e-3
    assert value(S.label_name(F.lit("\t \n"))) is None and value(S.label_name(F.lit("\u2003a\tb\n"))) == "a\tb"
    assert value(S.label_color(F.lit(" #AbCdEf\n"))) == "#abcdef" and value(S.label_color(F.lit("#abcdef0"))) is None
    assert [value(S.channel_color(F.lit(None).cast("string"), F.lit(i))) for i in (0, 4, 6)] == ["FF0000", "FF00FF", "FF0000"]
    assert value(S.channel_color(F.lit("##0a0b0c"), F.lit(0))) == "0A0B0C" and value(S.channel_name(F.lit(None).cast("string"), F.lit(0))) == "Channel 1"
    assert [value(S.palette_index(F.lit(i))) for i in (0, -5, 1, 1025, 1 << 30)] == [0, 0, 0, 0, 16777214 % 1024]
    for name in ("", "late", "é日", "a\U0001f9ec"):
        h = 0
        for i in range(0, len(code := name.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(code[i : i + 2])) % (1 << 32)
        assert value(S.default_label_color(F.lit(name))) == h % 8
    assert value(S.label_hex(F.lit(""), F.lit(None).cast("string"))) == "#ffbf69" and value(S.label_hex(F.lit("x"), F.lit("#000000"))) == "#000000"
    assert abs(value(S.window_gamma(F.lit(0.5), 0.0, 1.0, float("nan"))) - 0.5) < 1e-12


def test_layout_of_small_arrays_and_of_chunks_over_frames(spark):
    levels = spark.createDataFrame([("a", 0, 4, 100, 100, 16, 256, 64, 2, 5, 4, 2, 8), ("b", 0, 0, 10, 10, 1, 10, 10, 1, 1, 1, 1, 1)], "dataset string, level int, z long, y long, x long, cz long, cy long, cx long, item_bytes long, t long, ct long, c long, cc long")
    got = {(r.dataset, r.view): r for r in A.analyze_layout(levels).collect()}
    r = got["a", "xy"]  # 4 frames, 2 channels, 4 x 100 x 64 voxels of 2 bytes; two chunks
    assert (r.bytes_needed, r.bytes_decoded, r.chunks_decoded, r.hostile) == (20000, 2 * 4 * 2 * 4 * 100 * 64 * 2, 2, True)
    assert (got["b", "xz"].bytes_needed, got["b", "xz"].amplification) == (0, 1.0)
