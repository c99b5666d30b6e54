"""Plans and sizes that must hold as tables grow."""

import __spark_entry__ as entry


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_samples_do_not_send_the_image_to_every_task(spark, sf_dir):
    plan = _plan(entry.queries()["v6_samples"](spark, sf_dir))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_small_tables_are_dealt_over_all_partitions(spark, sf_dir):
    from tracklake.plans import fixtures

    assert fixtures.base(spark, sf_dir).rdd.getNumPartitions() == 4


def test_dense_frames_give_the_same_candidates(spark):
    import random

    from tracklake.operators import linking as K

    r = random.Random(5)
    cells = [(i, i % 2, r.choice([1.0, 1.0, 1.25]), *([3.0, 3.0] if i % 5 == 0 else [r.random() * 4, r.random() * 4] if i % 3 else [r.random() * 60, r.random() * 60])) for i in range(1200)]
    want = []
    for j, t, *b in cells:
        near = sorted((d, i) for i, s, *a in cells if s == t - 1 and (d := sum((v - u) * (v - u) for u, v in zip(a, b, strict=True))) <= 225)
        want += [(t - 1, t, i, j) for _, i in near[:5]]
    frame = K.distance_candidates(spark.createDataFrame(cells, "id long, t long, z double, y double, x double"), 15.0, 5)
    assert sorted(tuple(x)[:4] for x in frame.collect()) == sorted(want)
    pairs = frame._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    assert pairs >= 2  # the search for a bound, then the search within it


def test_outline_adds_masks_not_lists_and_meets_only_what_overlaps(spark):
    """Runs that fill a tile, cross tiles and share rows, against the rule pixel by pixel."""
    import random

    from tracklake.operators import labels as L

    r = random.Random(3)
    spans = []
    for y in range(6):
        x = r.randrange(9)
        while x < 200:
            n = 130 if y == 3 else r.choice([1, 2, 5, 64])
            spans.append((0, y, x, min(x + n - 1, 199), r.randrange(1, 4)))
            x += n + r.choice([0, 0, 1, 4])
    value = {(y, x): label for _, y, x0, x1, label in spans for x in range(x0, x1 + 1)}
    want = {}
    for (y, x), own in value.items():
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < 6 and 0 <= u < 200 and value.get((v, u)) != own:
                for p in ((y, x), *(() if (v, u) in value else ((v, u),))):
                    want[p] = min(want.get(p, own), own)
    out = L.label_outline(spark.createDataFrame(spans, "t long, y long, x0 long, x1 long, label long"), (6, 200))
    assert {(r.y, r.x): r.owner for r in out.collect()} == want
    assert "collect_list" not in _plan(out)


def test_chunk_table_has_a_folder_for_many_frames(spark, tmp_path):
    from tracklake.sources import stores

    row = "'image' AS layer, 0 AS level, id AS t, 0L AS c, 0L AS gz, 0L AS gy, 0L AS gx, 0L AS oz, 0L AS oy, 0L AS ox, 1L AS nz, 1L AS ny, 1L AS nx, 'u8' AS dtype, X'07' AS data"
    chunks = spark.range(300).selectExpr(*row.split(", "))
    stores.write_chunks(chunks, str(tmp_path / "out"))
    assert len(list((tmp_path / "out/chunks").rglob("*.parquet"))) <= 10  # 300 frames, 64 to a folder
    again = stores.read_written_chunks(spark, str(tmp_path / "out"))
    assert again.columns == chunks.columns and again.exceptAll(chunks).isEmpty() and again.count() == 300
    assert [r.t for r in again.where("t = 77").collect()] == [77]
    assert spark.read.json(str(tmp_path / "out/levels")).count() == 1


def test_stores_are_walked_by_tasks(spark, tmp_path, monkeypatch):
    """No Spark reader lists the store, and what lies below an array is left alone."""
    import json

    from pyspark.sql.readwriter import DataFrameReader

    from tracklake.sources import stores

    image = tmp_path / "deep" / "image 1.zarr"
    (image / "0" / "0" / "junk").mkdir(parents=True)
    (image / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": [{"name": a} for a in "zyx"], "datasets": [{"path": "0"}]}]}))
    (image / "0" / ".zarray").write_text(json.dumps({"shape": [1, 2, 2], "chunks": [1, 2, 2], "dtype": "|u1"}))
    (image / "0" / "0" / "junk" / "zarr.json").write_text(json.dumps({"node_type": "array", "shape": [9, 9]}))
    (tmp_path / "deep" / "zarr.json").write_text("no document")
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: 1 / 0)
    levels, _ = stores.catalog(spark, str(tmp_path))
    assert [(r.array.rsplit("/", 2)[1:], r.shape, r.separator) for r in levels.collect()] == [(["image 1.zarr", "0"], [1, 2, 2], ".")]


def test_no_movie_is_numbered_in_one_task(spark, sf_dir):
    from tracklake.plans import fixtures

    ids = fixtures.movie_ids(spark, sf_dir)
    assert ids.select("dataset").distinct().count() == 7
    windows = [line for line in _plan(ids).splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("tl_part" in line for line in windows)


def test_identities_sort_few_tables_in_a_stage(spark):
    """A stage holds all its sorts at once, so what is joined last comes from stored tables."""
    from tracklake.operators import graph as G

    cells = spark.range(1, 9).selectExpr("'m' AS dataset", "id", "id AS track_id")
    links = spark.range(1, 8).selectExpr("'m' AS dataset", "id AS parent", "id + 1 AS child")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = G.rematerialize(cells, links, links.where("child <> 5"), 20)
        sorts = _plan(out).count("Sort [")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorts <= 8
    assert sorted((r.id, r.old, r.new) for r in out.collect()) == [(i, i, 1 if i < 5 else 20) for i in range(1, 9)]


def test_link_edits_derive_their_detections_once(spark, sf_dir, monkeypatch):
    from tracklake.plans import fixtures

    seen, members = [], fixtures.members
    monkeypatch.setattr(fixtures, "members", lambda *a: seen.append(1) or members(*a))
    for name in ("g4_rematerialize", "g5_link", "g6_cut", "g7_unlink", "m_g6_cut"):
        seen.clear()
        plan = _plan(entry.queries()[name](spark, sf_dir))
        assert len(seen) == 1 and "events.parquet" not in plan, name


def test_publishing_scans_the_volume_once(spark):
    from tracklake.operators import labels as L

    seen = spark.sparkContext.accumulator(0)

    def scan(rows):
        for r in rows:
            seen.add(1)
            yield r

    columns = "t long, label long, area long, sum_z long, sum_y long, sum_x long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long"
    inventory = spark.createDataFrame(spark.sparkContext.parallelize([(0, 7, 2, 2, 4, 6, 1, 1, 2, 2, 3, 3), (1, 9, 1, 1, 2, 3, 1, 1, 2, 2, 3, 3)], 1).mapPartitions(scan), columns)
    cells = spark.createDataFrame([(9, 1, 1.0, 2.0, 3.0, 1)], "id long, t long, z double, y double, x double, area long")
    tables = L.publish_inventory(inventory, cells, spark.createDataFrame([(1, "mask"), (2, "graph")], "seq long, domain string"), spark.createDataFrame([(1,), (2,)], "seq long"))
    assert {name: table.count() for name, table in tables.items()} == {"mask_labels": 2, "mask_extent": 2, "cells": 2, "edits": 1, "blobs": 1, "next_id": 1}
    assert [tuple(r) for r in tables["cells"].where("id = 7").collect()] == [(7, 0, 1.0, 2.0, 3.0, 2)] and tables["next_id"].first()[0] == 10
    assert seen.value == 2
