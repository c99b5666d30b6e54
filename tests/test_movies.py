"""Two movies with equal ids: an operator on both at once gives what it gives on each alone."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import arrays as A
from tracklake.operators import edits as E
from tracklake.operators import graph as G
from tracklake.operators import labels as L
from tracklake.operators import linking as K
from tracklake.operators import relational as R
from tracklake.operators.keys import by
from tracklake.sources import tracking

SCHEMAS = {
    "cells": "id long, t long, z double, y double, x double, area long, detection_confidence double, confidence double, state string, track_id long, src_id long, seg_id long, labels array<string>, track_labels array<string>, reviewed boolean",
    "links": "parent long, child long, confidence double, reviewed boolean", "after": "parent long, child long, confidence double, reviewed boolean", "new": "parent long, child long, confidence double, reviewed boolean",
    "both": "parent long, child long, confidence double, side string", "pairs": "parent long, child long", "ids": "id long", "proposals": "seq long, parent long, child long",
    "mask": "t long, label long", "runs": "t long, z long, y long, x0 long, x1 long, label long", "voxels": "t long, c long, z long, y long, x long, value long", "strokes": "t long, z long, y long, x0 long, x1 long, seq long, mode string, label long, only long",
    "stamps": "stroke long, t long, cz double, cy double, cx double, r double", "points": "stroke long, seq long, z double, y double, x double", "moves": "id long, old long, new long",
    "nodes": "src long, track long, t long, parent_src long, parent_track long", "edits": "seq long, domain string, op string, undone boolean, pending boolean, touches_cells boolean", "blobs": "seq long, chunk_key string, existed boolean, before string",
    "chunks": "chunk_key string, data string", "writes": "seq long, id long, track_id long", "names": "name string, color string", "levels": "level long, z long, y long, x long, cz long, cy long, cx long, item_bytes long, scale_z double, scale_y double, scale_x double",
    "tracks": "t long, label long, track_id long", "spots": "id long, t long, c long, z long, y long, x long", "ops": "seq long, step int, kind string, id long, other long, value double, names array<string>", "op": "seq long, domain string, op string, undone boolean, pending boolean, touches_cells boolean",
    "spans": "interaction string, ms double, at long, id long", "costs": "parent long, child long, cost double", "old": "t long, label long, area long, sum_z long, sum_y long, sum_x long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long",
}


def tables(seed):
    """Rows of one movie."""
    rng = np.random.default_rng(seed)
    n = 12
    up = {i: int(rng.integers(max(1, i - 3), i)) for i in range(2, n + 1) if rng.random() < 0.8}
    many = {}
    up = {c: p for c, p in up.items() if many.setdefault(p, []).append(c) or len(many[p]) <= 2}
    t = {i: i + seed for i in range(1, n + 1)}
    lab = [["a", "b"], ["b"], None]
    cells = [(i, t[i], *map(float, rng.integers(0, 30, 3)), 5, float(i) / n, 0.9 if i % 5 else 1.5, "normal", int(rng.integers(1, 9)) if i % 4 else None, i, i if i % 3 else i + 1, lab[(i + seed) % 3], lab[(i * seed) % 3], bool(i % 2)) for i in range(1, n + 1)]
    links = [(p, c, float(rng.integers(0, 9)) / 8, bool(c % 2)) for c, p in up.items()]
    free = [(1, n, None, True)] if n not in up else [(n - 1, n + 1, None, True)]
    runs, strokes = [], []
    for y in range(6):
        at = 0
        while at < 150:
            w = int(rng.integers(1, 40))
            if rng.random() < 0.6:
                runs.append((int(rng.integers(0, 2)) + 3 if False else 3 + y % 2, y // 2, y, at, min(at + w, 149), int(rng.integers(1, 6))))
            at += w + 2
        for k in range(3):
            a = int(rng.integers(0, 120))
            strokes.append((3 + y % 2, y // 2, y, a, a + 25, 10 * y + k, ["paint", "erase", "scoped"][int(rng.integers(0, 3))], 7, int(rng.integers(1, 6))))
    inventory = {}
    for a, _, _, x0, x1, v in runs:
        inventory[a, v] = inventory.get((a, v), 0) + x1 - x0 + 1
    edits = [(i, "mask" if i % 2 else "graph", '{"kind":"k%d"}' % (i % 3), i % 5 == seed % 5, i % 7 == 0, i % 4 == 0) for i in range(1, 25)]
    kinds = ["link", "cut", "track", "label", "unlabel", "remove", "restore", "track_label", "track_unlabel"]
    return {
        "cells": cells, "links": links, "after": links[seed % 3 :] + free, "new": free, "both": [(p, c, w, s) for p, c, w, _ in links for s in ("children", "parent")] + [(99, 1, 0.5, "parent"), (2, 98, 2.0, "children")],
        "pairs": [(p, c) for p, c, _, _ in links[:2]], "ids": [(i,) for i in (2, 5, 8)], "proposals": [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(1, n + 3, (15, 2)))],
        "mask": [(t[i], i) for i in range(1, n + 1) if i % 4 != seed % 4], "runs": runs, "voxels": [(0, c, z, y, x, int(rng.integers(0, 65536))) for c in range(2) for z in range(3) for y in range(4) for x in range(5)], "strokes": strokes,
        "stamps": [(k % 2, 3, float(k), 3.0 + seed, 4.0 + k, 2.0) for k in range(4)], "points": [(k % 2, k, 0.0, 0.0, float(rng.integers(0, 20))) for k in range(20)], "moves": [(i, i, int(rng.integers(20, 30))) for i in (1, 4, 7)],
        "nodes": [(i * 10, int(rng.integers(1, 4)), t[i], up.get(i, 0) * 10 or None, int(rng.integers(1, 4)) if i in up else None) for i in range(1, n + 1)], "edits": edits, "blobs": [(i, f"k{i % 4}", bool(i % 3), f"{seed}-{i}") for i in range(1, 25, 2)],
        "chunks": [(f"k{i}", f"now {seed}") for i in range(5)], "writes": [(i, i % 5, int(rng.integers(0, 99))) for i in range(1, 25)], "names": [("a", f"#00000{seed}"), ("zz", None)], "levels": [(k, 6, 64 >> k, 60 >> k, 2, 16, 16, 2, 1.0, 0.5 * (k + seed), 0.5 * 2**k) for k in range(3)],
        "tracks": [(3, v, v + seed) for v in (1, 2, 3)] + [(4, v, v * 2) for v in (1, 4)], "spots": [(i, 0, i % 3, i % 3, i % 4, i % 6) for i in range(12)], "op": [(1, "graph", "{}", False, False, False), (2, "mask", "{}", False, False, False)],
        "ops": [(i, 0, kinds[int(rng.integers(0, 9))], int(rng.integers(1, n)), int(rng.integers(1, n)), 0.5, ["late"]) for i in range(1, 25)], "spans": [("pan" if i % 2 else "zoom", float(rng.integers(1, 99)), i, i) for i in range(30)],
        "costs": [(int(a), int(b), float(c)) for a, b, c in {(int(p), int(q)): (p, q, k) for k, (p, q) in enumerate(rng.integers(1, 8, (25, 2)))}.values()],
        "old": [(a, v, area - 1 + seed, 1, 1, 1, 0, 2, 0, 5, 0, 20) for (a, v), area in inventory.items() if v % 2],
    }


def inventory(m):
    return L.label_inventory(m["runs"])


def parented(m):
    return G.with_parent(m["cells"], m["links"])


def bricks(m):
    return A.to_chunks(m["voxels"], (2, 2, 3), (3, 4, 5))


def trees(m):
    return m["cells"].join(G.tree_roots(m["cells"], m["links"]), [*by(m["cells"]), "id"])


def fresh(m):
    return G.next_track_id(m["cells"])


def members(m, name):
    return m[name].select(*by(m[name]), "id")


OPERATORS = {
    "P1": lambda m: R.cells_window(m["cells"], m["links"], 2, 9, (0, 25, 0, 25)), "P3": lambda m: R.cell_by_id(m["cells"], m["links"], m["ids"]), "P10": lambda m: R.export_record(m["cells"]), "J1": parented,
    "J2": lambda m: R.check_dangling(m["both"], m["cells"], "children"), "J4": lambda m: R.check_forward(m["both"], m["cells"]), "J5": lambda m: R.check_sides_agree(m["both"]), "J6": lambda m: R.check_mask_resolution(m["cells"], m["mask"]),
    "J7": lambda m: R.translate_parents(m["nodes"], K.assign_ids(m["nodes"])), "J8": lambda m: L.relabel(m["runs"], m["tracks"].select(*by(m["runs"]), "t", F.col("label").alias("track"), F.col("track_id").alias("id"))), "J9": lambda m: L.relabel_by_track(m["runs"], m["tracks"]),
    "J10": lambda m: L.remap_to_tracks(m["runs"], m["cells"], R.highlight_slots(m["cells"], 5, ["a", "b"])), "J11": lambda m: K.overlap_costs(m["runs"].withColumn("t", F.col("t") + F.col("y") % 2), 1, None), "J12": lambda m: K.distance_candidates(m["cells"], 30.0, 3),
    "J13": lambda m: K.link_mutual_best(m["costs"], 15.0, 20.0), "J15": lambda m: R.existing(m["ids"], m["cells"]), "J16": lambda m: L.relabel_mismatches(m["runs"], m["nodes"], 3), "A1": inventory, "A2": lambda m: L.scan_label(m["runs"], 3, 2), "A3": lambda m: L.inventory_flags(inventory(m), 4),
    "A4": lambda m: tuple(v for _, v in sorted(L.publish_inventory(inventory(m), m["cells"], m["edits"], m["blobs"], 3).items())), "A5": lambda m: L.region_props(m["runs"]), "A6": lambda m: R.graph_summary(m["cells"], m["links"]), "A7": lambda m: R.check_degree(m["both"]), "A8": lambda m: R.check_confidence(m["both"], m["cells"]),
    "A10": lambda m: R.collapse_links(m["both"]), "A11": lambda m: R.label_definitions(m["names"], m["cells"]), "A12": lambda m: G.label_states(m["cells"], G.chains(m["cells"], m["links"]), m["ids"]), "A13": lambda m: A.histogram(m["voxels"], brick=(2, 2, 3), max_samples=20),
    "A13 chunks": lambda m: A.chunk_histogram(bricks(m)), "A13 budget": lambda m: A.sampled_histogram(A.to_chunks(m["voxels"], (2, 2, 3), (3, 4, 5), level=2), A.histogram_plan(m["levels"].withColumns({"z": F.lit(3).cast("long"), "y": F.lit(4).cast("long"), "x": F.lit(5).cast("long"), "cz": F.lit(2).cast("long"), "cy": F.lit(2).cast("long"), "cx": F.lit(3).cast("long")}), 60, 30)),
    "A14": lambda m: A.histogram_meta(A.histogram(m["voxels"]), 0, 61), "A15": lambda m: G.track_spans(parented(m)), "A16": lambda m: L.object_counts(m["runs"]), "A17": lambda m: L.drop_small(m["runs"], 60), "A19": lambda m: A.percentile_normalize(m["voxels"]), "A20": lambda m: A.z_project(m["voxels"], "sum"), "A21": lambda m: A.downsample_yx(m["voxels"], 4, 5),
    "A22": lambda m: E.delta_affected(m["moves"].withColumn("seq", F.col("id") % 2)), "A23": lambda m: R.latency_stats(m["spans"], {"pan": 50.0}, 10), "A24": lambda m: A.choose_z_size(m["voxels"], 2, 3), "A25": lambda m: R.tracking_summary(m["cells"], m["links"], m["links"].where("child > 9")),
    "W1": lambda m: K.assign_ids(m["nodes"]), "W2": lambda m: G.trail_segments(parented(m), G.shown_tracks(G.track_spans(parented(m)), 8), 8, 5), "W3": lambda m: G.track_heads(m["nodes"]), "W4": lambda m: G.check_parent_tracks(m["nodes"]), "W5": lambda m: G.fresh_track_ids(G.chains(m["cells"], m["links"]), 50), "W6": lambda m: L.merge_runs(m["strokes"]),
    "W7": lambda m: L.to_runs(L.explode_runs(m["runs"])), "K1": lambda m: R.review_queue(m["links"], 3), "K2": lambda m: R.edit_history(m["edits"], m["blobs"], 5), "K3": lambda m: R.undo_redo(m["edits"]), "K4": lambda m: R.cap(R.validate_staged(m["cells"], m["both"], m["mask"]), 2), "K5": lambda m: R.prune_blobs(m["edits"], m["blobs"], 4),
    "K7": lambda m: R.pending_edits(m["edits"]), "U1": lambda m: R.max_label_id(m["cells"], m["mask"]), "U2": lambda m: R.ids_in_use(m["cells"], m["mask"], 3, 8), "U3": lambda m: L.union_sets(m["runs"].drop("label"), m["strokes"].select(*by(m["runs"]), "t", "z", "y", "x0", "x1"), keys=("t", "z", "y")), "U5": lambda m: R.merge_definitions(m["names"], m["names"].withColumn("color", F.lit("#AAAAAA"))),
    "U6": lambda m: G.diff_links(m["links"], m["after"]), "U7": lambda m: G.chain_links(m["links"], m["ids"]), "G1": lambda m: G.chains(m["cells"], m["links"]), "G2": lambda m: G.lineage(m["cells"], m["links"], m["ids"]), "G3": lambda m: G.validate_links(m["proposals"], m["cells"], m["links"], 5), "G4": lambda m: G.rematerialize(m["cells"], m["links"], m["after"].where("child < 13"), fresh(m)),
    "G5": lambda m: G.graph_link(m["cells"], m["links"], m["proposals"], fresh(m)), "G6": lambda m: G.graph_cut(m["cells"], m["links"], m["pairs"], fresh(m)), "G7": lambda m: G.graph_unlink(m["cells"], m["links"], m["ids"], fresh(m)), "G8": lambda m: G.set_labels(m["cells"], m["links"], m["ids"], "track", ["n"], ["b"]), "G9": lambda m: G.strip_label(m["cells"], "b"),
    "G10": lambda m: G.apply_delta(m["links"], m["moves"], m["cells"], G.diff_links(m["links"], m["after"]), False), "G11": lambda m: G.lineage_rows(m["cells"], m["links"], m["ids"]), "G12": lambda m: G.lineage_layout(trees(m), m["links"]), "G13": lambda m: G.shown_tracks(G.track_spans(parented(m)), 7), "G14": lambda m: G.division_edges(m["cells"], m["links"], 9, 9), "G15": lambda m: G.check_track_identity(m["cells"], m["links"]),
    "V1": lambda m: A.analyze_layout(m["levels"] if by(m["levels"]) else m["levels"].withColumn("dataset", F.lit("one"))).drop("dataset" if not by(m["levels"]) else ""), "V2": lambda m: A.level_factors(m["levels"]), "V4": lambda m: A.ortho_plane(m["voxels"], "y", 0, 2, [0, 1]), "V4 chunks": lambda m: A.chunk_plane(bricks(m), "x", 3), "V5": lambda m: A.volume(m["voxels"], m["levels"], 0, 1), "V6": lambda m: A.sample_points(m["voxels"], m["spots"], {"t": 1, "c": 2, "z": 3, "y": 4, "x": 5}),
    "V7": lambda m: A.rechunk(bricks(m), (3, 3, 2), (3, 4, 5)), "V8": lambda m: A.build_proxy(bricks(m), (3, 4, 5), 3), "V9": lambda m: L.stamp_runs(m["stamps"], (8, 16, 16)), "V10": lambda m: L.rasterize_strokes(m["stamps"], (8, 16, 16)), "V11": lambda m: L.apply_strokes(m["runs"], m["strokes"]), "V11 deltas": lambda m: L.change_deltas(L.apply_strokes(m["runs"], m["strokes"])[1]),
    "V12": lambda m: L.clear_label(m["runs"], 3, 2, (0, 5, 0, 5, 10, 90)), "V13": lambda m: L.affected_chunks(m["runs"], (1, 4, 32)), "V14": lambda m: L.regenerate_coarse(m["runs"], (1, 2, 2)), "V15": lambda m: L.label_pyramid(m["runs"], (3, 6, 150), (3, 4, 70)), "V17": lambda m: L.label_outline(m["runs"], (6, 150)), "V18": lambda m: A.build_pyramid(m["voxels"], 4, 5, 2), "V20": lambda m: A.to_world(m["cells"], (2.0, 1.0, 1.0)),
    "V23": lambda m: L.set_digest(L.stamp_runs(m["stamps"], (8, 16, 16)), ("stroke",)), "V24": lambda m: A.segment(bricks(m), lambda a: a > 30000), "V25": lambda m: L.thin_stamps(m["points"], "stroke", 9.0, limit=4), "V26": lambda m: L.plane_spans(m["runs"], "y", 2, (1, 1, 2)), "S11": lambda m: L.narrow_dtype(m["runs"]), "S3": lambda m: R.staging_duplicates(m["cells"].unionByName(m["cells"].where("id = 3")), m["both"]),
    "S2": lambda m: tracking.stage(tracking.tracking_records(m["cells"], m["links"]).withColumns({"parent": F.lit(None).cast("struct<id:bigint,confidence:double>"), "features": F.lit(None).cast("variant")})), "E1": lambda m: E.fold_extents(inventory(m), m["old"]), "E2": lambda m: E.ensure_extent(m["old"], m["runs"], inventory(m)), "E3": lambda m: E.before_edit(inventory(m), m["old"]),
    "E4": lambda m: E.upsert_cells(m["cells"], inventory(m)), "E5": lambda m: tuple(v for _, v in sorted(E.remove_cells(m["cells"], m["links"], m["mask"], m["ids"]).items())), "E6": lambda m: E.restore_cells(m["cells"].where("id > 2"), m["links"].where("parent > 2"), m["mask"], m["cells"].where("id < 4"), m["links"].where("parent < 4")), "E7": lambda m: E.materialize(m["cells"].where("id > 4"), m["cells"].where("id < 9")),
    "E8": lambda m: E.negate(m["old"]), "E9": lambda m: E.check_frame(m["cells"], m["old"]), "E10": lambda m: R.reserve_ids(m["cells"], m["mask"], 4, 9), "E11": lambda m: E.import_blocker(m["links"], m["edits"]), "L1": lambda m: E.record(m["edits"], m["blobs"], m["op"]), "L2 extents": lambda m: E.replay_extents(m["old"], m["edits"], m["old"].withColumn("seq", F.col("label"))), "L2": lambda m: E.replay_last(m["edits"], m["writes"], "id", "track_id"),
    "L2 graph": lambda m: E.replay_graph(m["cells"], m["links"], m["edits"], m["ops"]), "L3": lambda m: E.recover(m["edits"], m["chunks"], m["blobs"]), "L4": lambda m: E.mark_undone(m["edits"], m["blobs"], True), "L4 delete": lambda m: E.delete_edits(m["edits"], m["blobs"], m["op"]), "L5": lambda m: E.versions(m["edits"]),
}


@pytest.fixture(scope="module")
def movies(spark):
    """(tables of movie 1, of movie 2, of both); a dozen rows each, so one task a step."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    each = [{name: spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1) for name, rows in tables(seed).items()} for seed in (1, 2)]
    both = {name: functools.reduce(lambda a, b: a.unionByName(b), [m[name].withColumn("dataset", F.lit(f"m{i}")) for i, m in enumerate(each)]) for name in SCHEMAS}
    yield each, both
    spark.conf.set("spark.sql.shuffle.partitions", before)


def told(out, movie=None):
    frames = out if isinstance(out, tuple) else (out,)
    rows = []
    for k, frame in enumerate(frames):
        columns = sorted(c for c in frame.columns if c != "dataset")
        rows += [repr((k, movie or r.dataset, [(c, bytes(r[c]) if isinstance(r[c], bytearray) else r[c]) for c in columns])) for r in frame.collect()]
    return sorted(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_movies_stay_apart(movies, name):
    """The second movie's rows are those that it gives alone: nothing of the first gets in, and nothing is lost to it."""
    each, both = movies
    got = told(OPERATORS[name](both))
    assert [row for row in got if ", 'm1', " in row] == told(OPERATORS[name](each[1]), "m1")
    assert len({row.split(", ")[1] for row in got}) == 2 or len(got) < 3


def test_tables_with_and_without_movies_do_not_mix(movies):
    each, both = movies
    with pytest.raises(ValueError, match="dataset"):
        G.chains(both["cells"], each[0]["links"])
