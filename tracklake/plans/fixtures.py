"""Detections, links and label volumes derived from the ``events`` table.

The first event of each user on each day is a detection; t is the day.  Links join
a user's consecutive detections, except that every seventh links two back, which
makes a division there.  Each detection stands for a 31-voxel ellipsoid.
:data:`CTES` has the same tables as DuckDB SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import graph, labels
from tracklake.plans.staging import staged

#: Events of one partition, some 2 million voxels of images.
PART = 50_000

DIMS = {"t": 30, "z": 8, "y": 512, "x": 512}

CTES: dict[str, str] = {
    "members": """SELECT *, date_diff('day', DATE '2024-01-01', day) AS t, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM (
        SELECT event_id + 1 AS id, user_id, event_type, value, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""",
    "base": """SELECT id, user_id, t, n, event_type, value, 2 + user_id % 5 AS z, 4 + (user_id * 37) % 499 + t % 3 AS y, 4 + (user_id * 101) % 503 + n % 2 AS x FROM members""",
    "links": """SELECT p.id AS parent, c.id AS child, CASE WHEN c.id % 11 = 0 THEN NULL ELSE ((p.id * 31 + c.id * 17) % 200) / 200.0 END AS confidence, c.id % 5 = 0 AS reviewed
        FROM members c JOIN members p ON p.user_id = c.user_id AND p.n = c.n - CASE WHEN c.n % 7 = 0 THEN 2 ELSE 1 END""",
    "kids": "SELECT parent, count(*) AS n FROM links GROUP BY parent",
    "chains": """SELECT b.id, b.id AS head, 0 AS pos FROM base b LEFT JOIN links l ON l.child = b.id LEFT JOIN kids k ON k.parent = l.parent WHERE l.parent IS NULL OR k.n > 1
        UNION ALL SELECT l.child, c.head, c.pos + 1 FROM chains c JOIN kids k ON k.parent = c.id AND k.n = 1 JOIN links l ON l.parent = c.id""",
    "roots": """SELECT b.id, b.id AS root, 0 AS depth FROM base b LEFT JOIN links l ON l.child = b.id WHERE l.parent IS NULL
        UNION ALL SELECT l.child, c.root, c.depth + 1 FROM roots c JOIN links l ON l.parent = c.id""",
    "cells": """SELECT b.id, b.t, CASE WHEN b.id % 53 = 0 THEN NULL ELSE CAST(b.z AS DOUBLE) END AS z, CASE WHEN b.id % 53 = 0 THEN NULL ELSE CAST(b.y AS DOUBLE) END AS y, CASE WHEN b.id % 53 = 0 THEN NULL ELSE CAST(b.x AS DOUBLE) END AS x,
        31 AS area, (900 + b.id % 90) / 1000.0 AS detection_confidence, CASE WHEN k.n = 2 THEN 'dividing' WHEN k.n IS NULL AND b.event_type = 'error' THEN 'death' ELSE 'normal' END AS state,
        CASE WHEN b.id % 17 = 0 THEN NULL ELSE c.head END AS track_id, b.id AS src_id, CASE WHEN b.id % 3 = 0 THEN NULL ELSE b.id END AS seg_id,
        CASE b.event_type WHEN 'purchase' THEN ['ESI', 'treated'] WHEN 'view' THEN ['control'] END AS labels, CASE WHEN b.user_id % 4 = 0 THEN ['cell type 1'] END AS track_labels, b.id % 7 = 0 AS reviewed, b.user_id, b.n, b.event_type
        FROM base b JOIN chains c ON c.id = b.id LEFT JOIN kids k ON k.parent = b.id""",
    "voxels": """SELECT t, z + dz AS z, y + dy AS y, x + dx AS x, max(id) AS label FROM base, (SELECT unnest(range(-1, 2)) AS dz), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)
        WHERE 4 * dz * dz + dy * dy + dx * dx <= 5 GROUP BY ALL""",
    "runs": """SELECT t, z, y, min(x) AS x0, max(x) AS x1, label FROM (SELECT *, x - row_number() OVER (PARTITION BY t, z, y, label ORDER BY x) AS island FROM voxels) GROUP BY t, z, y, label, island""",
    "inventory": "SELECT t, label, count(*) AS area, sum(z) AS sum_z, sum(y) AS sum_y, sum(x) AS sum_x, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM voxels GROUP BY t, label",
    "mask_labels": "SELECT DISTINCT t, label FROM voxels WHERE label % 101 <> 0",
    "stg_cells": "SELECT id, t, CASE WHEN id % 89 = 0 THEN 1.5 ELSE 0.9 END AS confidence, CASE WHEN id % 83 = 0 THEN 16777216 + id ELSE user_id END AS track_id, seg_id FROM cells",
    "stg_links": """SELECT CASE WHEN child % 97 = 2 THEN parent + 100000000 WHEN child % 97 = 3 THEN child ELSE parent END AS parent, CASE WHEN child % 97 = 1 THEN child + 100000000 WHEN child % 97 = 3 THEN parent ELSE child END AS child,
        CASE WHEN child % 97 = 5 THEN 1.5 ELSE confidence END AS confidence, 'children' AS side FROM links
        UNION ALL SELECT CASE WHEN child % 97 = 2 THEN parent + 100000000 WHEN child % 97 = 3 THEN child ELSE parent END, child + CASE WHEN child % 97 = 3 THEN parent - child ELSE 0 END,
        CASE WHEN child % 97 = 4 THEN 0.125 ELSE confidence END, 'parent' FROM links WHERE child % 2 = 0""",
    "nodes": """SELECT b.id * 10 + 3 AS src, c.head AS track, b.t, CAST(b.z AS DOUBLE) AS z, CAST(b.y AS DOUBLE) AS y, CAST(b.x AS DOUBLE) AS x, l.parent * 10 + 3 AS parent_src, pc.head AS parent_track
        FROM base b JOIN chains c ON c.id = b.id LEFT JOIN links l ON l.child = b.id LEFT JOIN chains pc ON pc.id = l.parent""",
    "image": """SELECT t, c, z, y, x, CAST((z * 7919 + y * 31 + x * 17 + t * 13 + c * 101 + seed) % 65536 AS BIGINT) AS value FROM (SELECT unnest(range(0, 2)) AS c), (SELECT unnest(range(0, 4)) AS z), (SELECT unnest(range(0, 17)) AS y), (SELECT unnest(range(0, 17)) AS x),
        (SELECT user_id AS t, sum(id * (z + y + x + t)) % 65536 AS seed FROM base GROUP BY user_id)""",
    "mids": "SELECT id AS gid, 'm' || user_id % 7 AS dataset, row_number() OVER (PARTITION BY user_id % 7 ORDER BY id) AS id, t, z, y, x FROM base",
    "mcells": """SELECT m.dataset, m.id, c.t, c.z, c.y, c.x, c.area, c.detection_confidence, c.state, k.id AS track_id, c.labels, c.track_labels FROM cells c JOIN mids m ON m.gid = c.id LEFT JOIN mids k ON k.gid = c.track_id""",
    "mlinks": "SELECT p.dataset, p.id AS parent, c.id AS child, l.confidence, l.reviewed FROM links l JOIN mids p ON p.gid = l.parent JOIN mids c ON c.gid = l.child",
    "mchains": "SELECT a.dataset, a.id, h.id AS head, c.pos FROM chains c JOIN mids a ON a.gid = c.id JOIN mids h ON h.gid = c.head",
    "mvoxels": """SELECT dataset, t, z + dz AS z, y + dy AS y, x + dx AS x, max(id) AS label FROM mids, (SELECT unnest(range(-1, 2)) AS dz), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE 4 * dz * dz + dy * dy + dx * dx <= 5 GROUP BY ALL""",
    "minventory": "SELECT dataset, t, label, count(*) AS area, CAST(sum(z) AS BIGINT) AS sum_z, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM mvoxels GROUP BY dataset, t, label",
    "edits": """SELECT o_orderkey AS seq, o_orderdate AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'mask' ELSE 'graph' END AS domain, o_orderstatus = 'F' AS undone, o_orderkey % 13 = 0 AS pending,
        CASE o_orderkey % 3 WHEN 0 THEN '{"kind":"link","scope":"track","cell":' || o_custkey || '}' WHEN 1 THEN '{"kind":"stroke","label":' || o_custkey || '}' ELSE '{"kind":"cut","cell":' || o_custkey || '}' END AS op FROM orders""",
    "blobs": "SELECT seq, '0/c/' || seq % 30 || '/0/0/' || seq % 4 || '/' || seq % 5 AS chunk_key, seq % 3 <> 0 AS existed, 'b' || seq AS before FROM edits WHERE domain = 'mask' AND seq % 10 < 8",
    "medits": "SELECT 'm' || seq % 7 AS dataset, seq // 7 AS seq, ts, domain, undone, pending, op FROM edits",
}


def oracle(body: str) -> str:
    """``body`` with the tables of :data:`CTES` that it names, directly or through others."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(CTES[name])
    listed = [f"{name} AS ({text})" for name, text in CTES.items() if name in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        listed.append("")
        return f"WITH RECURSIVE {', '.join(listed)}{body[own.end():]}"
    return f"WITH RECURSIVE {', '.join(listed)} {body}" if listed else body


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are dealt by user once, over all shuffle partitions and no more than :data:`PART` to each: what later steps make of a detection (voxels, stamps, images) is
    many times its size, so partitions that Spark merges for being small would become too large there."""
    day = F.to_date("ts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("id"), "user_id", "event_type", "value", "ts", day.alias("day"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // PART))
    events = events.repartition(parts, "user_id")
    first = events.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "id"))).where("k = 1")
    return first.select("id", "user_id", "event_type", "value", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("t"), F.row_number().over(Window.partitionBy("user_id").orderBy("day")).alias("n"))


def _placed(m: DataFrame, *more: str) -> DataFrame:
    u = F.col("user_id")
    return m.select("id", "user_id", "t", "n", "event_type", "value", (2 + u % 5).alias("z"), (4 + (u * 37) % 499 + F.col("t") % 3).alias("y"), (4 + (u * 101) % 503 + F.col("n") % 2).alias("x"), *more)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(members(spark, sf_dir))


def _parent() -> Column:
    """A link reaches one or two members back, so ``lag`` over the user's members replaces a self join."""
    w = Window.partitionBy("user_id").orderBy("n")
    return F.when(F.col("n") % 7 == 0, F.lag("id", 2).over(w)).otherwise(F.lag("id", 1).over(w))


def _linked(m: DataFrame) -> DataFrame:
    confidence = F.when(F.col("child") % 11 != 0, ((F.col("parent") * 31 + F.col("child") * 17) % 200) / F.lit(200.0))
    return m.select("parent", F.col("id").alias("child")).where("parent IS NOT NULL").select("parent", "child", confidence.alias("confidence"), (F.col("child") % 5 == 0).alias("reviewed"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(members(spark, sf_dir).select("id", _parent().alias("parent")))


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`base` and :func:`links` from one stored table, for queries that read them many times: events are dealt and sorted once."""
    found = staged(_placed(members(spark, sf_dir).withColumn("parent", _parent()), "parent"), "forest")
    return found.drop("parent"), _linked(found)


def cells(spark: SparkSession, sf_dir: str, tracked: bool = True) -> DataFrame:
    """``tracked=False`` leaves out track_id, which needs the chains."""
    return cells_of(*(forest if tracked else lambda *a: (base(*a), links(*a)))(spark, sf_dir), tracked)


def cells_of(b: DataFrame, lk: DataFrame, tracked: bool = True) -> DataFrame:
    """:func:`cells` from its base and links."""
    kids = lk.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    frame = b.join(kids, "id", "left")
    placed = F.col("id") % 53 != 0
    labelled = F.when(F.col("event_type") == "purchase", F.array(F.lit("ESI"), F.lit("treated"))).when(F.col("event_type") == "view", F.array(F.lit("control")))
    columns = {
        "z": F.when(placed, F.col("z").cast("double")), "y": F.when(placed, F.col("y").cast("double")), "x": F.when(placed, F.col("x").cast("double")), "area": F.lit(31).cast("long"),
        "detection_confidence": (900 + F.col("id") % 90) / F.lit(1000.0), "state": F.when(F.col("kids") == 2, "dividing").when(F.col("kids").isNull() & (F.col("event_type") == "error"), "death").otherwise("normal"),
        "src_id": F.col("id"), "seg_id": F.when(F.col("id") % 3 != 0, F.col("id")), "labels": labelled, "track_labels": F.when(F.col("user_id") % 4 == 0, F.array(F.lit("cell type 1"))), "reviewed": F.col("id") % 7 == 0,
    }
    frame = frame.withColumns(columns).drop("kids", "value")
    if not tracked:
        return frame
    heads = graph.chain_heads(b.select("id"), lk).select("id", "head")
    return frame.join(heads, "id").withColumn("track_id", F.when(F.col("id") % 17 != 0, F.col("head"))).drop("head")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in range(-2, 3) for dx in range(-2, 3) if 4 * dz * dz + dy * dy + dx * dx <= 5]
    one = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets]))
    grown = base(spark, sf_dir).select("id", "t", "z", "y", "x", one.alias("o")).select("id", "t", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return grown.groupBy("t", "z", "y", "x").agg(F.max("id").alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.to_runs(voxels(spark, sf_dir))


def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where("label % 101 <> 0").select("t", "label").distinct()


def stg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir, tracked=False)
    return c.select("id", "t", F.when(F.col("id") % 89 == 0, 1.5).otherwise(0.9).alias("confidence"), F.when(F.col("id") % 83 == 0, F.col("id") + 16777216).otherwise(F.col("user_id")).alias("track_id"), "seg_id")


def stg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per declaring side, with planted faults."""
    lk, fault = links(spark, sf_dir), F.col("child") % 97
    parent = F.when(fault == 2, F.col("parent") + 100000000).when(fault == 3, F.col("child")).otherwise(F.col("parent")).alias("parent")
    kids = lk.select(parent, F.when(fault == 1, F.col("child") + 100000000).when(fault == 3, F.col("parent")).otherwise(F.col("child")).alias("child"), F.when(fault == 5, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.lit("children").alias("side"))
    up = lk.where("child % 2 = 0").select(parent, F.when(fault == 3, F.col("parent")).otherwise(F.col("child")).alias("child"), F.when(fault == 4, 0.125).otherwise(F.col("confidence")).alias("confidence"), F.lit("parent").alias("side"))
    return kids.unionByName(up)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lk = base(spark, sf_dir), links(spark, sf_dir)
    heads = graph.chain_heads(b.select("id"), lk).select("id", F.col("head").alias("track"))
    parents = lk.select(F.col("child").alias("id"), "parent").join(heads.select(F.col("id").alias("parent"), F.col("track").alias("parent_track")), "parent", "left")
    frame = b.join(heads, "id").join(parents, "id", "left")
    return frame.select((F.col("id") * 10 + 3).alias("src"), "track", "t", *[F.col(c).cast("double").alias(c) for c in "zyx"], (F.col("parent") * 10 + 3).alias("parent_src"), "parent_track")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each user, 2 channels, 4 x 17 x 17, seeded by all detections of the user, so it grows with the events."""
    seeds = base(spark, sf_dir).groupBy(F.col("user_id").alias("t")).agg((F.sum(F.expr("id * (z + y + x + t)")) % 65536).alias("seed"))
    grid = seeds
    for axis, size in (("c", 2), ("z", 4), ("y", 17), ("x", 17)):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return grid.select("t", "c", "z", "y", "x", ((F.col("z") * 7919 + F.col("y") * 31 + F.col("x") * 17 + F.col("t") * 13 + F.col("c") * 101 + F.col("seed")) % 65536).alias("value"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    op = F.when(key % 3 == 0, F.format_string('{"kind":"link","scope":"track","cell":%d}', "o_custkey")).when(key % 3 == 1, F.format_string('{"kind":"stroke","label":%d}', "o_custkey")).otherwise(F.format_string('{"kind":"cut","cell":%d}', "o_custkey"))
    return orders.select(key.alias("seq"), F.col("o_orderdate").alias("ts"), F.when(key % 2 == 0, "mask").otherwise("graph").alias("domain"), (F.col("o_orderstatus") == "F").alias("undone"), (key % 13 == 0).alias("pending"), op.alias("op"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    key = F.concat_ws("/", F.lit("0/c"), seq % 30, F.lit("0/0"), seq % 4, seq % 5)
    return edits(spark, sf_dir).where("domain = 'mask' AND seq % 10 < 8").select("seq", key.alias("chunk_key"), (seq % 3 != 0).alias("existed"), F.concat(F.lit("b"), seq).alias("before"))


# --- many movies: the users are dealt to seven, and ids begin anew in each -------------------


def movie_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, dataset, id, t, z, y, x): the id that a detection has in its movie; no movie is numbered in one task."""
    return _movie_ids(base(spark, sf_dir))


def _movie_ids(b: DataFrame) -> DataFrame:
    found = b.select(F.col("id").alias("gid"), F.concat(F.lit("m"), F.col("user_id") % 7).alias("dataset"), "t", "z", "y", "x")
    return graph.number_rows(found, ["gid"], "id").select("gid", "dataset", "id", "t", "z", "y", "x")


def movie_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lk = forest(spark, sf_dir)
    return _movie_cells(b, lk, _movie_ids(b))


def _movie_cells(b: DataFrame, lk: DataFrame, ids: DataFrame) -> DataFrame:
    own, track = ids.select(F.col("gid").alias("c_id"), "dataset", F.col("id").alias("m_id")), ids.select(F.col("gid").alias("track_id"), F.col("id").alias("m_track"))
    out = cells_of(b, lk).withColumnRenamed("id", "c_id").join(own, "c_id").join(track, "track_id", "left")
    return out.select("dataset", F.col("m_id").alias("id"), "t", "z", "y", "x", "area", "detection_confidence", "state", F.col("m_track").alias("track_id"), "labels", "track_labels")


def movie_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lk = forest(spark, sf_dir)
    return _movie_links(lk, _movie_ids(b))


def movie_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`movie_cells` and :func:`movie_links`, stored, from one forest and one numbering."""
    b, lk = forest(spark, sf_dir)
    ids = _movie_ids(b)
    return staged(_movie_cells(b, lk, ids), "cells"), staged(_movie_links(lk, ids), "links")


def _movie_links(lk: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = (ids.select(F.col("gid").alias(end), *(["dataset"] if end == "parent" else []), F.col("id").alias(f"m_{end}")) for end in ("parent", "child"))
    return lk.join(a, "parent").join(b, "child").select("dataset", F.col("m_parent").alias("parent"), F.col("m_child").alias("child"), "confidence", "reviewed")


def movie_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in range(-2, 3) for dx in range(-2, 3) if 4 * dz * dz + dy * dy + dx * dx <= 5]
    one = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets]))
    grown = movie_ids(spark, sf_dir).select("dataset", "id", "t", "z", "y", "x", one.alias("o"))
    voxel = [(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"]
    return labels.to_runs(grown.select("dataset", "id", "t", *voxel).groupBy("dataset", "t", "z", "y", "x").agg(F.max("id").alias("label")))


def movie_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark, sf_dir).select(F.concat(F.lit("m"), F.col("seq") % 7).alias("dataset"), F.expr("seq div 7").alias("seq"), "ts", "domain", "undone", "pending", "op")


def movie_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select(F.concat(F.lit("m"), F.col("t") % 7).alias("dataset"), F.expr("t div 7").alias("t"), "c", "z", "y", "x", "value")
