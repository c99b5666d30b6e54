"""Queries of sources, sinks and streams; fixtures are written to the shared folder and read back through the operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklake.operators import arrays as A
from tracklake.plans import fixtures as X
from tracklake.plans.catalog import query
from tracklake.plans import stored
from tracklake.plans.staging import fresh_folder, staged
from tracklake.sources import manifest, stores, tracking
from tracklake.streaming import streams as T


def _folder(s, name: str) -> str:
    return fresh_folder(s, name)


def _records(s, d):
    c = X.cells(s, d)
    return tracking.tracking_records(c.withColumn("detection_confidence", F.when(F.col("id") % 19 != 0, F.col("detection_confidence"))), X.links(s, d))


_RECORD_SQL = "SELECT id, t, nullif(seg_id, id) AS seg_id, track_id, z, coalesce((SELECT string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) FROM links l WHERE l.parent = c.id), '') AS children, CASE WHEN id % 19 <> 0 THEN detection_confidence END AS confidence, state, coalesce(array_to_string(labels, ','), '') AS labels FROM cells c"


def _flat(records):
    kids = F.coalesce(F.array_join(F.transform("children", lambda c: c.id.cast("string")), ","), F.lit(""))
    return records.select("id", "t", "seg_id", "track_id", F.get("centroid", 0).alias("z"), kids.alias("children"), "confidence", "state", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query("s1_tracking_source", _RECORD_SQL)
def s1(s, d):
    one = _records(s, d).withColumn("movie", F.expr("id div 4096"))
    documents = one.groupBy("movie").agg(F.collect_list(F.struct(*[c for c in one.columns if c != "movie"])).alias("cells"))
    text = F.to_json(F.struct(F.lit(tracking.FORMAT).alias("format"), F.lit(tracking.VERSION).alias("version"), F.create_map(F.lit("app"), F.lit("x")).alias("metadata"), "cells"))
    path = _folder(s, "documents")
    documents.select(text.alias("value"), "movie").write.partitionBy("movie").option("compression", "gzip").text(path)
    return _flat(tracking.read_tracking(s, path)[1])


@query("s2_staging", "SELECT 'cell' AS kind, id AS a, t AS b, CASE WHEN id % 19 <> 0 THEN detection_confidence END AS confidence FROM cells UNION ALL SELECT 'children', parent, child, confidence FROM links UNION ALL SELECT 'report', (SELECT count(*) FROM cells), (SELECT max(id) FROM cells), (SELECT CAST(count(*) AS DOUBLE) FROM links)")
def s2(s, d):
    cells, links, report = tracking.stage(_records(s, d).withColumns({"parent": F.lit(None).cast("struct<id:bigint,confidence:double>"), "features": F.try_parse_json(F.format_string('{"size":%d}', "id"))}))
    rows = cells.select(F.lit("cell").alias("kind"), F.col("id").alias("a"), F.col("t").alias("b"), "confidence")
    rows = rows.union(links.select("side", "parent", "child", "confidence"))
    return rows.union(report.select(F.lit("report"), "cells", "max_id", F.col("links").cast("double")))


def _definitions(s):
    return s.createDataFrame([("treated", "#ff0000"), ("control", None)], "name string, color string")


@query("s4_tracking_sink", _RECORD_SQL)
def s4(s, d):
    """One document, read back as one; its metadata are checked on the way."""
    path = _folder(s, "sink")
    c = X.cells(s, d).withColumn("detection_confidence", F.when(F.col("id") % 19 != 0, F.col("detection_confidence")))
    tracking.write_tracking(c, X.links(s, d), _definitions(s), "1", path, "2024-01-02T03:04:05Z")
    headers, records = tracking.read_tracking(s, path)
    want = '{"created":"2024-01-02T03:04:05Z","app_version":"1","label_definitions":["control","treated"],"label_colors":{"treated":"#ff0000"}}'
    same = headers.select(F.assert_true(F.get_json_object("metadata", "$.label_colors.treated") == "#ff0000", F.concat(F.lit(want), F.lit(" and not "), "metadata")).alias("ok"))
    return _flat(records.join(same))  # one document, one row


@query("s4_documents_of_movies", "SELECT user_id % 7 AS movie, count(*) AS cells, CAST(sum(CASE WHEN b.id IN (SELECT child FROM links) THEN 1 ELSE 0 END) AS BIGINT) AS links FROM base b GROUP BY 1")
def s4b(s, d):
    """A document for each movie; counts are those of what is read back."""
    path = _folder(s, "movies")
    c = X.cells(s, d).withColumn("dataset", F.concat(F.lit("movie "), F.col("user_id") % 7))
    lk = X.links(s, d).join(c.select(F.col("id").alias("child"), "dataset"), "child")
    names = c.select("dataset").distinct().select("dataset", F.lit("treated").alias("name"), F.lit("#ff0000").alias("color"))
    tracking.write_tracking(c, lk, names, "1", path)
    records = tracking.read_tracking(s, path)[1]
    movie = F.regexp_extract("file", r"movie_20_(\d+)/", 1).cast("long")
    return records.groupBy(movie.alias("movie")).agg(F.count("*").alias("cells"), F.sum(F.greatest(F.size("children"), F.lit(0))).cast("long").alias("links"))


@query("e13_round_trip", "SELECT 0 AS differences, (SELECT count(*) FROM cells) AS records")
def e13(s, d):
    """Export, import of the document and export again; the record tables are the same."""
    path = _folder(s, "trip")
    c, lk = X.cells(s, d), X.links(s, d)
    tracking.write_tracking(c, lk, _definitions(s), "1", path)
    once = staged(tracking.read_tracking(s, path)[1], "once")
    cells, links, _ = tracking.stage(once)
    again = tracking.tracking_records(cells.withColumnRenamed("confidence", "detection_confidence"), links.drop("side"))
    before = tracking.tracking_records(c, lk)
    lost = tracking.round_trip_differences(before, again.select(before.columns)).unionByName(tracking.round_trip_differences(before, once.select(before.columns)))
    return lost.agg(F.count("*").alias("differences")).join(once.agg(F.count("*").alias("records")))


@query("s5_tracker_csv", "SELECT src, track, t, z, y, x, parent_src, parent_track FROM nodes")
def s5(s, d):
    path = _folder(s, "csv")
    n = X.nodes(s, d)
    n.select(F.col("track").alias("track_id"), "t", "z", "y", "x", F.col("src").alias("id"), F.coalesce("parent_track", F.lit(-1)).alias("parent_track_id"), F.coalesce("parent_src", F.lit(-1)).alias("parent_id")).write.option("header", True).csv(path)
    return tracking.read_tracker_csv(s, path)


@query("s6_track_tables", "SELECT (SELECT count(DISTINCT head) FROM chains) AS tracks, (SELECT count(*) FROM links l JOIN kids k ON k.parent = l.parent WHERE k.n = 2) AS splits, 0 AS merges, (SELECT count(*) FROM nodes) AS rows")
def s6(s, d):
    path = _folder(s, "tables")
    n = staged(X.nodes(s, d), "nodes")
    tracks = n.select(F.col("t").alias("frame"), F.col("src").alias("label"), F.col("track").alias("track_id"), F.col("track").alias("tree_id"), "z", "y", "x")
    splits = n.where("parent_track IS NOT NULL AND parent_track <> track").select(F.col("parent_track").alias("parent_track_id"), F.col("track").alias("child_track_id"))
    out = tracking.write_tracks(tracks, splits, splits.where("false"), path)
    return out.join(s.read.option("header", True).csv(f"{path}/tracks").agg(F.count("*").alias("rows")))


@query("s10_chunk_sink", "SELECT t, c, z, y, x, value FROM image")
def s10(s, d):
    path = _folder(s, "chunks")
    stores.write_chunks(A.to_chunks(X.image(s, d), (4, 17, 9), (4, 17, 17)), path, (2.0, 0.5, 0.5))
    return A.chunk_voxels(stores.read_written_chunks(s, path))


_FRAMES = 8  # frames of one stored image


def _stores(s, d) -> str:
    """Every image as stores of eight frames, of format version 2 and 3 in turn."""
    path = _folder(s, "stores")
    chunks = A.to_chunks(X.image(s, d), (4, 9, 17), (4, 17, 17)).withColumn("image", F.expr(f"t div {_FRAMES}")).withColumn("t", F.col("t") % _FRAMES)
    chunks = staged(chunks, "store-chunks")
    for version in (2, 3):
        stored.write_arrays(chunks.where(F.col("image") % 2 == version - 2), path, (4, 9, 17), (2.0, 0.5, 0.5), version)
    return path


def _image_number(column: str):
    return F.regexp_extract(column, r"image-(\d+)\.zarr", 1).cast("long")


@query("s7_store_catalog", f"SELECT t // {_FRAMES} AS image, 0 AS level, (max(t % {_FRAMES}) + 1) || ',2,4,17,17' AS shape, '1,1,4,9,17' AS chunks, 'u16' AS dtype, 'tczyx' AS axes, CAST(2 AS DOUBLE) AS size_z, CAST(0.5 AS DOUBLE) AS size_y, CAST(0.5 AS DOUBLE) AS size_x FROM image GROUP BY t // {_FRAMES}")
def s7(s, d):
    levels, _ = stores.catalog(s, _stores(s, d))
    return levels.select(_image_number("folder").alias("image"), "level", F.array_join("shape", ",").alias("shape"), F.array_join("chunks", ",").alias("chunks"), "dtype", F.array_join("axes", "").alias("axes"), *[F.col("scale")[i + 2].alias(f"size_{a}") for i, a in enumerate("zyx")])


@query("s8_chunk_scan", "SELECT t, c, z, y, x, value FROM image")
def s8_scan(s, d):
    levels, _ = stores.catalog(s, _stores(s, d))
    chunks = stores.read_chunks(levels, None)
    return A.chunk_voxels(chunks.withColumn("t", _image_number("layer") * _FRAMES + F.col("t")))


@query("s8_plane_of_stores", f"SELECT t, c, z AS row, x AS col, value FROM image WHERE y = 11 AND t % {_FRAMES} = 3 AND c = 1")
def s8_plane(s, d):
    """One plane, frame and channel of every image: only the chunks that hold it are opened."""
    levels, _ = stores.catalog(s, _stores(s, d))
    chunks = stores.read_chunks(levels, None, 3, 1, ("y", 11))
    return A.chunk_plane(chunks.withColumn("t", _image_number("layer") * _FRAMES + F.col("t")), "y", 11)


@query("s9_stack", "SELECT dense_rank() OVER (ORDER BY t) - 1 AS t, z, y, x, value FROM image WHERE c = 1")
def s9(s, d):
    path = _folder(s, "stack")
    whole = A.to_chunks(X.image(s, d).where("c = 1"), (4, 17, 17), (4, 17, 17))
    stored.write_stack(whole.select("t", F.array("nz", "ny", "nx").alias("shape"), F.lit("<u2").alias("dtype"), "data"), path)
    read = stores.read_stack(s, path).where("dtype = 'uint16'")
    zero = [F.lit(0).cast("long").alias(n) for n in ("c", "gz", "gy", "gx", "oz", "oy", "ox")]
    return A.chunk_voxels(read.select(F.lit("stack").alias("layer"), F.lit(0).alias("level"), "t", *zero, *[F.col("shape")[i].alias(f"n{a}") for i, a in enumerate("zyx")], F.lit("u16").alias("dtype"), "data")).select("t", "z", "y", "x", "value")


@query("s8_missing_chunks", "SELECT 0 AS level, t, c, gz, gy, gx FROM (SELECT unnest(range(0, max(t) + 1)) AS t FROM image), (SELECT unnest(range(0, 2)) AS c), (SELECT unnest(range(0, 2)) AS gz), (SELECT unnest(range(0, 3)) AS gy), (SELECT unnest(range(0, 3)) AS gx) WHERE (t, c, gz, gy, gx) NOT IN (SELECT (t, c, z // 2, y // 8, x // 8) FROM image WHERE value % 4096 = 0)")
def s8(s, d):
    frames = X.base(s, d).agg((F.max("user_id") + 1).alias("t"))
    levels = frames.select(F.lit(0).alias("level"), "t", *[F.lit(v).cast("long").alias(k) for k, v in (("c", 2), ("z", 4), ("y", 17), ("x", 17), ("cz", 2), ("cy", 8), ("cx", 8))])
    have = X.image(s, d).where("value % 4096 = 0").select(F.lit(0).alias("level"), "t", "c", F.expr("z div 2").alias("gz"), F.expr("y div 8").alias("gy"), F.expr("x div 8").alias("gx")).distinct()
    return stores.missing_chunks(levels, have)


# --- streams ---------------------------------------------------------------------------


def _stream(s, d, table: str):
    # a pattern, since a file stream takes folders or patterns and the table may be one file
    return s.readStream.schema(s.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parque[t]")


_SIZE = "CASE WHEN event_id % 3 = 0 THEN -(event_id % 5) ELSE event_id % 9 END"


def _deltas(events):
    e = F.col("event_id")
    size = F.when(e % 3 == 0, -(e % 5)).otherwise(e % 9)
    box = {k: F.when(e % 2 == 0, v) for k, v in (("z0", e % 4), ("z1", e % 4 + 2), ("y0", e % 100), ("y1", e % 100 + 5), ("x0", e % 90), ("x1", e % 90 + 3))}
    return events.select((F.col("user_id") % 30).alias("t"), F.col("user_id").alias("label"), size.alias("area"), (size * 2).alias("sum_z"), (size * 3).alias("sum_y"), (size * 4).alias("sum_x"), *[v.alias(k) for k, v in box.items()])


@query("t1_live_extents", f"WITH g AS (SELECT user_id % 30 AS t, user_id AS label, CAST(sum({_SIZE}) AS BIGINT) AS area, min(CASE WHEN event_id % 2 = 0 THEN event_id % 4 END) AS z0, max(CASE WHEN event_id % 2 = 0 THEN event_id % 90 + 3 END) AS x1 FROM events WHERE user_id <> 0 GROUP BY user_id) SELECT t, label, area, area * 2 AS sum_z, z0, x1, CASE WHEN area < 0 THEN 'error' WHEN area = 0 THEN 'removed' ELSE 'updated' END AS change FROM g")
def t1(s, d):
    rows = T.run_available(T.stream_extents(_deltas(_stream(s, d, "events"))), mode="update")
    last = rows.groupBy("t", "label").agg(F.max_by(F.struct("area", "sum_z", "z0", "x1", "change"), "tl_batch").alias("r"))
    return last.select("t", "label", "r.area", "r.sum_z", F.when(F.col("r.z0") >= 0, F.col("r.z0")).alias("z0"), F.when(F.col("r.x1") >= 0, F.col("r.x1")).alias("x1"), "r.change")


def _version_events(events):
    return events.select(F.col("event_type").alias("session"), F.concat(F.lit("c"), F.col("user_id")).alias("counter"), ((F.col("event_id") * 7919) % 1009).alias("version"), F.col("event_id").alias("seq"))


@query("t2_version_counters", "SELECT event_type AS session, 'c' || user_id AS counter, max((event_id * 7919) % 1009) AS version FROM events GROUP BY ALL")
def t2(s, d):
    rows = T.run_available(T.stream_versions(_version_events(_stream(s, d, "events"))), mode="update")
    return rows.groupBy("session", "counter").agg(F.max("version").alias("version"))


@query("t3_stale_events", "WITH e AS (SELECT event_type AS session, 'c' || user_id AS counter, (event_id * 7919) % 1009 AS version, event_id AS seq FROM events WHERE event_type = 'view'), o AS (SELECT *, max(version) OVER (PARTITION BY counter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT session, counter, version, seq FROM o WHERE top IS NULL OR version > top")
def t3(s, d):
    return T.run_available(T.drop_stale(_version_events(_stream(s, d, "events")), "view"))


_JOBS = "jb AS (SELECT user_id AS job, event_id AS seq, row_number() OVER w * 100.0 / count(*) OVER (PARTITION BY user_id) AS percent, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) THEN 'done' WHEN event_id % 211 = 0 THEN 'failed' ELSE 'running' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _jobs(events):
    own = Window.partitionBy("user_id")
    k, n = F.row_number().over(own.orderBy("event_id")), F.count("*").over(own)
    state = F.when(k == n, "done").when(F.col("event_id") % 211 == 0, "failed").otherwise("running")
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (k * F.lit(100.0) / n).alias("percent"), state.alias("state"))


_PROGRESS = f"WITH {_JOBS}, e AS (SELECT *, CAST(floor(percent) AS BIGINT) AS whole, coalesce(max(CASE WHEN state IN ('done', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM jb), c AS (SELECT *, lag(whole) OVER w AS was, lag(state) OVER w AS was_state FROM e WHERE ended = 0 WINDOW w AS (PARTITION BY job ORDER BY seq)) SELECT job, seq, whole AS percent, state FROM c WHERE whole IS DISTINCT FROM was OR state IS DISTINCT FROM was_state"


@query("t4_job_progress", _PROGRESS)
def t4(s, d):
    return T.job_progress(_jobs(s.read.parquet(f"{d}/events.parquet")))


@query("t4_job_progress_stream", _PROGRESS)
def t4s(s, d):
    path = _folder(s, "jobs")
    _jobs(s.read.parquet(f"{d}/events.parquet")).write.parquet(path)
    return T.run_available(T.stream_job_progress(s.readStream.schema("job long, seq long, percent double, state string").parquet(path)))


@query("t5_superseded_jobs", "SELECT event_id AS job, CASE WHEN user_id % 2 = 0 AND event_type <> 'view' THEN 'cancelled' WHEN user_id % 2 = 0 THEN 'running' ELSE 'done' END AS state FROM events")
def t5(s, d):
    jobs = _stream(s, d, "events").select(F.col("event_id").alias("job"), F.col("event_type").alias("session"), F.when(F.col("user_id") % 2 == 0, "running").otherwise("done").alias("state"))
    return T.run_available(T.cancel_superseded(jobs, "view")).select("job", "state")


@query("t6_invalidations", "SELECT label AS seq, '0/c/' || t || '/0/' || z // 4 || '/' || y // 128 || '/' || x // 128 AS key FROM voxels UNION SELECT label, '1/c/' || t || '/0/' || z // 4 || '/' || y // 2 // 128 || '/' || x // 2 // 128 FROM voxels")
def t6(s, d):
    path = _folder(s, "runs")
    X.runs(s, d).withColumnRenamed("label", "seq").write.parquet(path)
    runs = s.readStream.schema("t long, z long, y long, x0 long, x1 long, seq long").parquet(path)
    # dropped per key once more: a key may come back in a later micro-batch
    return T.run_available(T.invalidations(runs, [(0, (1, 1, 1)), (1, (1, 2, 2))], (4, 128, 128))).distinct()


@query("t7_row_patches", "WITH p AS (SELECT user_id AS id, arg_max(value, event_id) AS v, arg_max(event_type = 'error', event_id) AS rm FROM events GROUP BY user_id), b AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0 UNION ALL SELECT DISTINCT -user_id FROM events WHERE user_id <> 0) SELECT coalesce(b.id, p.id) AS id, CASE WHEN p.id IS NOT NULL THEN p.v ELSE 0 END AS value, CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS revision FROM b FULL JOIN p ON p.id = b.id WHERE p.id IS NULL OR NOT rm")
def t7(s, d):
    """Patches of all users over a view that has half of them, and rows that no patch meets."""
    e = s.read.parquet(f"{d}/events.parquet")
    view = e.where("user_id % 2 = 0").select(F.col("user_id").alias("id")).union(e.where("user_id <> 0").select(-F.col("user_id"))).distinct().select("id", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("revision"))
    out: list = []
    patches = _stream(s, d, "events").select(F.col("user_id").alias("id"), "value", (F.col("event_type") == "error").alias("remove"), F.col("event_id").alias("seq"))
    T.run_available(patches, lambda batch, i: out.append(staged(T.apply_patches(out[-1] if out else view, batch), "view")))
    return out[-1] if out else view


@query("t8_streaming_ingest", "SELECT 'cell' AS kind, id AS a, t AS b FROM cells WHERE user_id % 8 <> 5 UNION ALL SELECT 'link', parent, child FROM links l JOIN base b ON b.id = l.child WHERE b.user_id % 8 <> 5 UNION ALL SELECT 'dangling_child', -1, 0")
def t8(s, d):
    """Eight movies, a file each, in batches of three; one has a link to nowhere and is rejected whole.  The run is then repeated from a state without its last batch."""
    path, to = _folder(s, "incoming"), _folder(s, "published")
    movie = F.col("user_id") % 8
    own = X.base(s, d).select("id", movie.alias("movie"))
    astray = F.when((F.col("movie") == 5) & (F.col("id") == F.min("id").over(Window.partitionBy("movie"))), F.array(F.struct(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("double").alias("confidence"))))
    records = _records(s, d).join(own, "id").withColumn("children", F.coalesce(astray, "children"))
    records.repartition(8, "movie").write.partitionBy("movie").json(path)
    T.ingest_tracking(s, f"{path}/*", to, 3)
    published = manifest.table(s, to, "cells").count()
    T.ingest_tracking(s, f"{path}/*", to, 3)
    assert manifest.table(s, to, "cells").count() == published
    cells, links, faults = (manifest.table(s, to, n) for n in ("cells", "links", "faults"))
    rows = cells.select(F.lit("cell").alias("kind"), F.col("id").alias("a"), F.col("t").alias("b")).union(links.select(F.lit("link"), "parent", "child"))
    return rows.union(faults.select("rule", F.lit(-1).cast("long"), F.lit(0).cast("long")).distinct())


@query("t9_edit_windows", "SELECT domain, strftime(TIMESTAMP '1970-01-01' + INTERVAL 7 DAY * (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7), '%Y-%m-%d') AS start, count(*) AS n, 'tumbling' AS kind FROM edits GROUP BY ALL")
def t9(s, d):
    return T.edit_activity(X.edits(s, d)).select("domain", F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.lit("tumbling").alias("kind"))


@query("t9_edit_sessions", "WITH g AS (SELECT domain, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY domain ORDER BY ts) + INTERVAL 2 DAY OR lag(ts) OVER (PARTITION BY domain ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM edits), h AS (SELECT *, sum(new) OVER (PARTITION BY domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT domain, strftime(min(ts), '%Y-%m-%d') AS start, count(*) AS n FROM h GROUP BY domain, k")
def t9s(s, d):
    return T.edit_sessions(X.edits(s, d)).select("domain", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("t10_decode_events", "SELECT 'job' AS type, event_id AS job, CAST(user_id AS DOUBLE) AS percent FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'versions', NULL, NULL FROM events WHERE event_id % 4 = 1")
def t10(s, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.format_string('{"type":"job","job":%d,"percent":%d}', "event_id", "user_id")).when(e % 4 == 1, F.format_string('{"type":"versions","counter":"c","version":%d}', "event_id")).when(e % 4 == 2, '{"type":"other"}').otherwise("no json")
    return T.run_available(T.decode_events(_stream(s, d, "events").select(text.alias("value")))).select("type", "job", "percent")
