"""Structured Streaming operators; each equals its batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklake.operators import edits as E
from tracklake.operators import relational as R
from tracklake.plans.staging import discard, fresh_folder, staged
from tracklake.sources import manifest, tracking

EVENT_TYPES = ("versions", "job", "invalidate", "graphChanged")
_EVENT = "type STRING, session STRING, counter STRING, version BIGINT, job BIGINT, percent DOUBLE, state STRING, keys ARRAY<STRING>"


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", checkpoint: str | None = None) -> DataFrame | None:
    """Run a stream over what its source holds now; the result is read back from the shared folder (None with a batch callback).

    Update mode keeps the batch number of each row as ``tl_batch``.  With a
    ``checkpoint`` of its own a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    folder = fresh_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", checkpoint or f"{folder}/state").trigger(availableNow=True)
    if each is not None:
        writer.outputMode(mode).foreachBatch(each).start().awaitTermination()
        return None
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    writer.outputMode(mode).foreachBatch(lambda rows, i: rows.withColumn("tl_batch", F.lit(i)).write.mode("append").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


_EXTENT_STATE = "area long, sum_z long, sum_y long, sum_x long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long"
_EXTENT_OUT = f"t long, label long, {_EXTENT_STATE}, change string"


def stream_extents(deltas: DataFrame) -> DataFrame:
    """Running extents of a stream of label deltas: one row for each key and micro-batch that changed it.

    change is updated, removed (area 0) or error (area below 0, the state keeps the
    value before).  Empty boxes are -1; label 0 is passed over.  The batch twin is ``fold_extents``.
    """
    sides = ("z0", "z1", "y0", "y1", "x0", "x1")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else (0, 0, 0, 0, -1, -1, -1, -1, -1, -1)
        sums, box = list(old[:4]), list(old[4:])
        for rows in batches:
            for i, c in enumerate(("area", "sum_z", "sum_y", "sum_x")):
                sums[i] += int(rows[c].sum())
            for i, c in enumerate(sides):
                values = rows[c].dropna()
                if len(values):
                    v = int(values.min() if i % 2 == 0 else values.max())
                    box[i] = v if box[i] < 0 else min(box[i], v) if i % 2 == 0 else max(box[i], v)
        if sums[0] == 0:
            sums = [0, 0, 0, 0]
        change = "error" if sums[0] < 0 else "removed" if sums[0] == 0 else "updated"
        if change != "error":
            state.update((*sums, *box))
        yield pd.DataFrame([(*key, *sums, *box, change)], columns=["t", "label", "area", "sum_z", "sum_y", "sum_x", *sides, "change"])

    return deltas.where("label <> 0").groupBy("t", "label").applyInPandasWithState(fold, _EXTENT_OUT, _EXTENT_STATE, "update", GroupStateTimeout.NoTimeout)


def stream_versions(events: DataFrame) -> DataFrame:
    """Highest version of each session and counter (update mode)."""
    return events.groupBy("session", "counter").agg(F.max("version").alias("version"))


def drop_stale(events: DataFrame, session: str) -> DataFrame:
    """Events of ``session`` whose version is newer than all of their counter before; columns session, counter, version, seq."""

    def newer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        for rows in batches:
            rows = rows.sort_values("seq")
            before = rows.version.cummax().shift(fill_value=-1).clip(lower=top)
            fresh = rows[rows.version > before]
            top = max(top, int(rows.version.max()))
            yield fresh[["session", "counter", "version", "seq"]]
        state.update((top,))

    own = events.where(F.col("session") == session).select("session", "counter", "version", "seq")
    return own.groupBy("counter").applyInPandasWithState(newer, "session string, counter string, version long, seq long", "top long", "append", GroupStateTimeout.NoTimeout)


def drop_stale_batch(events: DataFrame, session: str) -> DataFrame:
    top = F.max("version").over(Window.partitionBy("counter").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return events.where(F.col("session") == session).withColumn("top", top).where("top IS NULL OR version > top").select("session", "counter", "version", "seq")


def job_progress(events: DataFrame) -> DataFrame:
    """Batch: one row for each change of a job's whole percent or state, nothing after a terminal state; events: job, seq, percent, state."""
    w = Window.partitionBy("job").orderBy("seq")
    whole = F.floor("percent").cast("long")
    ended = F.max(F.col("state").isin("done", "failed", "cancelled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumns({"whole": whole, "ended": F.coalesce(ended, F.lit(0))}).where("ended = 0")
    changed = live.withColumns({"was": F.lag("whole").over(w), "was_state": F.lag("state").over(w)})
    return changed.where("NOT (whole <=> was) OR NOT (state <=> was_state)").select("job", "seq", F.col("whole").alias("percent"), "state")


def stream_job_progress(events: DataFrame) -> DataFrame:
    """The stream form of :func:`job_progress`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else (-1, "", False)
        out = []
        for rows in batches:
            for seq, percent, name in rows.sort_values("seq")[["seq", "percent", "state"]].itertuples(index=False):
                if last[2]:
                    break
                if (int(percent // 1), name) != last[:2]:
                    out.append((key[0], int(seq), int(percent // 1), name))
                last = (int(percent // 1), name, name in ("done", "failed", "cancelled"))
        state.update(last)
        yield pd.DataFrame(out, columns=["job", "seq", "percent", "state"])

    return events.groupBy("job").applyInPandasWithState(step, "job long, seq long, percent long, state string", "whole long, state string, ended boolean", "append", GroupStateTimeout.NoTimeout)


def cancel_superseded(jobs: DataFrame, session: str) -> DataFrame:
    """Running jobs of other sessions become cancelled; works on batches and streams."""
    return jobs.withColumn("state", F.when((F.col("state") == "running") & (F.col("session") != session), "cancelled").otherwise(F.col("state")))


def invalidations(runs: DataFrame, levels: list[tuple[int, tuple[int, int, int]]], shape: tuple[int, int, int]) -> DataFrame:
    """(seq, key): distinct chunk keys at every level that the runs of an edit touch; ``levels`` are (level, factors from level 0).

    Stateless up to the distinct, which a stream bounds by its micro-batch.
    """
    cz, cy, cx = shape
    out = None
    for level, (fz, fy, fx) in levels:
        at = runs.select("seq", "t", F.expr(f"z div {fz} div {cz}").alias("gz"), F.expr(f"y div {fy} div {cy}").alias("gy"), F.explode(F.expr(f"sequence(x0 div {fx} div {cx}, x1 div {fx} div {cx})")).alias("gx"))
        keys = at.select("seq", F.concat_ws("/", F.lit(level), F.lit("c"), "t", F.lit(0), "gz", "gy", "gx").alias("key"))
        out = keys if out is None else out.unionByName(keys)
    return out.dropDuplicates(["seq", "key"])


def apply_patches(view: DataFrame, patches: DataFrame) -> DataFrame:
    """``view`` (id, value, revision) after patches (id, value, remove): the last patch of an id in ``seq`` order wins, revisions count batches."""
    last = patches.groupBy("id").agg(F.max_by(F.struct("value", "remove"), "seq").alias("p")).select("id", F.col("p.value").alias("new"), F.col("p.remove").alias("remove"))
    both = view.join(last, "id", "full")
    return both.where("remove IS NULL OR NOT remove").select("id", F.coalesce(F.when(F.col("remove").isNotNull(), F.col("new")), F.col("value")).alias("value"), (F.coalesce("revision", F.lit(0)) + F.col("remove").isNotNull().cast("long")).alias("revision"))


def ingest_tracking(spark: SparkSession, folder: str, to: str, files: int = 64) -> None:
    """New record files of a folder are staged and validated, each as a movie of its own, and published whole or not at all.

    The table set ``to`` (:mod:`tracklake.sources.manifest`) gains the cells and links
    of the files without a fault, and the faults of the others, in one step for each
    micro-batch of ``files`` files.  A batch that runs again, after a failure on
    either side of that step, adds nothing twice.  ``dataset`` is the file.
    """
    stream = spark.readStream.schema(tracking.RECORD).option("maxFilesPerTrigger", files).json(folder).withColumn("dataset", F.input_file_name())
    source = f"records of {folder}"

    def one(batch: DataFrame, number: int) -> None:
        batch = staged(batch, "batch")
        cells, links, _ = tracking.stage(batch)
        faults = staged(R.cap(R.validate_staged(cells, links)), "faults")
        bad = faults.select("dataset").distinct()
        good = {"cells": cells.join(bad, "dataset", "left_anti"), "links": R.collapse_links(links).join(bad, "dataset", "left_anti"), "faults": faults}
        manifest.publish(spark, to, good, source, number, append=True)
        discard(batch, faults)

    run_available(stream, one, checkpoint=f"{to}/progress")


def edit_activity(edits: DataFrame, window: str = "7 days", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """(domain, start, n): edits in tumbling or sliding windows; rows later than the watermark are dropped by a stream."""
    late = edits.withWatermark("ts", watermark) if edits.isStreaming else edits
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return late.groupBy("domain", at.alias("w")).agg(F.count("*").alias("n")).select("domain", F.col("w.start").alias("start"), "n")


def edit_sessions(edits: DataFrame, gap: str = "2 days", watermark: str = "1 day") -> DataFrame:
    """(domain, start, end, n): runs of edits with no pause of ``gap`` or more."""
    late = edits.withWatermark("ts", watermark) if edits.isStreaming else edits
    return late.groupBy("domain", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("domain", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def decode_events(raw: DataFrame) -> DataFrame:
    """Tagged-union JSON in ``value``; frames of no known type, and no JSON, are dropped."""
    out = raw.select(F.from_json("value", _EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return out.where(F.col("type").isin(*EVENT_TYPES))


def live_cells(deltas: DataFrame, cells: DataFrame) -> DataFrame:
    """Batch form of a view kept by extents: cells with the centroid of their folded extent."""
    empty = deltas.where("false")
    return E.upsert_cells(cells, E.fold_extents(empty, deltas))

