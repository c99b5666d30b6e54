"""Tracking documents, tracker CSV, and track tables."""

from __future__ import annotations

import codecs
import gzip
import itertools
import json
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import relational as R
from tracklake.operators.keys import by
from tracklake.plans.staging import discard, staged
from tracklake.schemas import RECORD
from tracklake.sources.files import create_file, move_file, open_file, remove_files

#: The header every tracking document carries.
FORMAT, VERSION = "cell-tracking", 1


#: Bytes that a task reads of a document at a time.
BLOCK = 1 << 20


class _Scan:
    """The values of a JSON text one after the other, holding a block and the value being read."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.text, self.at, self.over = stream, "", 0, False
        self.bytes, self.json = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder()

    def _more(self) -> bool:
        block = self.stream.read(BLOCK)
        self.over = not block
        self.text, self.at = self.text[self.at :] + self.bytes.decode(block, self.over), 0
        return not self.over

    def next(self) -> str:
        """The next character that is no space, "" at the end; it stays where it is."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n":
                    return self.text[self.at]
                self.at += 1
            if self.over or not self._more():
                return ""

    def take(self, wanted: str, fault: str) -> str:
        found = self.next()
        if not found or found not in wanted:
            raise ValueError(fault)
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """(value, its text)."""
        self.next()
        tried = 0
        while True:
            try:
                found, end = self.json.raw_decode(self.text, self.at)
                if end < len(self.text) or self.over:  # a number may go on in the next block
                    text, self.at = self.text[self.at : end], end
                    return found, text
            except json.JSONDecodeError:
                if self.over:
                    raise
            while len(self.text) - self.at < 2 * tried and self._more():  # twice as much each time, so a long value is not read again and again
                pass
            self._more()
            tried = len(self.text) - self.at


def _header(scan: _Scan, form: str, version: int) -> dict:
    """The fields before ``cells``; the scan stands in the array then."""
    head: dict = {}
    scan.take("{", "no document")
    while True:
        if scan.next() == "}":
            raise ValueError("no cells")
        key, _ = scan.value()
        scan.take(":", "no document")
        if key == "cells":
            break
        head[key] = scan.value()[0]
        if scan.take(",}", "no document") == "}":
            raise ValueError("no cells")
    if head.get("format") != form:
        raise ValueError("wrong format" if "format" in head else "no format before cells")
    if head.get("version") != version:
        raise ValueError("wrong version" if "version" in head else "no version before cells")
    if not isinstance(head.get("metadata"), dict):
        raise ValueError("no metadata before cells")
    scan.take("[", "cells are no array")
    return head


def document_records(stream: BinaryIO, form: str = FORMAT, version: int = VERSION) -> Iterator[str]:
    """The texts of the records of one document, however large: a block and a record are held.

    Format, version and metadata come before the cells, or a ValueError says what is
    wrong; so does one for a record that is no JSON, with its number.
    """
    scan = _Scan(stream)
    _header(scan, form, version)
    if scan.next() == "]":
        return
    for k in itertools.count():
        try:
            found, text = scan.value()
        except json.JSONDecodeError as bad:
            raise ValueError(f"record {k} is no JSON ({bad.msg})" if scan.next() else "cells do not end") from None
        if not isinstance(found, dict):
            raise ValueError(f"record {k} is no object")
        yield text
        if scan.take(",]", f"no comma after record {k}" if scan.next() else "cells do not end") == "]":
            return


def _opened(path: str) -> BinaryIO:
    return open_file(path, "gzip" if path.endswith(".gz") else None)


def read_tracking(spark: SparkSession, path: str, form: str = FORMAT, version: int = VERSION) -> tuple[DataFrame, DataFrame]:
    """(headers, records) of tracking documents, plain or gzip by extension.

    A task streams its documents and splits them at record boundaries, so a document
    may be larger than its memory.  Headers (file, format, version, metadata as JSON)
    are read first, each file only up to its cells, and a bad one raises with its name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("path").to_pylist():
                with _opened(file) as stream:
                    try:
                        head = _header(_Scan(stream), form, version)
                        rows.append((file, head["format"], head["version"], json.dumps(head["metadata"]), None))
                    except ValueError as bad:
                        rows.append((file, None, None, None, str(bad)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["file", "format", "version", "metadata", "fault"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                with _opened(file) as stream:
                    found = document_records(stream, form, version)
                    while some := list(itertools.islice(found, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(some)], ["file", "record"])

    headers = files.mapInArrow(heads, "file string, format string, version int, metadata string, fault string")
    bad = headers.where("fault IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: {bad[0].fault}")
    texts = files.mapInArrow(records, "file string, record string")
    return headers.drop("fault"), texts.select("file", F.from_json("record", RECORD).alias("r")).select("file", "r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines: files of any size split across tasks."""
    return spark.read.schema(RECORD).json(path)


def stage(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, links per declaring side, report of one row a movie) of records."""
    own = by(records)
    cells = records.select(
        *own, "id", "t", "seg_id", "track_id", *[F.get("centroid", i).alias(a) for i, a in enumerate("zyx")], F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"), "state",
        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"), F.when(F.size("track_labels") > 0, F.col("track_labels")).alias("track_labels"), F.when(~F.to_json("features").isin("{}", "null"), F.to_json("features")).alias("features"),
    )
    down = records.select(*own, F.col("id").alias("parent"), F.explode("children").alias("c")).select(*own, "parent", F.col("c.id").alias("child"), F.col("c.confidence").alias("confidence"), F.lit("children").alias("side"))
    up = records.where("parent IS NOT NULL").select(*own, F.col("parent.id").alias("parent"), F.col("id").alias("child"), F.col("parent.confidence").alias("confidence"), F.lit("parent").alias("side"))
    links = down.unionByName(up)
    report = cells.groupBy(*own).agg(F.count("*").alias("cells"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.countDistinct("t").alias("frames"))
    count = links.groupBy(*own).agg(F.count("*").alias("links"))
    return cells, links, report.join(count, own, "left").fillna(0, ["links"]) if own else report.join(count)  # one row each


def tracking_records(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Records of a graph: links on the children side only, by child; empty fields null, so they are left out on writing.

    Features are the JSON object that ``cells`` hold as text, if they have that column.
    """
    own = by(cells, links)
    kids = links.groupBy(*own, F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("child").alias("id"), "confidence"))).alias("children"))
    placed = F.when(F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull(), F.array("z", "y", "x"))
    features = F.lit(None).cast("variant")
    if "features" in cells.columns:
        features = F.when(F.col("features") != "{}", F.try_parse_json("features"))
    out = R.export_record(cells).join(kids, [*own, "id"], "left")
    return out.select(
        *own, "id", "t", F.col("stored_seg").alias("seg_id"), "track_id", placed.alias("centroid"), "children", F.col("detection_confidence").alias("confidence"), "state",
        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"), F.when(F.size("track_labels") > 0, F.col("track_labels")).alias("track_labels"),
        features.alias("features"),
    )


def write_tracking(cells: DataFrame, links: DataFrame, definitions: DataFrame, app_version: str, path: str, created: str | None = None, form: str = FORMAT, version: int = VERSION) -> DataFrame:
    """One gzip document a movie below ``path``, which :func:`read_tracking` takes back; returns (file, cells, links).

    Metadata are created (now, if None), app_version, and from ``definitions`` (name,
    color) label_definitions and label_colors.  Records are in (t, id) order.  Tasks
    write ranges of records as gzip members; a second step joins the members of each
    document in order, since members in a row are one gzip file, and gives it its
    name once it is whole.  Nothing passes the driver and no task holds a document.
    """
    own = by(cells, links, definitions)
    spark = cells.sparkSession
    records = tracking_records(cells, links)
    body = records.select(*own, "t", "id", F.coalesce(F.size("children"), F.lit(0)).alias("n"), F.to_json(F.struct(*[c for c in records.columns if c not in own])).alias("record"))
    ranges = staged(body.repartitionByRange(*own, "t", "id").withColumn("part", F.spark_partition_id()), "records")
    key = [*own, "part"]
    target = path.rstrip("/")

    def name_of(row: tuple) -> str:
        # a folder for each movie, by a name that is the same in a path and in a URI
        return f"{target}/" + (re.sub(r"[^\w.-]", lambda m: f"_{ord(m[0]):x}_", str(row[0])) + "/" if row else "")

    def write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, where, counts = None, None, None, [0, 0]

        def close() -> tuple:
            out.close()
            return (*now, where, *counts)

        kinds = None
        for batch in batches:
            kinds = kinds or [*[batch.schema.field(c).type for c in key], pa.string(), pa.int64(), pa.int64()]
            done, names = [], list(zip(*[batch.column(c).to_pylist() for c in key], strict=True))
            for name, record, n in zip(names, batch.column("record").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if name != now:
                    if out:
                        done.append(close())
                    now, counts = name, [0, 0]
                    where = f"{name_of(name[:-1])}.parts/{name[-1]:08d}-{uuid.uuid4().hex}"
                    out = gzip.GzipFile(fileobj=create_file(where), mode="wb", mtime=0)
                out.write((("," if counts[0] else "") + record).encode())
                counts = [counts[0] + 1, counts[1] + (n or 0)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [*key, "file", "cells", "links"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(close(), kinds, strict=True)], [*key, "file", "cells", "links"])

    kind = ", ".join(f"{c} {ranges.schema[c].dataType.simpleString()}" for c in key)
    ordered = ranges.repartition(*key).sortWithinPartitions(*key, "t", "id")
    parts = staged(ordered.select(*key, "record", "n").mapInArrow(write_parts, f"{kind}, file string, cells long, links long"), "parts")
    now = F.lit(created) if created else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = definitions.groupBy(*own).agg(F.array_sort(F.collect_list("name")).alias("names"), F.map_from_entries(F.collect_list(F.when(F.col("color").isNotNull(), F.struct("name", "color")))).alias("colors"))
    movies = cells.select(*own).distinct() if own else spark.range(1).select()
    heads = movies.join(named, own, "left") if own else movies.join(named)  # one row
    metadata = F.struct(now.alias("created"), F.lit(app_version).alias("app_version"), F.coalesce("names", F.array().cast("array<string>")).alias("label_definitions"), F.coalesce("colors", F.create_map().cast("map<string,string>")).alias("label_colors"))
    head = F.to_json(F.struct(F.lit(form).alias("format"), F.lit(version).alias("version"), metadata.alias("metadata")))
    heads = heads.select(*own, F.lit(-1).alias("part"), head.alias("file"), F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("links"))

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(r[c] for c in own), r) for batch in batches for r in batch.to_pylist())
        for movie, found in itertools.groupby(rows, lambda x: x[0]):
            name, cells_n, links_n, used = f"{name_of(movie)}tracking.json.gz", 0, 0, []
            temporary = f"{name}.{uuid.uuid4().hex}"
            with create_file(temporary) as out:
                for _, r in found:
                    if r["part"] < 0:
                        out.write(gzip.compress((r["file"][:-1] + ',"cells":[').encode(), mtime=0))
                        continue
                    if used:
                        out.write(gzip.compress(b",", mtime=0))
                    with open_file(r["file"]) as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                    used.append(r["file"])
                    cells_n, links_n = cells_n + r["cells"], links_n + r["links"]
                out.write(gzip.compress(b"]}", mtime=0))
            move_file(temporary, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "cells": [cells_n], "links": [links_n]})

    every = parts.unionByName(heads)
    every = every.repartition(*own) if own else every.repartition(1)  # the members of one document, by path
    out = staged(every.sortWithinPartitions(*key).mapInArrow(join_parts, "file string, cells long, links long"), "documents")
    remove_files(parts.select("file"))
    discard(ranges, parts)
    return out


def round_trip_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only of two record tables; none means import and export are inverse."""
    a, b = (f.select(F.to_json(F.struct(*sorted(before.columns))).alias("record")) for f in (before, after))
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


TRACKER_CSV = "track_id BIGINT, t BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, id BIGINT, parent_track_id BIGINT, parent_id BIGINT"


def read_tracker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (src, track, t, z, y, x, parent_src, parent_track); -1 is null; a wrong header, a repeated id or a missing parent raises."""
    raw = spark.read.schema(TRACKER_CSV).option("header", True).option("enforceSchema", False).option("nullValue", "-1").option("mode", "FAILFAST").csv(path)
    nodes = raw.select(F.col("id").alias("src"), F.col("track_id").alias("track"), "t", "z", "y", "x", F.col("parent_id").alias("parent_src"), F.col("parent_track_id").alias("parent_track"))
    twice = nodes.groupBy("src").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0].src} is repeated")
    lost = nodes.where("parent_src IS NOT NULL").join(nodes.select(F.col("src").alias("parent_src")), "parent_src", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"node {lost[0].src} names a missing parent")
    return nodes


def write_tracks(tracks: DataFrame, splits: DataFrame, merges: DataFrame, path: str) -> DataFrame:
    """CSV tables tracks (frame, label, track_id, tree_id, rest), splits and merges (two columns even when empty); returns the one-row summary."""
    head = ["frame", "label", "track_id", "tree_id"]
    tracks.select(*head, *[c for c in tracks.columns if c not in head]).write.mode("overwrite").option("header", True).csv(f"{path}/tracks")
    for frame, name in ((splits, "splits"), (merges, "merges")):
        frame.select("parent_track_id", "child_track_id").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return R.tracking_summary(tracks, splits, merges)
