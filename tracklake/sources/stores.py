"""Chunked array stores and image stacks as tables."""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.arrays import arrow_schema, crosses, gathered, resolve_axes, with_movie
from tracklake.operators.graph import number_rows
from tracklake.operators.keys import by
from tracklake.plans.staging import staged_count
from tracklake.schemas import CHUNKS
from tracklake.sources.files import create_file, folders_of, move_file, open_file

_ARRAY_META = (
    "shape ARRAY<BIGINT>, chunks ARRAY<BIGINT>, dtype STRING, data_type STRING, chunk_grid STRUCT<configuration: STRUCT<chunk_shape: ARRAY<BIGINT>>>, dimension_names ARRAY<STRING>, node_type STRING, "
    "dimension_separator STRING, chunk_key_encoding STRUCT<name: STRING, configuration: STRUCT<separator: STRING>>"
)
_MULTISCALE = "ARRAY<STRUCT<axes: ARRAY<STRUCT<name: STRING, unit: STRING>>, datasets: ARRAY<STRUCT<path: STRING, coordinateTransformations: ARRAY<STRUCT<type: STRING, scale: ARRAY<DOUBLE>>>>>>>"
_OMERO = "STRUCT<channels: ARRAY<STRUCT<label: STRING, color: STRING, window: STRUCT<start: DOUBLE, `end`: DOUBLE>>>>"
#: Array type names -> our tags.
DTYPES = {"|u1": "u8", "<u2": "u16", "<u4": "u32", "uint8": "u8", "uint16": "u16", "uint32": "u32"}


def _one_form(path):
    """``file:/x`` and ``file:///x`` are one path; Spark's readers give either."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _metadata(spark: SparkSession, root: str) -> DataFrame:
    """(value, folder, file) of every zarr.json, .zattrs and .zarray of groups and arrays below ``root``.

    Tasks walk the folders, one level of them in a round, and stop at arrays: their
    chunks are never listed, and neither folders nor documents pass the driver.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    start = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("folder", "file", "value", "child")])
        for batch in batches:
            rows = []
            for folder in batch.column("folder").to_pylist():
                found = {}
                for name in ("zarr.json", ".zattrs", ".zarray"):
                    try:
                        with open_file(f"{folder}/{name}") as file:
                            found[name] = file.read().decode()
                    except FileNotFoundError:
                        continue
                rows += [{"folder": folder, "file": name, "value": value} for name, value in found.items()]
                if ".zarray" not in found and not _is_array(found.get("zarr.json")):
                    rows += [{"child": f"{folder}/{name}"} for name in folders_of(folder) if name != "c"]
            yield pa.RecordBatch.from_pylist(rows, schema)

    out, here, left = None, spark.createDataFrame([(start,)], "folder string"), 1
    while left:
        seen, left = staged_count(here.repartition(parts, "folder").mapInArrow(look, "folder string, file string, value string, child string"), "walk", F.col("child").isNotNull())
        found = seen.where("file IS NOT NULL").select("value", _one_form("folder").alias("folder"), "file")
        out = found if out is None else out.unionByName(found)
        here = seen.where("child IS NOT NULL").select(F.col("child").alias("folder"))
    return out


def _is_array(document: str | None) -> bool:
    try:
        return json.loads(document or "{}").get("node_type") == "array"
    except (ValueError, AttributeError):
        return False


def _attribute(name: str):
    doc = F.col("value")
    return F.coalesce(F.get_json_object(doc, f"$.attributes.ome.{name}"), F.get_json_object(doc, f"$.ome.{name}"), F.get_json_object(doc, f"$.attributes.{name}"), F.get_json_object(doc, f"$.{name}"))


def _arrays(meta: DataFrame) -> DataFrame:
    """(array, shape, chunks, dtype, names, prefix, separator) of each array; the last two say how its chunks are named."""
    doc = F.col("value")
    is_array = (F.col("file") == ".zarray") | ((F.col("file") == "zarr.json") & (F.get_json_object(doc, "$.node_type") == "array"))
    arrays = meta.where(is_array).select(F.col("folder").alias("array"), F.from_json(doc, _ARRAY_META).alias("m"), (F.col("file") == ".zarray").alias("old"))
    plain = F.col("old") | F.coalesce(F.col("m.chunk_key_encoding.name") == "v2", F.lit(False))
    separator = F.coalesce("m.dimension_separator", "m.chunk_key_encoding.configuration.separator", F.when(plain, ".").otherwise("/"))
    arrays = arrays.select(
        "array", "m.shape", F.coalesce("m.chunks", "m.chunk_grid.configuration.chunk_shape").alias("chunks"), F.coalesce("m.dtype", "m.data_type").alias("kind"), F.col("m.dimension_names").alias("names"),
        F.when(plain, "").otherwise(F.concat(F.lit("c"), separator)).alias("prefix"), separator.alias("separator"),
    )
    tags = F.create_map(*[F.lit(x) for pair in DTYPES.items() for x in pair])
    return arrays.withColumn("dtype", F.coalesce(F.try_element_at(tags, F.col("kind")), F.col("kind"))).drop("kind")


def _groups(meta: DataFrame) -> DataFrame:
    return meta.where(F.col("file").isin("zarr.json", ".zattrs")).select("folder", _attribute("multiscales").alias("scales"), _attribute("omero").alias("omero")).where("scales IS NOT NULL")


def _named_levels(groups: DataFrame) -> DataFrame:
    """(folder, level, array, axes, scale) as the groups name them, whether or not the array is there."""
    scales = groups.select("folder", F.from_json("scales", _MULTISCALE)[0].alias("s"))
    axes = F.transform("s.axes", lambda a: a["name"])
    named = scales.select("folder", axes.alias("axes"), F.posexplode("s.datasets").alias("level", "d"))
    scale = F.get(F.filter("d.coordinateTransformations", lambda x: x["type"] == "scale"), 0)["scale"]
    return named.select("folder", F.col("level").cast("long").alias("level"), F.concat_ws("/", "folder", "d.path").alias("array"), "axes", scale.alias("scale"))


def catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(levels, channels) of every multiscale image below ``root``.

    Levels: folder, level, array, shape, chunks, dtype, axes (the group's names, else
    null), dim_names (the array's own), scale, prefix, separator.  Attributes lie
    at the group (0.4) or under the ``ome`` key (0.5); an array in no multiscale
    group is an image of one level.  Groups and arrays meet in one equi join; a level
    that has no array is left out here and named by :func:`faults`.
    """
    meta = _metadata(spark, root)
    arrays, groups = _arrays(meta).withColumnRenamed("names", "dim_names"), _groups(meta)
    named = _named_levels(groups)
    own = ["shape", "chunks", "dtype", "dim_names", "prefix", "separator"]
    levels = named.join(arrays, "array").select("folder", "level", "array", "axes", "scale", *own)
    single = arrays.join(named.select("array"), "array", "left_anti").select(F.col("array").alias("folder"), F.lit(0).cast("long").alias("level"), "array", F.lit(None).cast("array<string>").alias("axes"), F.lit(None).cast("array<double>").alias("scale"), *own)
    channels = groups.where("omero IS NOT NULL").select("folder", F.posexplode(F.from_json("omero", _OMERO)["channels"]).alias("c", "o")).select("folder", F.col("c").cast("long").alias("c"), F.col("o.label").alias("label"), F.col("o.color").alias("color"), F.col("o.window.start").alias("low"), F.col("o.window.end").alias("high"))
    return levels.unionByName(single), channels


def faults(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, fault, detail) of roots that cannot be opened whole.

    ``missing path``; ``no store`` (neither zarr.json, .zattrs nor .zarray below);
    ``no multiscales`` (nothing below is an array or names levels); ``missing level``
    (a group names a level that is not there; detail is its path).
    """
    found, absent = [], []
    for root in roots:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        (found if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else absent).append(root)
    out = spark.createDataFrame([(r, "missing path", None) for r in absent], "root string, fault string, detail string")
    for root in found:
        meta = _metadata(spark, root)
        named, arrays = _named_levels(_groups(meta)), _arrays(meta).select("array")
        kind = F.when(F.col("files") == 0, "no store").when(F.col("use") == 0, "no multiscales")
        use = F.count_if(_attribute("multiscales").isNotNull() | (F.col("file") == ".zarray") | (F.get_json_object("value", "$.node_type") == "array"))
        whole = meta.agg(F.count("*").alias("files"), use.alias("use")).select(kind.alias("fault"), F.lit(None).cast("string").alias("detail")).where("fault IS NOT NULL")
        dangling = named.join(arrays, "array", "left_anti").select(F.lit("missing level").alias("fault"), F.col("array").alias("detail"))
        out = out.unionByName(whole.unionByName(dangling).select(F.lit(root).alias("root"), "fault", "detail"))
    return out


def chunk_grid(levels: DataFrame) -> DataFrame:
    """One row for each chunk that ``levels`` (of :func:`catalog`) may store, from the catalogue alone: nothing is listed or opened.

    array, level, dtype, path, t0, nt, c0, nc (the frames and channels it holds), gz,
    gy, gx, oz, oy, ox, nz, ny, nx (cut to the level), sizes (of the stored block, in
    tczyx), and ``dataset`` where levels carry it.  Arrays have two to five dimensions
    (:func:`resolve_axes`); absent axes are 1.  Axes that cannot be resolved raise
    with the array's path.  Filters on these columns reach the rows before any chunk
    is opened.
    """
    own = by(levels)
    known = resolve_axes(levels.withColumnRenamed("axes", "names"))
    known = known.withColumns({f"b{a}": F.when(F.col("ok"), F.coalesce(F.get("chunks", F.locate(a, F.col("axes")) - 1), F.lit(1).cast("long"))) for a in "tczyx"})
    fault = F.concat(F.lit("axes of "), "array", F.lit(" cannot be resolved"))
    known = known.withColumn("array", F.when(F.col("ok"), F.col("array")).otherwise(F.raise_error(fault).cast("string")))
    grid = known.select(*own, "array", "level", "dtype", "axes", "prefix", "separator", *[F.col(a).cast("long").alias(f"s{a}") for a in "tczyx"], *[f"b{a}" for a in "tczyx"])
    for a in "tczyx":
        grid = grid.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col(f"s{a}") / F.col(f"b{a}"))).cast("long") - 1)))

    def number(letter: Column) -> Column:
        out = F.col("ix")
        for a in "tczy":
            out = F.when(letter == a, F.col(f"i{a}")).otherwise(out)
        return out.cast("string")

    letters = F.filter(F.split("axes", ""), lambda x: x != "")
    path = F.concat("array", F.lit("/"), "prefix", F.call_function("array_join", F.transform(letters, number), F.col("separator")))
    origin = {a: F.col(f"i{a}") * F.col(f"b{a}") for a in "tczyx"}
    size = {a: F.least(F.col(f"b{a}"), F.col(f"s{a}") - origin[a]) for a in "tczyx"}
    return grid.select(
        *own, "array", "level", "dtype", path.alias("path"), origin["t"].alias("t0"), size["t"].alias("nt"), origin["c"].alias("c0"), size["c"].alias("nc"), *[F.col(f"i{a}").alias(f"g{a}") for a in "zyx"],
        *[origin[a].alias(f"o{a}") for a in "zyx"], *[size[a].alias(f"n{a}") for a in "zyx"], F.array(*[f"b{a}" for a in "tczyx"]).alias("sizes"),
    )


def open_chunks(grid: DataFrame, layer: str | None = "image") -> DataFrame:
    """Chunk rows of the rows of a :func:`chunk_grid`, each task opening its own files.

    Bytes are raw, gzip or zstd.  A chunk that is not stored holds zeros and has no
    row.  Without ``layer`` a row is named by the path of its array.
    """
    own, schema = by(grid), with_movie(grid, CHUNKS)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    try:
                        with open_file(r["path"]) as file:
                            raw = file.read()
                    except FileNotFoundError:
                        continue
                    yield from _parts(r, raw, layer, own)

        return gathered(rows(), target)

    return grid.repartition("path").mapInArrow(run, schema)


def _parts(r: dict, raw: bytes, layer: str | None, own: list[str]) -> Iterator[dict]:
    """The zyx arrays of one stored chunk, one for each frame and channel in it."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
    a = np.frombuffer(raw, {"u8": "<u1", "u16": "<u2", "u32": "<u4"}[r["dtype"]]).reshape(r["sizes"])
    for dt in range(r["nt"]):
        for dc in range(r["nc"]):
            part = a[dt, dc, : r["nz"], : r["ny"], : r["nx"]]
            yield {**{k: r[k] for k in (*own, "level", "gz", "gy", "gx", "oz", "oy", "ox", "nz", "ny", "nx", "dtype")}, "layer": layer or r["array"], "t": r["t0"] + dt, "c": r["c0"] + dc, "data": np.ascontiguousarray(part).tobytes()}


def read_chunks(levels: DataFrame, layer: str | None = "image", t: int | None = None, c: int | None = None, plane: tuple[str, int] | None = None) -> DataFrame:
    """Chunk rows of ``levels``, of one frame, channel or plane (axis, index) if asked: only their chunks are opened (V4, V5)."""
    grid = chunk_grid(levels)
    for value, first, n in ((t, "t0", "nt"), (c, "c0", "nc")):
        if value is not None:
            grid = grid.where((F.col(first) <= value) & (F.col(first) + F.col(n) > value))
    if plane:
        grid = grid.where(crosses(*plane))
    out = open_chunks(grid, layer)
    for value, name in ((t, "t"), (c, "c")):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def missing_chunks(levels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(level, t, c, gz, gy, gx) of the grid that is not stored; ``levels`` has level, t, c, z, y, x, cz, cy, cx."""
    grid = levels.select(*by(levels, chunks), "level", *[F.sequence(F.lit(0).cast("long"), F.col(a) - 1).alias(a) for a in "tc"], *[F.sequence(F.lit(0).cast("long"), F.ceil(F.col(a) / F.col(f"c{a}")) - 1).alias(f"g{a}") for a in "zyx"])
    for c in ("t", "c", "gz", "gy", "gx"):
        grid = grid.withColumn(c, F.explode(c))
    return grid.join(chunks.select(*grid.columns), grid.columns, "left_anti")


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    """(t, shape, dtype, data) of .npy files, numbered in path order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    order = number_rows(files.select("path"), ["path"], "t", 0).select("path", F.col("t").cast("long").alias("t"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(x.as_py())) for x in batch.column("content")]
            yield pa.RecordBatch.from_pydict({
                "path": batch.column("path"), "shape": pa.array([list(a.shape) for a in arrays], pa.list_(pa.int64())), "dtype": pa.array([str(a.dtype) for a in arrays]), "data": pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary()),
            })

    return files.select("path", "content").mapInArrow(load, "path string, shape array<bigint>, dtype string, data binary").join(order, "path").select("t", "shape", "dtype", "data")


def write_files(files: DataFrame) -> int:
    """Write ``data`` to ``path`` for each row, from the tasks; a file gets its name once it is whole, so a repeated task does no harm."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = f"{path}.{uuid.uuid4().hex}"
                with create_file(part) as out:
                    out.write(data)
                move_file(part, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "data").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


#: Frames of one folder of a chunk table.
FRAMES = 64


def write_chunks(chunks: DataFrame, path: str, scale: tuple[float, float, float] | None = None) -> None:
    """Parquet by movie (where there are many), layer, level and :data:`FRAMES` frames, sorted by t; one row of metadata for each level beside it.

    A plane or a time point prunes by layer and level to folders, and by t to files
    and pages through their statistics.  Folders and files grow with the bytes and with
    every 64 frames; the levels are read off what was written, so chunks are made once.
    """
    own = by(chunks)
    folder = [*own, "layer", "level", "frames"]
    placed = chunks.withColumn("frames", F.expr(f"t div {FRAMES}")).hint("rebalance", *[F.col(c) for c in folder])
    placed.sortWithinPartitions(*folder, "t").write.mode("overwrite").partitionBy(*folder).parquet(f"{path}/chunks")
    written = read_written_chunks(chunks.sparkSession, path, chunks.schema["dataset"].dataType.simpleString() if own else None)
    levels = written.groupBy(*own, "layer", "level").agg(F.max(F.col("oz") + F.col("nz")).alias("z"), F.max(F.col("oy") + F.col("ny")).alias("y"), F.max(F.col("ox") + F.col("nx")).alias("x"), F.max("nz").alias("cz"), F.max("ny").alias("cy"), F.max("nx").alias("cx"), F.first("dtype").alias("dtype"))
    levels.withColumn("scale", F.lit(json.dumps(scale))).coalesce(1).write.mode("overwrite").json(f"{path}/levels")


def read_written_chunks(spark: SparkSession, path: str, movies: str | None = None) -> DataFrame:
    """Chunks of :func:`write_chunks`; ``movies`` is the type of the dataset column, where they have one."""
    schema = CHUNKS + (f", dataset {movies}" if movies else "")
    return spark.read.schema(f"{schema}, frames BIGINT").parquet(f"{path}/chunks").select([c.split()[0] for c in schema.split(", ")])
