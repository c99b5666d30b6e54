"""Images: layouts, planes, projections, histograms, pyramids; long form (t, c, z, y, x, value) or chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.scalars import axis_slot, grid_size, unit_micrometres
from tracklake.operators.keys import by
from tracklake.schemas import CHUNKS

#: Amplification limits of a layout, read limit of a volume.
MAX_XY_AMPLIFICATION = 4.0
MAX_COLUMN_CHUNKS = 8
MAX_VOLUME_BYTES = 512 << 20
HISTOGRAM_BINS = 256
HISTOGRAM_MAX_SAMPLES = 1 << 22
HISTOGRAM_MAX_BYTES = 64 << 20


def analyze_layout(levels: DataFrame) -> DataFrame:
    """(dataset, level, view, bytes_needed, bytes_decoded, chunks_decoded, column_chunks, amplification, hostile).

    ``levels``: dataset, level, z, y, x, cz, cy, cx, item_bytes, and t, ct, c, cc where
    chunks span frames or channels.  A chunk is no larger than its array.  xy is hostile
    over 4 times the bytes needed; xz and yz over 8 chunks along the column.
    """

    def within(a: str) -> Column:
        return F.least(F.greatest(F.col(f"c{a}"), F.lit(1)), F.greatest(F.col(a), F.lit(1)))

    grid = levels.withColumns({f"g{a}": grid_size(F.col(a), F.col(f"c{a}")) for a in "zyx"})
    chunk = F.col("item_bytes")
    for a in ("t", "c", "z", "y", "x"):
        if f"c{a}" in levels.columns:
            chunk = chunk * within(a)
    views = F.explode(F.array(*[
        F.struct(F.lit(v).alias("view"), (F.col(a) * F.col(b) * F.col("item_bytes")).alias("bytes_needed"), (F.col(f"g{a}") * F.col(f"g{b}")).alias("chunks_decoded"), (F.lit(1).cast("long") if v == "xy" else F.col("gz")).alias("column_chunks"))
        for v, a, b in (("xy", "y", "x"), ("xz", "z", "x"), ("yz", "z", "y"))
    ]))
    out = grid.select("dataset", "level", chunk.alias("chunk_bytes"), views.alias("v")).select("dataset", "level", "chunk_bytes", "v.*")
    out = out.withColumn("bytes_decoded", F.col("chunks_decoded") * F.col("chunk_bytes"))
    out = out.withColumn("amplification", F.when(F.col("bytes_needed") == 0, 1.0).otherwise(F.try_divide("bytes_decoded", "bytes_needed")))
    hostile = F.when(F.col("view") == "xy", F.col("amplification") > MAX_XY_AMPLIFICATION).otherwise(F.col("column_chunks") > MAX_COLUMN_CHUNKS)
    return out.withColumn("hostile", hostile).drop("chunk_bytes")


def level_factors(levels: DataFrame) -> DataFrame:
    """(dataset, level, fz, fy, fx): scale relative to level 0, else the ratio of extents; ``levels`` has z, y, x and scale_z, scale_y, scale_x (or null).

    The scales count only if those of y and x are finite at both levels, and not 0 at
    level 0; z is then 1 where it has none.  Else all axes go by their extents (1
    where a level has none).
    """
    own = by(levels)
    base = levels.where("level = 0").select(*own, *[F.col(c).alias(f"b_{c}") for c in ("z", "y", "x", "scale_z", "scale_y", "scale_x")])
    both = levels.join(base, own, "left") if own else levels.join(F.broadcast(base))  # one row

    def finite(c: str) -> Column:
        return F.abs(F.nanvl(F.col(c), F.lit(None).cast("double"))) < float("inf")

    by_scale = {a: F.when(finite(f"scale_{a}") & finite(f"b_scale_{a}") & (F.col(f"b_scale_{a}") != 0), F.col(f"scale_{a}") / F.col(f"b_scale_{a}")) for a in "zyx"}
    usable = by_scale["y"].isNotNull() & by_scale["x"].isNotNull()
    by_extent = {a: F.coalesce(F.try_divide(F.col(f"b_{a}").cast("double"), F.col(a)), F.lit(1.0)) for a in "zyx"}
    factor = [F.when(usable, F.coalesce(by_scale[a], F.lit(1.0))).otherwise(by_extent[a]).alias(f"f{a}") for a in "zyx"]
    return both.select(*own, "level", *factor)


def resolve_axes(stores: DataFrame) -> DataFrame:
    """Adds axes (order kept), t, c, z, y, x extents (absent axes are 1) and ``ok``; false if the axes are no ordered subset of tczyx with y and x.

    ``stores``: names ARRAY<STRING> or null, shape ARRAY<BIGINT>, and optionally
    dim_names, the array's own.  Names are told by their aliases and bind; the
    array's own names count only where all are known and as many as dimensions; else
    the number of dimensions decides: yx, zyx, czyx, tczyx.
    """
    n = F.size("shape")
    usual = F.when(n == 2, F.lit("yx")).when(n == 3, F.lit("zyx")).when(n == 4, F.lit("czyx")).when(n == 5, F.lit("tczyx"))

    def spelled(names: str) -> Column:
        letters = F.transform(names, lambda x: F.coalesce(F.substring(F.lit("tczyx"), axis_slot(x).cast("int") + 1, F.lit(1)), F.lit("?")))
        return F.array_join(letters, "")

    text = usual
    if "dim_names" in stores.columns:
        text = F.when((F.size("dim_names") == n) & ~spelled("dim_names").contains("?"), spelled("dim_names")).otherwise(usual)
    out = stores.withColumn("axes", F.when(F.col("names").isNotNull(), spelled("names")).otherwise(text))
    out = out.withColumn("ok", F.coalesce(F.col("axes").rlike("^t?c?z?yx$") & (F.length("axes") == n), F.lit(False)))
    return out.withColumns({a: F.when(F.col("ok"), F.coalesce(F.get("shape", F.locate(a, F.col("axes")) - 1), F.lit(1))) for a in "tczyx"})


def ortho_plane(voxels: DataFrame, axis: str, t: int, index: int, channels: list[int]) -> DataFrame:
    """(c, row, col, value) of one plane in long form; the filter reaches the scan."""
    rows = {"z": ("y", "x"), "y": ("z", "x"), "x": ("z", "y")}[axis]
    hit = voxels.where((F.col("t") == t) & (F.col(axis) == index) & F.col("c").isin(channels))
    return hit.select(*by(voxels), "c", F.col(rows[0]).alias("row"), F.col(rows[1]).alias("col"), "value")


def volume(voxels: DataFrame, levels: DataFrame, t: int, c: int, limit: int = MAX_VOLUME_BYTES) -> DataFrame:
    """(z, y, x, value) of one time point and channel; refused from the catalog if one is over ``limit`` bytes, before any read."""
    size = levels.select(F.max(F.col("z") * F.col("y") * F.col("x") * F.col("item_bytes"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"the volume has {size} bytes, more than {limit}")
    return voxels.where((F.col("t") == t) & (F.col("c") == c)).select(*by(voxels), "z", "y", "x", "value")


def sample_points(voxels: DataFrame, points: DataFrame, dims: dict[str, int]) -> DataFrame:
    """``points`` (id, t, c, z, y, x) with value and, out of bounds, the name of the first bad axis.

    The two meet by a merge join: Spark takes voxels made by ``explode`` for as few as
    the rows they came from, and would send a whole image to every task.
    """
    own = by(voxels, points)
    bad = F.coalesce(*[F.when(~F.col(a).between(0, dims[a] - 1), F.lit(a)) for a in "tczyx"], F.lit(None).cast("string"))
    marked = points.withColumn("bad_axis", bad)
    return marked.join(voxels.hint("merge"), [*own, *"tczyx"], "left").select(*own, "id", F.when(F.col("bad_axis").isNull(), F.coalesce("value", F.lit(0))).alias("value"), "bad_axis")


def histogram(voxels: DataFrame, ceiling: int = 65535, brick: tuple[int, int, int] | None = None, max_samples: int = HISTOGRAM_MAX_SAMPLES) -> DataFrame:
    """(t, c, bin, n, least, most, samples): 256 bins over the range of the type.

    The sampling is the feature's own: with ``brick`` (z, y, x sizes) every k-th voxel
    in brick order is taken, counted anew in each brick, where k keeps the samples of
    a (t, c) within ``max_samples``.  :func:`sampled_histogram` also leaves whole
    bricks unread.
    """
    own = [*by(voxels), "t", "c"]
    taken = voxels
    if brick:
        where = [F.expr(f"{a} div {n}") for a, n in zip("zyx", brick, strict=True)]
        total = voxels.groupBy(*own).agg(F.count("*").alias("tl_all"))
        place = F.row_number().over(Window.partitionBy(*own, *where).orderBy("z", "y", "x")) - 1
        taken = voxels.withColumn("tl_place", place).join(total, own).where(F.col("tl_place") % F.greatest(F.lit(1), F.ceil(F.col("tl_all") / max_samples)) == 0)
    binned = taken.groupBy(*own, F.least(F.lit(HISTOGRAM_BINS - 1), F.floor(F.col("value") * HISTOGRAM_BINS / (ceiling + 1))).cast("long").alias("bin"))
    return _spread_over(binned.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")), own)


def _spread_over(counts: DataFrame, own: list[str]) -> DataFrame:
    """Bins with the least, most and number of samples of their image."""
    every = Window.partitionBy(*own)
    return counts.select(*own, "bin", "n", F.min("lo").over(every).alias("least"), F.max("hi").over(every).alias("most"), F.sum("n").over(every).alias("samples"))


def histogram_plan(levels: DataFrame, max_bytes: int = HISTOGRAM_MAX_BYTES, max_samples: int = HISTOGRAM_MAX_SAMPLES) -> DataFrame:
    """(dataset, level, gz, gy, gx, voxel_stride): the bricks of the coarsest level that a histogram reads, planned from the catalogue alone.

    ``levels``: level, z, y, x, cz, cy, cx, item_bytes.  Every k-th brick in grid order
    keeps the bytes decoded within ``max_bytes``, then every j-th voxel of those
    bricks the samples within ``max_samples``.
    """
    own = by(levels)
    coarsest = levels.groupBy(*own).agg(F.max_by(F.struct(*[c for c in levels.columns if c not in own]), "level").alias("l")).select(*own, "l.*")
    grid = coarsest.withColumns({f"g{a}": grid_size(F.col(a), F.col(f"c{a}")) for a in "zyx"})
    voxels = F.col("cz") * F.col("cy") * F.col("cx")
    total = F.col("gz") * F.col("gy") * F.col("gx")
    grid = grid.withColumn("k", F.greatest(F.lit(1), F.ceil(total * F.greatest(F.lit(1), voxels * F.col("item_bytes")) / max_bytes)).cast("long"))
    grid = grid.withColumn("voxel_stride", F.greatest(F.lit(1), F.ceil(F.ceil(total / F.col("k")) * voxels / max_samples)).cast("long"))
    picked = grid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), (total - 1).cast("long"), F.col("k"))))
    return picked.select(*own, "level", F.expr("i div (gy * gx)").alias("tl_z"), F.expr("i div gx % gy").alias("tl_y"), F.expr("i % gx").alias("tl_x"), "voxel_stride").toDF(*own, "level", "gz", "gy", "gx", "voxel_stride")


def sampled_histogram(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """(t, c, bin, n, least, most, samples) of the chunks that :func:`histogram_plan` picked, every ``voxel_stride``-th voxel of each."""
    own = by(chunks, plan)
    key = [*own, "level", "gz", "gy", "gx"]
    picked = chunks.join(plan.withColumn("level", F.col("level").cast("int")), key)
    return _binned(picked, [*own, "t", "c"])


def _binned(chunks: DataFrame, own: list[str]) -> DataFrame:
    """One bincount for each chunk, added up in each task before anything is shuffled; every voxel, or each ``voxel_stride``-th where there is that column."""
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in own) + ", bin long, n long, lo long, hi long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kinds = None

        def flush() -> pa.RecordBatch:
            rows = [(*key, b, int(n[b]), int(lo[b]), int(hi[b])) for key, (n, lo, hi) in held.items() for b in np.flatnonzero(n).tolist()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*own, "bin", "n", "lo", "hi"])

        for batch in batches:
            kinds = [*[batch.schema.field(c).type for c in own], *[pa.int64()] * 4]
            for row, array in _arrays_of(batch):
                values = array.ravel()[:: row.get("voxel_stride") or 1]
                bins = (values.astype(np.uint64) * HISTOGRAM_BINS // (int(np.iinfo(array.dtype).max) + 1)).astype(np.int64)
                key = tuple(row[c] for c in own)
                if key not in held:
                    held[key] = [np.zeros(HISTOGRAM_BINS, np.int64), np.full(HISTOGRAM_BINS, np.iinfo(np.int64).max), np.full(HISTOGRAM_BINS, -1)]
                n, lo, hi = held[key]
                n += np.bincount(bins, minlength=HISTOGRAM_BINS)
                np.minimum.at(lo, bins, values.astype(np.int64))
                np.maximum.at(hi, bins, values.astype(np.int64))
                if len(held) >= 1024:
                    yield flush()
        if held:
            yield flush()

    counts = chunks.mapInArrow(run, schema).groupBy(*own, "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _spread_over(counts, own)


def histogram_meta(counts: DataFrame, level: int, voxels_of_level: int) -> DataFrame:
    return counts.select(*by(counts), "t", "c", "samples", ((F.lit(level) > 0) | (F.col("samples") < voxels_of_level)).alias("sampled")).distinct()


def percentile_normalize(voxels: DataFrame, low: float = 1.0, high: float = 99.8, keys: tuple[str, ...] = ("t", "c")) -> DataFrame:
    """Adds ``norm`` = (value - p_low) / (p_high - p_low) with exact percentiles of each image."""
    own = [*by(voxels), *keys]
    ends = voxels.groupBy(*own).agg(F.percentile("value", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    return voxels.join(ends, own).withColumn("norm", F.coalesce(F.try_divide(F.col("value") - F.col("p")[0], F.col("p")[1] - F.col("p")[0]), F.lit(0.0))).drop("p")


def z_project(voxels: DataFrame, mode: str) -> DataFrame:
    fold = {"max": F.max, "min": F.min, "sum": F.sum}[mode]
    return voxels.groupBy(*by(voxels), "t", "c", "y", "x").agg(fold("value").alias("value"))


def downsample_yx(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """Means of 2 x 2 pixels, odd edges cropped, rounded half to even."""
    inside = voxels.where((F.col("y") < height // 2 * 2) & (F.col("x") < width // 2 * 2))
    return inside.groupBy(*by(voxels), "t", "c", "z", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.rint(F.avg("value")).cast("long").alias("value"))


def choose_z_size(voxels: DataFrame, declared: int | None, stored: int) -> DataFrame:
    """(t, c, z_size): declared planes, or all stored ones if a plane past the declared ones holds a value; a declared number that is missing, not positive or over the stored one counts for nothing."""
    own = [*by(voxels), "t", "c"]
    if declared is None or not 0 < declared < stored:
        return voxels.select(*own).distinct().withColumn("z_size", F.lit(stored).cast("long"))
    used = F.max(F.when(F.col("value") != 0, F.col("z")))
    return voxels.groupBy(*own).agg(F.when(F.coalesce(used, F.lit(-1)) >= declared, stored).otherwise(declared).cast("long").alias("z_size"))


def level_shapes(images: DataFrame, least: int = 256, item_bytes: int = 2) -> DataFrame:
    """(dataset, level, z, y, x, bytes): y and x halve while the smaller is over ``least``; ``images`` has dataset, t, c, z, y, x."""
    side = F.least("y", "x").cast("double")
    # halving keeps floor(n / 2**k): count the k whose predecessor is still larger than the limit
    count = F.size(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: F.floor(side / F.pow(F.lit(2.0), k)) > least))
    out = images.select("*", F.explode(F.sequence(F.lit(0), count)).alias("level"))
    half = {a: F.floor(F.col(a) / F.pow(F.lit(2.0), F.col("level"))).cast("long") for a in "yx"}
    return out.withColumns(half).select("dataset", "level", "z", "y", "x", (F.col("t") * F.col("c") * F.col("z") * F.col("y") * F.col("x") * item_bytes).alias("bytes"))


def build_pyramid(voxels: DataFrame, height: int, width: int, least: int = 256) -> DataFrame:
    """Voxels of all levels with a ``level`` column, each halved from the one before."""
    out, level, now = voxels.withColumn("level", F.lit(0)), 0, voxels
    while min(height, width) > least:
        now, level = downsample_yx(now, height, width), level + 1
        height, width = height // 2, width // 2
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out


def to_world(cells: DataFrame, scale: tuple[float, float, float] | None, axis_scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds wz, wy, wx: an x pixel is one unit, y and z by voxel size (isotropic without one) times the display scale."""
    sz, sy, sx = scale if scale and all(0 < s < float("inf") for s in scale) else (1.0, 1.0, 1.0)
    unit = {"z": sz / sx * axis_scale[0], "y": sy / sx * axis_scale[1], "x": axis_scale[2]}
    return cells.withColumns({f"w{a}": F.col(a) * unit[a] for a in "zyx"})


def voxel_size_um(info: DataFrame) -> DataFrame:
    """Adds size_z, size_y, size_x in micrometres: physical extent over voxels, 1.0 where either is missing or 0; ``info`` has ext_*, n_*, unit."""
    size = {f"size_{a}": F.coalesce(F.when((F.col(f"ext_{a}") != 0) & (F.col(f"n_{a}") != 0), F.abs(f"ext_{a}") * unit_micrometres(F.col("unit")) / F.col(f"n_{a}")), F.lit(1.0)) for a in "zyx"}
    return info.withColumns(size)


def check_contract(label_levels: DataFrame, image_levels: DataFrame) -> DataFrame:
    """(dataset, level, reason): label levels that do not mirror the image (u32, same levels and extents, one channel, TCZYX)."""
    lb = label_levels.select("dataset", "level", F.lit(True).alias("has_l"), "dtype", F.col("axes").alias("l_axes"), *[F.col(a).alias(f"l_{a}") for a in "tczyx"])
    im = image_levels.select("dataset", "level", F.lit(True).alias("has_i"), *[F.col(a).alias(f"i_{a}") for a in "tczyx"])
    both = lb.join(im, ["dataset", "level"], "full")
    same = F.lit(True)
    for a in "tzyx":
        same = same & (F.col(f"l_{a}") == F.col(f"i_{a}"))
    reason = F.when(F.col("has_l").isNull(), "missing level").when(F.col("has_i").isNull(), "extra level").when(F.col("dtype") != "u32", "dtype").when(F.col("l_axes") != "tczyx", "axes").when(F.col("l_c") != 1, "channels").when(~same, "extent")
    return both.select("dataset", "level", reason.alias("reason")).where("reason IS NOT NULL")


# --- chunk kernels -----------------------------------------------------------

_DTYPES = {"u8": np.uint8, "u16": np.uint16, "u32": np.uint32}
Kernel = Callable[[dict, np.ndarray], Iterator[dict]]
#: Bytes of arrays, and rows, that a task gathers before it hands a batch on.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096
BRICK = ("gz", "gy", "gx")


def _arrays_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """(row without data, zyx array) of each chunk; the array reads the batch's own bytes."""
    at = batch.schema.get_field_index("data")
    data = batch.column(at)
    for i, row in enumerate(batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()):
        yield row, np.frombuffer(data[i].as_buffer(), _DTYPES[row["dtype"]]).reshape(row["nz"], row["ny"], row["nx"])


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def gathered(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of many, so small chunks do not make a batch each and large ones do not pile up."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("data") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def with_movie(frame: DataFrame, schema: str) -> str:
    return ", ".join([*[f"{c} {frame.schema[c].dataType.simpleString()}" for c in by(frame)], schema])


def map_chunks(chunks: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """Run ``kernel(row, array)`` on each chunk; rows are dicts without ``data``, arrays are zyx.  A ``dataset`` column goes along."""
    own = by(chunks)
    schema = with_movie(chunks, schema)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ({**{c: row[c] for c in own}, **out} for batch in batches for row, array in _arrays_of(batch) for out in kernel(row, array))
        return gathered(made, target)

    return chunks.mapInArrow(run, schema)


def chunk_voxels(chunks: DataFrame) -> DataFrame:
    """Long form of chunks; a batch holds the voxels of many."""
    own = by(chunks)
    names = [*own, "t", "c", "z", "y", "x", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[tuple, np.ndarray] = {}
        for batch in batches:
            held, movies, size = [], [], 0

            def flush() -> pa.RecordBatch:
                block = np.concatenate(held, axis=1)
                movie = [pa.array(np.repeat(np.array([m[i] for m, _ in movies], object), [n for _, n in movies]), batch.schema.field(c).type) for i, c in enumerate(own)]
                return pa.RecordBatch.from_arrays([*movie, *[pa.array(column) for column in block]], names)

            for row, array in _arrays_of(batch):
                shape = array.shape
                if shape not in grids:
                    grids[shape] = np.indices(shape).reshape(3, -1)
                block = np.empty((6, array.size), np.int64)
                block[0], block[1], block[5] = row["t"], row["c"], array.ravel()
                block[2:5] = grids[shape] + np.array([[row[f"o{k}"]] for k in "zyx"])
                held.append(block)
                movies.append((tuple(row[c] for c in own), array.size))
                size += array.size
                if size >= 1 << 18:
                    yield flush()
                    held, movies, size = [], [], 0
            if held:
                yield flush()

    return chunks.mapInArrow(run, with_movie(chunks, "t long, c long, z long, y long, x long, value long"))


def _sized(frame: DataFrame, dims: tuple[int, int, int] | DataFrame) -> DataFrame:
    """Adds the extents tl_z, tl_y, tl_x of the image: one for all, or (dataset, z, y, x) of each movie."""
    if isinstance(dims, tuple):
        return frame.withColumns({f"tl_{a}": F.lit(d).cast("long") for a, d in zip("zyx", dims, strict=True)})
    own = by(frame, dims)
    return frame.join(dims.select(*own, *[F.col(a).alias(f"tl_{a}") for a in "zyx"]), own)


def _fold_bricks(pieces: DataFrame, key: list[str], brick: tuple[int, int, int], put: Callable[[np.ndarray, pa.RecordBatch, int, int], None], extra: list[str]) -> DataFrame:
    """Chunks from rows that carry a brick's ``key``, extents tl_z, tl_y, tl_x and dtype.

    Rows are dealt and sorted by brick; each task carries the open brick from batch
    to batch, lets ``put(array, batch, from, to)`` place the rows of a run, and hands
    on many bricks at a time.  One brick is open in a task, however small or large
    bricks are, and a brick may span batches.
    """
    schema = with_movie(pieces, CHUNKS)
    target = arrow_schema(schema)
    head = [*key, "tl_z", "tl_y", "tl_x", "dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, array = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(c) for c in head]
                change = np.zeros(batch.num_rows, bool)
                change[0] = True
                for column in columns:
                    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    change[1:] |= codes[1:] != codes[:-1]
                cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    name = tuple(c[lo].as_py() for c in columns)
                    if name != now:
                        if now is not None:
                            yield finished(now, array)
                        now = name
                        row = dict(zip(head, name, strict=True))
                        array = np.zeros([min(b, row[f"tl_{a}"] - row[f"g{a}"] * b) for a, b in zip("zyx", brick, strict=True)], _DTYPES[row["dtype"]])
                    put(array, batch, lo, hi)
            if now is not None:
                yield finished(now, array)

        def finished(name: tuple, array: np.ndarray) -> dict:
            row = dict(zip(head, name, strict=True))
            place = {f"o{a}": row[f"g{a}"] * b for a, b in zip("zyx", brick, strict=True)} | {f"n{a}": n for a, n in zip("zyx", array.shape, strict=True)}
            return {**{k: row[k] for k in key}, **place, "dtype": row["dtype"], "data": array.tobytes()}

        return gathered(rows(), target)

    # an explicit number: partitions that are small as voxels are not merged, since what is made of them is large
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.select(*head, *extra).repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def to_chunks(voxels: DataFrame, brick: tuple[int, int, int], dims: tuple[int, int, int] | DataFrame, dtype: str = "u16", layer: str = "image", level: int = 0) -> DataFrame:
    """Chunk rows of long-form voxels; absent voxels are 0.  ``dims`` are (z, y, x), or a table (dataset, z, y, x)."""
    key = [*by(voxels), "layer", "level", "t", "c", *BRICK]
    out = _sized(voxels, dims).withColumns({f"g{a}": F.expr(f"{a} div {n}") for a, n in zip("zyx", brick, strict=True)})
    side = {a: F.least(F.lit(n), F.col(f"tl_{a}") - F.col(f"g{a}") * n) for a, n in zip("zyx", brick, strict=True)}
    place = ((F.col("z") % brick[0]) * side["y"] + F.col("y") % brick[1]) * side["x"] + F.col("x") % brick[2]
    out = out.withColumns({"layer": F.lit(layer), "level": F.lit(level), "dtype": F.lit(dtype), "tl_at": place})

    def put(array: np.ndarray, batch: pa.RecordBatch, lo: int, hi: int) -> None:
        array.reshape(-1)[batch.column("tl_at").to_numpy()[lo:hi]] = batch.column("value").to_numpy()[lo:hi]

    return _fold_bricks(out, key, brick, put, ["tl_at", "value"])


def rechunk(chunks: DataFrame, brick: tuple[int, int, int], dims: tuple[int, int, int] | DataFrame) -> DataFrame:
    """Identical pixels in other bricks: each chunk is split into pieces keyed by target brick, which are then folded together."""
    if isinstance(dims, tuple):
        brick = tuple(min(b, d) for b, d in zip(brick, dims, strict=True))

    def split(row: dict, a: np.ndarray) -> Iterator[dict]:
        origin = [row[f"o{k}"] for k in "zyx"]
        grid = [range(o // b, (o + n - 1) // b + 1) for o, n, b in zip(origin, a.shape, brick, strict=True)]
        for g in product(*grid):
            lo = [max(o, i * b) for o, i, b in zip(origin, g, brick, strict=True)]
            hi = [min(o + n, (i + 1) * b) for o, n, i, b in zip(origin, a.shape, g, brick, strict=True)]
            part = a[tuple(slice(x - o, y - o) for x, y, o in zip(lo, hi, origin, strict=True))]
            yield {**{k: row[k] for k in ("layer", "level", "t", "c", "dtype")}, **dict(zip(BRICK, g, strict=True)), **dict(zip(("oz", "oy", "ox"), lo, strict=True)), **dict(zip(("nz", "ny", "nx"), part.shape, strict=True)), "data": part.tobytes()}

    def put(array: np.ndarray, batch: pa.RecordBatch, lo: int, hi: int) -> None:
        for row, part in _arrays_of(batch.slice(lo, hi - lo)):
            at = tuple(slice(row[f"o{k}"] - row[f"g{k}"] * b, row[f"o{k}"] - row[f"g{k}"] * b + n) for k, b, n in zip("zyx", brick, part.shape, strict=True))
            array[at] = part

    key = [*by(chunks), "layer", "level", "t", "c", *BRICK]
    return _fold_bricks(_sized(map_chunks(chunks, split, CHUNKS), dims), key, brick, put, ["oz", "oy", "ox", "nz", "ny", "nx", "data"])


def build_proxy(chunks: DataFrame, dims: tuple[int, int, int], few: int = 8) -> DataFrame:
    """One chunk for each (t, c), u8 widened to u16; u32 is refused; time points of ``few`` chunks or fewer are left out."""
    if not chunks.where("dtype = 'u32'").isEmpty():
        raise ValueError("u32 volumes have no proxy")
    own = [*by(chunks), "t", "c"]
    many = chunks.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > few).select(*own)

    def widen(row: dict, a: np.ndarray) -> Iterator[dict]:
        yield {**row, "dtype": "u16", "data": a.astype(np.uint16).tobytes()}

    return rechunk(map_chunks(chunks.join(many, own, "left_semi"), widen, CHUNKS), dims, dims)


def crosses(axis: str, index: int) -> Column:
    """Chunks that a plane goes through; works on chunk rows and, before anything is opened, on a chunk grid."""
    return (F.col(f"o{axis}") <= index) & (F.col(f"o{axis}") + F.col(f"n{axis}") > index)


def chunk_plane(chunks: DataFrame, axis: str, index: int) -> DataFrame:
    """(t, c, row, col, value) of a plane: only chunks the plane crosses are decoded, and of those only the plane becomes rows."""
    a, b = {"z": "yx", "y": "zx", "x": "zy"}[axis]
    at = "zyx".index(axis)

    def cut(row: dict, array: np.ndarray) -> Iterator[dict]:
        plane = np.take(array, [index - row[f"o{axis}"]], axis=at)
        yield {**row, f"o{axis}": index, f"n{axis}": 1, "data": plane.tobytes()}

    planes = map_chunks(chunks.where(crosses(axis, index)), cut, CHUNKS)
    return chunk_voxels(planes).select(*by(chunks), "t", "c", F.col(a).alias("row"), F.col(b).alias("col"), "value")


def chunk_histogram(chunks: DataFrame) -> DataFrame:
    """(t, c, bin, n) from all voxels of chunks."""
    own = [*by(chunks), "t", "c"]
    return _binned(chunks, own).select(*own, "bin", "n")


def segment(planes: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``predict(zyx array) -> labels`` to each chunk: the chunk table with u32 labels.  Models are the caller's."""

    def run(row: dict, a: np.ndarray) -> Iterator[dict]:
        out = np.asarray(predict(a), np.uint32)
        if out.shape != a.shape:
            raise ValueError("a prediction has the shape of its image")
        yield {**row, "layer": "labels", "dtype": "u32", "data": out.tobytes()}

    return map_chunks(planes, run, CHUNKS)
