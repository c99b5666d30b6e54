"""Array stores and stacks for the queries that read them, written from tasks."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.sources.stores import DTYPES, write_files


def write_arrays(chunks: DataFrame, path: str, brick: tuple[int, int, int], scale: tuple[float, float, float], version: int = 3) -> None:
    """One store of one level for each value of ``image`` of chunk rows, as ``path/image-N.zarr``, in format version 2 or 3.

    Each chunk row becomes one gzip file of the full brick, padded with zeros at the edges.
    """
    kinds = {tag: (name, np.dtype(name)) for name, tag in DTYPES.items() if name.startswith(("<", "|"))}
    long_names = {tag: name for name, tag in DTYPES.items() if name.startswith("u")}
    axes = [{"name": a} for a in "tczyx"]

    def data_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = [], []
            for r in batch.to_pylist():
                full = np.zeros(brick, kinds[r["dtype"]][1])
                full[: r["nz"], : r["ny"], : r["nx"]] = np.frombuffer(r["data"], full.dtype).reshape(r["nz"], r["ny"], r["nx"])
                at = [str(r[k]) for k in ("t", "c", "gz", "gy", "gx")]
                paths.append(f"{path}/image-{r['image']}.zarr/0/" + ("c/" + "/".join(at) if version == 3 else ".".join(at)))
                data.append(gzip.compress(full.tobytes(), mtime=0))
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "data": pa.array(data, pa.binary())})

    def metadata_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = [], []
            for r in batch.to_pylist():
                root, shape, blocks = f"{path}/image-{r['image']}.zarr", [r[k] for k in "tczyx"], [1, 1, *brick]
                scales = [{"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0, *scale]}]}]}]
                if version == 3:
                    files = {"zarr.json": {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": scales}}}}
                    files["0/zarr.json"] = {
                        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": long_names[r["dtype"]], "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": blocks}},
                        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 9}}],
                    }
                else:
                    files = {".zgroup": {"zarr_format": 2}, ".zattrs": {"multiscales": scales}}
                    files["0/.zarray"] = {"zarr_format": 2, "shape": shape, "chunks": blocks, "dtype": kinds[r["dtype"]][0], "fill_value": 0, "order": "C", "filters": None, "compressor": {"id": "gzip", "level": 9}}
                for name, document in files.items():
                    paths.append(f"{root}/{name}")
                    data.append(json.dumps(document).encode())
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "data": pa.array(data, pa.binary())})

    write_files(chunks.mapInArrow(data_files, "path string, data binary"))
    ends = [F.max(F.col(f"o{a}") + F.col(f"n{a}")).alias(a) for a in "zyx"]
    heads = chunks.groupBy("image").agg((F.max("t") + 1).alias("t"), (F.max("c") + 1).alias("c"), *ends, F.first("dtype").alias("dtype"))
    write_files(heads.mapInArrow(metadata_files, "path string, data binary"))


def write_stack(planes: DataFrame, path: str) -> None:
    """One .npy file for each row (t, shape, dtype, data), named so that path order is the order of t."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = [], []
            for r in batch.to_pylist():
                out = io.BytesIO()
                np.save(out, np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]))
                paths.append(f"{path}/{r['t']:020d}.npy")
                data.append(out.getvalue())
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "data": pa.array(data, pa.binary())})

    write_files(planes.select("t", "shape", "dtype", "data").mapInArrow(save, "path string, data binary"))
