"""Files that tasks read and write by path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(path: str):
    """(file system, path in it); local paths are taken as they are, with whatever signs they hold."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path)
    return fs.FileSystem.from_uri(path)


def open_file(path: str, compression: str | None = None):
    system, where = _at(path)
    return system.open_input_stream(where, compression=compression)


def folders_of(path: str) -> list[str]:
    """Names of the folders in a folder."""
    from pyarrow import fs

    system, where = _at(path)
    return [x.base_name for x in system.get_file_info(fs.FileSelector(where)) if x.type == fs.FileType.Directory]


def create_file(path: str):
    system, where = _at(path)
    system.create_dir(where.rsplit("/", 1)[0])
    return system.open_output_stream(where, compression=None)


def move_file(path: str, to: str) -> None:
    system, where = _at(path)
    system.move(where, _at(to)[1])


def remove_files(files: DataFrame) -> None:
    """Delete the files named by ``file``, from the tasks; one that is gone already is no fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, where = _at(path)
                try:
                    system.delete_file(where)
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.mapInArrow(run, "n long").agg(F.sum("n")).collect()
