"""Sets of tables that change together or not at all.

A set is a folder: Parquet below ``data/``, which nothing refers to until a manifest
names it, and manifests ``manifest-N.json``, of which the newest counts.  A manifest
lists the data folders of each table, the last batch of each source, and the store
the tables were made from.  A writer that dies half way leaves data that no reader
sees; a batch that is written again is passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = "manifest-%010d.json"


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _newest(spark: SparkSession, folder: str) -> dict:
    system, where = _system(spark, folder)
    empty = {"version": 0, "tables": {}, "batches": {}, "store": None}
    if not system.exists(where):
        return empty
    names = sorted(x.getPath().getName() for x in system.listStatus(where) if x.getPath().getName().startswith("manifest-"))
    if not names:
        return empty
    stream = system.open(_system(spark, f"{folder}/{names[-1]}")[1])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    """The new manifest appears whole under its number, or not at all if another writer has taken it."""
    system, part = _system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = system.create(part)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    name = _system(spark, f"{folder}/{_NAME % manifest['version']}")[1]
    if system.exists(name) or not system.rename(part, name):
        system.delete(part, False)
        raise RuntimeError(f"{folder}: another writer has published version {manifest['version']}")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], source: str | None = None, batch: int | None = None, store: str | None = None, append: bool = False) -> bool:
    """Swap in ``tables`` (or add their rows) together; False, and nothing is done, if ``source`` has published ``batch`` or a later one already.

    Tables that are not named stay as they are.  ``store`` is the identity of what
    the tables were made from (kept where it is None).
    """
    now = _newest(spark, folder)
    if source is not None and now["batches"].get(source, -1) >= batch:
        return False
    for name, frame in tables.items():
        path = f"{folder}/data/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        held = now["tables"].get(name, {"parts": []})["parts"] if append else []
        now["tables"][name] = {"schema": frame.schema.json(), "parts": [*held, path]}
    if source is not None:
        now["batches"][source] = batch
    now["store"] = now["store"] if store is None else store
    _commit(spark, folder, now | {"version": now["version"] + 1})
    return True


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table as of the newest manifest; an empty one of ``schema`` where it was never published."""
    from pyspark.sql.types import StructType

    found = _newest(spark, folder)["tables"].get(name)
    if found is None:
        if schema is None:
            raise ValueError(f"{folder} has no table {name}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(*found["parts"])


def store_of(spark: SparkSession, folder: str) -> str | None:
    """The store that the tables were made from."""
    return _newest(spark, folder)["store"]
