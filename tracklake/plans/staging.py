"""Tables that cross steps: written to the shared folder and read back, so a lost executor loses nothing and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a folder of our own in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="tracklake-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which :func:`clear` deletes with the staged tables."""
    path = f"{shared_folder(spark)}/tl-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = frame.sparkSession
    path = fresh_folder(spark, label)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._tl_path = path
    return out


def staged_count(frame: DataFrame, label: str, which: Column) -> tuple[DataFrame, int]:
    """The table as :func:`staged` stores it, and how many of its rows are ``which``, seen while it is written."""
    seen = Observation()
    out = staged(frame.observe(seen, F.count_if(which).alias("n")), label)
    return out, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._tl_path)


def clear(spark: SparkSession) -> None:
    """Delete every table this application has staged; call it when no frame that an operator returned is read any more."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)
