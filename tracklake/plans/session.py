"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (a zip of its sources)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="tracklake-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as packed:
        for p in sorted(root.rglob("*.py")):
            packed.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
