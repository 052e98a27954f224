"""Getting this package to the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that every executor sees, under spark.checkpoint.dir; a local one only where the session names none and there is one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named and not _own:
        _own.append(tempfile.mkdtemp(prefix="patchwell-"))
    return f"{named or _own[0]}/patchwell-tables/{spark.sparkContext.applicationId}"


def ship(spark: SparkSession) -> None:
    """Send the package's modules (a few KB) to the workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="patchwell-"), "patchwell_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
