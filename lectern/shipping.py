"""Makes the package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application. The driver serves the archive as long as it lives."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        top = os.path.realpath(tempfile.mkdtemp(prefix="shipped-"))
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        shutil.copytree(root, f"{top}/tree/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{top}/{root.name}", "zip", f"{top}/tree"))
