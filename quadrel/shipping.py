"""The package for the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per context: workers need not share the driver's folders or path."""
    sc = spark.sparkContext
    if getattr(sc, "_quadrel_shipped", False):
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        copy = Path(tmp, "in", here.name)
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="quadrel-"), here.name)), "zip", copy.parent)
    sc.addPyFile(archive)
    sc._quadrel_shipped = True
