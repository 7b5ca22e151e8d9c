"""Brings this package to the executors' Python workers, where a cluster has not installed it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpuslens-")) / "corpuslens.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _done.add(context.applicationId)
