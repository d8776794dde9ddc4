"""Makes the package importable in Python workers that were not started where it lies."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_LOCK = threading.Lock()
_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    with _LOCK:
        if context.applicationId not in _DONE:
            root = os.path.dirname(os.path.abspath(__file__))
            path = os.path.join(tempfile.mkdtemp(prefix="tractlake-"), "tractlake.zip")
            with zipfile.ZipFile(path, "w") as archive:
                for folder, _, names in os.walk(root):
                    for name in names:
                        if name.endswith(".py"):
                            full = os.path.join(folder, name)
                            archive.write(full, os.path.join("tractlake", os.path.relpath(full, root)))
            context.addPyFile(path)
            _DONE.add(context.applicationId)
    return spark
