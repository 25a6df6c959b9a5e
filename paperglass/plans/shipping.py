"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application.

    Functions given to mapInArrow and its like are pickled by reference, so
    every worker must be able to import the modules that define them, wherever
    the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    folder = tempfile.mkdtemp(prefix=f"{name}-ship-")
    target = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, folders, files in os.walk(root):
            folders[:] = [d for d in folders if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(top, f)
                    archive.write(path, os.path.join(name, os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
