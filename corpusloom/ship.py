"""Python workers get the package from the driver, so executors need no installation of it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corpusloom-")), "corpusloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"corpusloom/{source.relative_to(root)}")
    context.addPyFile(path)
    context._corpusloom_shipped = True
