"""Executors' Python workers need this package; the driver sends it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for an application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId not in _shipped and root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="ship")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
