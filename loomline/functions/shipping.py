"""Give executors this package, so that Python functions named by reference import there too."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once; a few hundred kB."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    name = os.path.basename(_PACKAGE)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, _PACKAGE)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "1m") -> None:
    """Bound an Arrow batch by rows and bytes, so that a worker's lists of texts, pieces and statistics don't grow with its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
