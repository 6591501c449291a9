"""Make this package importable in every Python worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Serve the package to the executors as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="algoscape"), "algoscape_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
