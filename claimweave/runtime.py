"""What executors need besides Spark: this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_claimweave_package", False):
        return
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="claimweave-package-"), "claimweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._claimweave_package = True
