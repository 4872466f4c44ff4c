"""Python workers need the package; a session started elsewhere may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_voxelspark_shipped", False):
        return
    sc._voxelspark_shipped = True
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # itself imported from an archive that was sent
        return
    archive = Path(tempfile.mkdtemp(prefix="voxelspark-")) / "voxelspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
