"""Sending the package to Spark's Python workers."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Hand the named packages of this repository to all workers, once per application.

    The archive is written where the driver runs and is only read there; Spark serves it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="shelfspark-code-")) / "shelfspark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for package in packages or ("shelfspark",):
            for file in sorted((root / package).rglob("*.py")):
                archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
