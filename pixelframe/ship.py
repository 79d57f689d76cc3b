"""Makes this package importable in the Python workers of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once for each application.

    Spark serves the archive from the driver, so workers need neither the
    repository on their path nor a shared folder.
    """
    context = spark.sparkContext
    here = Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not here.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="pixelframe-")) / "pixelframe-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
