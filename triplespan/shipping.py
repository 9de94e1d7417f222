"""Sends this package to the workers of a session, so that functions that Spark pickles by name can be imported there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Adds the package as a zip file to the application, once; a no-op from then on."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="triplespan-")) / "triplespan.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
