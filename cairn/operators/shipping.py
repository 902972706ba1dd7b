"""Sending the package to Python workers that don't have it installed."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

import cairn


def ship(spark: SparkSession) -> str:
    """Zips the package on the driver and adds it to the session's Python files, so that workers started in any folder can import it.

    Spark serves the file from the driver; where the package is installed on the workers, or given by ``--py-files``, it is not needed.
    """
    root = Path(cairn.__file__).resolve().parent
    path = Path(mkdtemp(prefix="spark-")) / f"cairn-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)
