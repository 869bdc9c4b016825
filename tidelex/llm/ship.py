"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context; it need not be installed on the machines."""
    context = spark.sparkContext
    if getattr(context, "_tidelex_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='tidelex-code-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(path)
    context._tidelex_shipped = True
