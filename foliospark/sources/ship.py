"""Prepares a session: the package for its Python workers, and batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows that an Arrow batch takes: texts may be long, and the JVM and the worker each hold a batch whole.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the session's Python files, once for each Spark context, and bounds its Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_foliospark", False):
        return spark
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="foliospark-")
    archive = os.path.join(folder, "foliospark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted([*root.glob("foliospark/**/*.py"), *root.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(root))
    context.addPyFile(archive)
    context._foliospark = True
    return spark
