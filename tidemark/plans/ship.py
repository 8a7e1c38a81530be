"""Send this package to the executors' Python workers, and size the batches that they get."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()
#: Spark's limit for the bytes of a batch that a Python worker gets, and the one set here: an executor holds a few batches for each task outside its heap.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package, added to every worker's import path. Batches are limited unless the session has a limit of its own."""
    if BATCH_LIMIT not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    stage = Path(folder) / "stage"
    shutil.copytree(package, stage / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, "tidemark_package"), "zip", stage)
    shutil.rmtree(stage)
    spark.sparkContext.addPyFile(archive)
    _done.add(app)
