"""What a session needs before its Python workers can run this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: Arrow's own pools and glibc's growing thresholds keep what a large batch once took; a worker that lives through many stages is to give it back.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20)}

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver did; on a cluster, ship it with ``--py-files`` or install it. Rows here hold whole
    texts, so Arrow batches get fewer rows and bytes than Spark's default, unless the session asks for a number of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    if spark.conf.get(BYTES) == "67108864b":
        spark.conf.set(BYTES, BATCH_BYTES)
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
