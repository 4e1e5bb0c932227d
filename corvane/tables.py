"""Tables that cut lineage: written to the folder that all executors share, then read back."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes = threading.local()


@functools.cache
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corvane-")


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_scratch()


def new_folder(spark: SparkSession, label: str, kept: bool = False) -> str:
    path = f"{scratch_root(spark)}/corvane-{uuid.uuid4().hex}/{label}"
    if not kept and getattr(_scopes, "made", None) is not None:
        _scopes.made.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the folders made within, but those of tables that were ``kept``."""
    outer, _scopes.made = getattr(_scopes, "made", None), []
    try:
        yield
    finally:
        made, _scopes.made = _scopes.made, outer
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` once and continue from the files, so that a lost executor never recomputes what came before."""
    path = new_folder(df.sparkSession, label, kept)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    while name in taken:
        name += "_"
    return name
