"""Continuous ingestion (an extension): a file stream keeps a store's sections up to date.

Spark's checkpoint remembers which files were taken; a new version of a file replaces its sections. Progress is the
query's own listener, stopping is ``query.stop()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import prepare
from ..sources.files import extract_sections, scan_files
from ..sources.store import Store


def ingest(spark: SparkSession, directory: str, store: Store, collection: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``once``: take what is there and end."""
    prepare(spark)

    def update(batch: DataFrame, _: int) -> None:
        store.put_sections(collection, extract_sections(batch, strict=False))

    writer = scan_files(spark, directory, streaming=True).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
