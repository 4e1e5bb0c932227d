"""A folder of documents as a Spark data source: listed and checked by name and size first, read file by file in tasks.

The listing sees every file below the folder, hidden names too. Links, empty and too large files are refused by it, so their content is never
opened. Accepted files are dealt to partitions by size; a task reads one file at a time and hands it on in batches of bounded size.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files as F

RANGE_BYTES, RANGE_FILES, BATCH_BYTES = 32 << 20, 1000, 8 << 20
FORMAT = "corvane_folder"
SCHEMA = "source string, sha256 string, size long, mtime timestamp, problem string"


@dataclass(frozen=True)
class Listed:
    source: str
    size: int
    mtime_ns: int
    problem: str | None


@dataclass
class FileRange(InputPartition):
    files: list[Listed]


def listing(root: str) -> Iterator[Listed]:
    """Files of an accepted type below ``root`` in the order of their path parts, with the reason why one must not be opened. Links to folders are not followed."""
    for folder, names, files in os.walk(root):
        names.sort()
        for name in sorted(files):
            if F.suffix_of(name) not in F.SUFFIXES:
                continue
            path = os.path.join(folder, name)
            linked, info = os.path.islink(path), os.stat(path, follow_symlinks=False)
            why = F.problem_of_size(name, info.st_size) if not linked and os.path.isfile(path) else f"not a regular file: {name}"
            yield Listed(os.path.relpath(path, root).replace(os.sep, "/"), info.st_size, info.st_mtime_ns, why)


def ranges(files: Iterator[Listed]) -> list[FileRange]:
    out, size = [FileRange([])], 0
    for f in files:
        cost = 0 if f.problem else f.size
        if out[-1].files and (size + cost > RANGE_BYTES or len(out[-1].files) >= RANGE_FILES):
            out.append(FileRange([]))
            size = 0
        out[-1].files.append(f)
        size += cost
    return out


class FolderReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> list[FileRange]:
        return ranges(listing(self.root))

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for f in partition.files:
            why, body, digest = f.problem, None, None
            if not why:
                with open(os.path.join(self.root, f.source), "rb") as stream:
                    body = stream.read(F.MAX_FILE + 1)  # it may have grown since
                why, digest = F.problem(f.source, body), hashlib.sha256(body).hexdigest()
            rows.append((f.source, digest, f.size, datetime.fromtimestamp(f.mtime_ns / 1e9, timezone.utc), why, *([body] if self.content else [])))
            held += len(body or b"") if self.content else 0
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.binary()]
        names = ["source", "sha256", "size", "mtime", "problem", "content"]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])


class FolderSource(DataSource):
    """Options: ``path``; ``content`` ("false": digests only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _content(self) -> bool:
        return self.options.get("content", "true") == "true"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self._content() else "")

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self._content())


def scan_folder(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``(source, sha256, size, mtime, problem[, content])``; refused files have a ``problem``."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FORMAT).option("path", root).option("content", str(content).lower()).load()


def with_content(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` of a scan with their ``content``, read anew in the tasks: of files that need extraction only."""
    if not F.is_mounted(root):
        return rows.join(F.scan_files(rows.sparkSession, root).select("source", "content"), "source")
    root = F.local_path(root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one file at a time
                body = None
                if not batch.column("problem")[i].is_valid:
                    with open(os.path.join(root, batch.column("source")[i].as_py()), "rb") as stream:
                        body = stream.read(F.MAX_FILE + 1)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([body], pa.binary())], [*batch.schema.names, "content"])

    return rows.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", content binary")
