"""Durable tables: extracted sections, embedding vectors and their models, as Parquet.

A store is a folder. Each collection of sections and each model's vectors is a table of immutable folders, and a manifest that names those that count. A
change writes new folders first and then the next manifest, whose rename is the commit: readers see the state before or after, never a gap, and a
change that dies on the way leaves nothing but folders that no manifest names. Sections lie in partitions by the hash of their source, of which a change
writes only those it touches; new vectors are folders of their own. ``meta.json`` holds the schema's version; other versions are refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize

VERSION = 2
PARTS = 64  # of a collection of sections
FOLDERS = 64  # of a model's vectors, before they are written as one
KEPT = 3  # manifests, so that readers of an older state can end
SECTIONS = "source string, sha256 string, section int, page int, text string"
VECTORS = "text_hash string, vector array<double>"


def text_hash(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.char(F.lit(0)), text), 256)


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct ``wanted`` rows whose hash is not cached."""
    return wanted.join(cached, "text_hash", "left_anti").dropDuplicates(["text_hash"])


def prune(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of active sources only."""
    return rows.join(active.select("source").distinct(), "source", "left_semi")


def vector_check(vectors: DataFrame) -> DataFrame:
    bad = (F.size("vector") == 0) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.size("vector")
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.min(size).alias("least_dimension"), F.max(size).alias("most_dimension"), F.count_if(bad).alias("n_invalid"))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        found = self._meta()
        if found.get("version", VERSION) != VERSION:
            raise ValueError(f"the store has schema version {found['version']}, not {VERSION}")

    # Hadoop's file system, so that a store can lie wherever Spark reads.

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _text(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_text(self, name: str, text: str) -> None:
        """The file appears whole or not at all; a taken name is an error."""
        fs, path = self._path(name)
        _, new = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(new, path):
            fs.delete(new, False)
            raise RuntimeError(f"another writer has changed {name}")

    def _meta(self) -> dict:
        fs, path = self._path("meta.json")
        return json.loads(self._text("meta.json")) if fs.exists(path) else {}

    def _manifests(self, table: str) -> list[int]:
        fs, path = self._path(f"{table}/manifest")
        names = [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _state(self, table: str, number: int | None = None) -> dict:
        """What the newest manifest says: ``folders`` by partition, and more that belongs to the table."""
        if number is None:
            numbers = self._manifests(table)
            number = numbers[-1] if numbers else 0
        return json.loads(self._text(f"{table}/manifest/{number:012d}.json")) if number else {"folders": {}}

    def _commit(self, table: str, state: dict) -> None:
        if not self._meta():
            self._put_text("meta.json", json.dumps({"version": VERSION}))
        numbers = self._manifests(table)
        self._put_text(f"{table}/manifest/{(numbers[-1] if numbers else 0) + 1:012d}.json", json.dumps(state))
        self._vacuum(table)

    def _vacuum(self, table: str) -> None:
        """Delete manifests but the last ones, and the folders that only those named."""
        numbers = self._manifests(table)
        top = lambda n: {folder.split("/")[0] for folder in self._state(table, n)["folders"].values()}
        live = set().union(*map(top, numbers[-KEPT:]))
        for number in numbers[:-KEPT]:
            for folder in top(number) - live:
                fs, path = self._path(f"{table}/{folder}")
                fs.delete(path, True)
            fs, path = self._path(f"{table}/manifest/{number:012d}.json")
            fs.delete(path, False)

    def _read(self, table: str, schema: str, state: dict | None = None, parts: list[str] | None = None) -> DataFrame:
        folders = (state or self._state(table))["folders"]
        paths = [f"{self.root}/{table}/{f}" for p, f in sorted(folders.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: str, rows: DataFrame, by: str | None = None) -> str:
        """A new folder of ``rows`` that no manifest names yet."""
        name = f"data-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.root}/{table}/{name}")
        return name

    # sections

    def sections(self, collection: str) -> DataFrame:
        return self._read(f"sections/{collection}", SECTIONS)

    def cached(self, collection: str, files: DataFrame) -> DataFrame:
        """Sections of files ``(source, sha256)`` whose digest has not changed."""
        return self.sections(collection).join(files.select("source", "sha256").distinct(), ["source", "sha256"], "left_semi")

    def stale(self, collection: str, files: DataFrame) -> DataFrame:
        return files.join(self.sections(collection).select("source", "sha256").distinct(), ["source", "sha256"], "left_anti")

    def put_sections(self, collection: str, fresh: DataFrame, active: DataFrame | None = None) -> list[str]:
        """Sections of the fresh sources replace theirs; sources that are not active go. Returns the partitions that were written, the only ones read or
        written. ``fresh`` is evaluated once."""
        table, state = f"sections/{collection}", self._state(f"sections/{collection}")
        fresh = materialize(fresh.select("source", "sha256", "section", "page", "text").withColumn("part", _part(F.col("source"))), "fresh")
        touched = {str(r["part"]) for r in fresh.select("part").distinct().collect()}  # at most PARTS
        if active is not None:
            active = materialize(active.select("source").distinct(), "active")
            held = self._read(table, SECTIONS, state).select("source").distinct()
            gone = held.join(active, "source", "left_anti").select(_part(F.col("source")).alias("part")).distinct()
            touched |= {str(r["part"]) for r in gone.collect()}
        if not touched:
            return []
        kept = self._read(table, SECTIONS, state, sorted(touched)).join(fresh.select("source").distinct(), "source", "left_anti").withColumn("part", _part(F.col("source")))
        every = kept.unionByName(fresh)
        every = prune(every, active) if active is not None else every
        folder = self._write(table, every.repartition("part"), "part")
        fs, path = self._path(f"{table}/{folder}")
        filled = {str(s.getPath().getName()).removeprefix("part=") for s in fs.listStatus(path) if s.isDirectory()}
        folders = {p: f for p, f in state["folders"].items() if p not in touched} | {p: f"{folder}/part={p}" for p in sorted(filled)}
        self._commit(table, {**state, "folders": folders})
        return sorted(touched)

    # vectors

    def dimension(self, model: str) -> int | None:
        return self._state(f"vectors/{_safe(model)}").get("dimension")

    def vectors(self, model: str) -> DataFrame:
        return self._read(f"vectors/{_safe(model)}", VECTORS).where("vector IS NOT NULL")

    def put_vectors(self, model: str, vectors: DataFrame) -> None:
        """Stored vectors of the same hash are replaced. ``vectors`` is evaluated once; rows without a vector are left out."""
        table = f"vectors/{_safe(model)}"
        state, folder = self._state(table), self._write(table, vectors.select("text_hash", "vector"))
        new = self.spark.read.schema(VECTORS).parquet(f"{self.root}/{table}/{folder}").where("vector IS NOT NULL")
        try:
            checked = vector_check(new).first()
            if checked["n_invalid"] or checked["least_dimension"] != checked["most_dimension"]:
                raise ValueError("vectors must be finite, not empty, and of one dimension")
            known = state.get("dimension")
            if checked["n_vectors"] and known not in (None, checked["most_dimension"]):
                raise ValueError(f"the model '{model}' has dimension {known}, not {checked['most_dimension']}")
        except ValueError:
            fs, path = self._path(f"{table}/{folder}")
            fs.delete(path, True)
            raise
        if not checked["n_vectors"]:
            return
        held = self._read(table, VECTORS, state).where("vector IS NOT NULL")
        repeated = not held.join(new, "text_hash", "left_semi").isEmpty() or checked["n_vectors"] != new.select("text_hash").distinct().count()
        folders = {**state["folders"], f"{len(state['folders']):06d}": folder}
        if repeated or len(folders) > FOLDERS:
            every = held.join(new, "text_hash", "left_anti").unionByName(new.dropDuplicates(["text_hash"]))
            folders = {"000000": self._write(table, every)}
        self._commit(table, {"folders": folders, "dimension": checked["most_dimension"]})

    def counts(self, collection: str, model: str) -> DataFrame:
        files = self.sections(collection).agg(F.count_distinct("source").alias("n_files"), F.count(F.lit(1)).alias("n_sections"))
        return files.crossJoin(self.vectors(model).agg(F.count(F.lit(1)).alias("n_vectors")))  # one row each


def _part(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def _safe(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:20]


def collection_key(root: str | Path, ocr: bool = False, ocr_language: str = "eng") -> str:
    told = f"version=6\0{root}\0ocr={ocr}\0language={ocr_language}"
    return hashlib.sha256(told.casefold().encode()).hexdigest()
