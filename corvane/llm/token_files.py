"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a run of little-endian ids, documents closed by an end-of-document id, and nothing else. The scan cuts each
file into blocks, finds the end ids of a block in one vectorised comparison and emits a summary a block (tokens, ends found).
Documents that cross blocks are stitched by an exclusive prefix scan of the summaries: the largest end position and the number of ends before a
block, first over groups of ``SUPER`` blocks and then within each, so that no window holds more than a group or a file's groups.

Files are read by Spark's ``binaryFile`` source, one file in one row, so they must stay below 2 GB and one file is one task's work.
``write_token_files`` therefore closes a file at ``FILE_BYTES``, whatever the lengths of the texts: more data makes more files, not longer ones.
It writes through Spark's committer, with no index beside the files.

Defined results: tokens after the last end id are a document that is not ``terminated``; two end ids in a row enclose an empty
document; an empty file or folder gives no rows; a file whose length is no whole number of ids is an error. For the query: null text has
no tokens, very long texts are whole (their file is as much longer), repeated rows are counted each, a null ``doc_id`` stays null, other
columns are ignored. No order is kept between files, so there are no ties.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, new_folder, read_table
from .words import default_path

BLOCK = 1 << 20
SUPER = 1024
FILE_BYTES, ROW_BYTES = 8 << 20, 256 << 10
END_ID = 50_256
ID_DIGITS, ID_BASE = 5, 1 << 13  # a 64-bit id as token ids that are no end id
NO_ID = ID_BASE**ID_DIGITS - 1


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_digits(doc_id: int | None) -> list[int]:
    value = NO_ID if doc_id is None else doc_id % 2**64
    return [value // ID_BASE**i % ID_BASE for i in range(ID_DIGITS)]


def encode_records(docs: DataFrame, tokenizer: str | None = None, label: bool = True) -> DataFrame:
    """``(record binary)``: 16-bit ids of each text, followed by the digits of its ``doc_id`` if ``label``."""
    path = tokenizer or default_path("byte_bpe_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoding(path).encode_ordinary
        for batch in batches:
            records = [np.array(ids(t.as_py() or "") + (id_digits(d.as_py()) if label else []), dtype="<u2").tobytes() for d, t in zip(batch.column("doc_id"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, "record binary")


def write_token_files(records: DataFrame, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Flat files of 16-bit ids: each record, then the end id. Rows of ``ROW_BYTES`` hold several records, so that so many rows a file make files of a size;
    the last end id of a row is the text writer's line separator."""
    end, row_bytes = int(end_id).to_bytes(2, "little"), min(ROW_BYTES, file_bytes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column("record"):
                held.append(record.as_py())
                size += len(held[-1]) + 2
                if size >= row_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])

    files = records.select("record").mapInArrow(gather, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", file_bytes // row_bytes).text(path)


def _find_ends(files: DataFrame, end_id: int, width: int, block: int, tail: int) -> DataFrame:
    schema = "file string, block long, n_tokens long, ends array<long>, tails array<array<long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data = np.frombuffer(content.as_buffer(), dtype=f"<u{width}")
                for k, at in enumerate(range(0, len(data), block)):
                    part = data[at : at + block]
                    ends = np.flatnonzero(part == end_id) + at
                    tails = [data[max(0, e - tail) : e].tolist() for e in ends] if tail else []
                    row = [[path.as_py()], [k], [len(part)], [ends.tolist()], [tails]]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["file", "block", "n_tokens", "ends", "tails"])

    return files.select("path", "content").mapInArrow(scan, schema)


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_ID, width: int = 2, block: int = BLOCK, tail: int = 0) -> DataFrame:
    """``(file, doc_index, start, n_tokens, terminated, tail)``: one row a document; ``tail``: its last ids, if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]|\.crc$"))
    files = files.withColumn("content", F.when(F.col("length") % width == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no whole number of ids in "), "path")).cast("binary")))
    blocks = materialize(_find_ends(files, end_id, width, block, tail).withColumn("group", F.floor(F.col("block") / SUPER)), "blocks")
    last, n_ends = F.array_max("ends"), F.size("ends")
    groups = blocks.groupBy("file", "group").agg(F.max(last).alias("last"), F.sum(n_ends).alias("n"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select("file", "group", F.max("last").over(before).alias("group_last"), F.sum("n").over(before).alias("group_n"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.join(carried, ["file", "group"]).select(
        "file",
        "ends",
        "tails",
        F.coalesce(F.max(last).over(inside), "group_last", F.lit(-1).cast("long")).alias("carry"),
        (F.coalesce(F.sum(n_ends).over(inside), F.lit(0)) + F.coalesce("group_n", F.lit(0))).alias("first"),
    )
    each = stitched.select("file", "ends", "tails", "carry", "first", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    length = F.col("end") - start
    own_tail = F.slice(F.get("tails", F.col("i")), F.greatest(F.lit(1), tail - length + 1).cast("int"), tail) if tail else F.array().cast("array<long>")
    closed = each.select("file", (F.col("first") + F.col("i")).alias("doc_index"), start.alias("start"), length.alias("n_tokens"), F.lit(True).alias("terminated"), own_tail.alias("tail"))
    whole = groups.groupBy("file").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("tokens > last + 1")
    loose = whole.select("file", F.col("n").alias("doc_index"), (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"), F.array().cast("array<long>").alias("tail"))
    return closed.unionByName(loose)


def query(spark, sf_dir: str) -> DataFrame:
    """Flat files of the corpus are written and scanned; the labels at the documents' ends give their ids back."""
    folder = new_folder(spark, "tokens")
    write_token_files(encode_records(read_table(spark, sf_dir, "documents")), folder)
    found = scan_token_files(spark, folder, tail=ID_DIGITS)
    digit = [F.get("tail", F.lit(i)) for i in range(ID_DIGITS)]
    doc_id = F.lit(0).cast("long")
    for i in range(ID_DIGITS):
        doc_id = doc_id.bitwiseOR(F.shiftleft(digit[i], 13 * i))
    unlabelled = functools.reduce(lambda a, b: a & b, [d == ID_BASE - 1 for d in digit])
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 1000 + F.regexp_extract("file", r"-c(\d+)", 1).cast("int")
    return found.select(F.when(~unlabelled, doc_id).alias("doc_id"), (F.col("n_tokens") - ID_DIGITS).alias("n_tokens"), shard.alias("shard"), "doc_index", "start", "terminated")


def brute_force(data: np.ndarray, end_id: int) -> list[tuple[int, int, bool]]:
    """(start, length, terminated) of each document, for tests and small files."""
    found, start = [], 0
    for i, token in enumerate(data.tolist()):
        if token == end_id:
            found.append((start, i - start, True))
            start = i + 1
    return found + ([(start, len(data) - start, False)] if start < len(data) else [])
