"""Vector best-fit packing of documents into training sequences.

Documents are tokenised, closed by an end id and cut into pieces of at most ``max_tokens`` (only longer documents are
cut). A piece demands three resources of a sequence: tokens, one place in its document count, and attention cost
(length squared). Pieces are placed longest first; among the open sequences with room in every dimension the best is
chosen by the weighted dot product of demand and residual capacity (the largest wins among those that leave the fewest tokens)
or by the norm of what would remain (smallest wins), each as a share of the capacity.

A full-length piece fills a sequence alone. Pieces are dealt to tasks by a hash of all they hold and of the number of the copy, ``COPIES`` copies
together, and packed in runs of ``RUN`` in the order of that hash. So neither one key nor one text repeated can crowd a task, a run is a fair mix
of lengths, and the result does not depend on where rows come from. Sequences with ``CARRIED`` tokens or more to spare stay open from a run to the next.

By default only the tokens bind: the contract wants as few sequences of 2,048 tokens as can be, every piece has a token, and squares of parts
never add up to more than the square of their sum, so 2,048 documents and 2,048 squared cost are met by themselves. They still steer the choice
through the norm. Tighter limits cost sequences; callers set them in ``Capacity``.

Ties: equal lengths are placed by ``doc_id`` (null first), piece, start, checksum and copy; among equally good sequences the one opened first is taken.

Defined results: null text is an empty document (the end id alone); very long texts are cut into as many pieces as it takes; repeated rows are packed
once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, read_table
from .words import default_path, encoder
from .workers import fresh

RUN = 8_192
COPIES = 64
CARRIED = 16
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"  # or "dot"

    def __post_init__(self):
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2 or self.rule not in ("norm", "dot"):
            raise ValueError("capacities must admit one piece of full length; rule is norm or dot")


def cut_documents(docs: DataFrame, max_tokens: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``PIECES_SCHEMA``: one row a piece of ``docs(doc_id, text)``."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(path).ids, end_id.to_bytes(4, "little"), 4 * max_tokens
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, PIECES_SCHEMA)


class Bins:
    """Open sequences, by what each has left of every resource."""

    def __init__(self, capacity: Capacity):
        self.capacity = capacity
        self.full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
        self.weights = np.array(capacity.weights)
        self.room, self.name = np.empty((3, 1024), np.int64), np.empty(1024, np.int64)
        self.n_open, self.made = 0, 0

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece, placed longest first and equal ones in the order given."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable"):
            at = self._best(int(lengths[i]))
            sequence[i], offset[i] = self.name[at], self.capacity.tokens - self.room[0, at]
            self.room[:, at] -= (lengths[i], 1, lengths[i] * lengths[i])
            if not self.room[0, at] or not self.room[1, at]:
                self._close(at)
        return sequence, offset

    def _best(self, length: int) -> int:
        demand = np.array([length, 1, length * length])
        tokens, documents, attention = self.room[:, : self.n_open]
        fits = np.flatnonzero((tokens >= length) & (documents >= 1) & (attention >= demand[2]))
        if not len(fits):
            return self._open()
        have = self.room[:, fits]
        if self.capacity.rule == "norm":
            left = (have - demand[:, None]) / self.full[:, None]
            cost = (self.weights @ (left * left),)
        else:
            cost = (have[0], -((self.weights * demand / self.full) @ (have / self.full[:, None])))
        best = np.arange(len(fits))
        for c in (*cost, self.name[fits]):
            best = best[c[best] == c[best].min()]
        return int(fits[best[0]])

    def _open(self) -> int:
        if self.n_open == self.room.shape[1]:
            self.room, self.name = np.concatenate([self.room, np.empty_like(self.room)], axis=1), np.concatenate([self.name, np.empty_like(self.name)])
        at, self.n_open = self.n_open, self.n_open + 1
        self.room[:, at], self.name[at] = (self.capacity.tokens, self.capacity.documents, self.capacity.attention), self.made
        self.made += 1
        return at

    def _close(self, at: int) -> None:
        self.n_open -= 1
        self.room[:, at], self.name[at] = self.room[:, self.n_open], self.name[self.n_open]

    def close_fuller_than(self, spare: int) -> None:
        """Close the sequences with fewer tokens to spare than this."""
        keep = np.flatnonzero(self.room[0, : self.n_open] >= spare)
        self.n_open = len(keep)
        self.room[:, : self.n_open], self.name[: self.n_open] = self.room[:, keep], self.name[keep]


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece."""
    return Bins(capacity).place(lengths)


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the number of each of equal rows: counted first, so that many copies are one row on their way."""
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    counted = pieces.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.select(*own, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    dealt = parts.withColumn("deal", F.xxhash64(*own, "part"))
    each = F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, "n") - 1)
    return dealt.select(*own, "part", "deal", each.alias("copies"))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``PACKED_SCHEMA``."""
    n_tasks = max(1, pieces.count() // (2 * RUN))
    dealt = _numbered(pieces).repartition(n_tasks, "deal").sortWithinPartitions("deal", "doc_id", "piece", "start", "ids_crc32", "part")
    rows = dealt.select("doc_id", "piece", "start", "length", "ids_crc32", F.explode("copies").alias("copy"))
    keys = [(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32", "copy")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        first, bins = TaskContext.get().partitionId() << 40, Bins(capacity)

        def packed(run: pa.Table) -> Iterator[pa.RecordBatch]:
            run = run.take(pc.sort_indices(run, sort_keys=keys, null_placement="at_start")).drop_columns(["copy"])
            sequence, offset = bins.place(run.column("length").to_numpy())
            bins.close_fuller_than(CARRIED)
            yield from run.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(batch.slice(at, RUN - sum(map(len, held))))
                at += len(held[-1])
                if sum(map(len, held)) == RUN:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from packed(pa.Table.from_batches(held))

    return rows.mapInArrow(place, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    return pack(materialize(cut_documents(docs, capacity.tokens, end_id, tokenizer), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
