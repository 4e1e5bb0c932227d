"""Question vectors against chunk vectors by blocks.

Cosine ranking compares every question with every chunk. Chunks are dealt to blocks and questions to panels of bounded size; a panel goes to each
block, so that one row holds both and one matrix product scores them. Neither side is broadcast, and no pair is made by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, PANEL = 2048, 128  # chunks and questions that meet in one row
PLACES = 9  # scores are rounded, so that the order of summation decides no tie


def _dealt(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """``(<name>, members)``: ``rows(id, vector)`` dealt by id to groups of about ``size``; and the number of groups."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("id", "vector")).alias("members")), n


def sorted_join(left: DataFrame, right: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """A join of groups that sorts both sides. Spark judges a side by the files it began as; panels that go to each block are many times that, and would be
    broadcast through the driver."""
    return left.join(right.hint("merge"), by, how)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows divided by their length; zero rows stay zero. Vectors of different length are an error."""
    sizes = set(np.asarray(vectors.value_lengths()).tolist())
    if len(sizes) > 1:
        raise ValueError("vector dimensions differ")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 0))
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _block_scores(vectors: DataFrame, questions: DataFrame, pick) -> DataFrame:
    """``(question_id, chunk_id, semantic)`` of the pairs whose places ``pick(scores, ids)`` gives, block by block."""
    held, n = _dealt(vectors.where("vector IS NOT NULL").select(F.col("chunk_id").alias("id"), "vector"), "block", BLOCK)
    asked, _ = _dealt(questions.where("vector IS NOT NULL").select(F.col("question_id").alias("id"), "vector"), "panel", PANEL)
    sent = asked.select("panel", F.col("members").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((questions, "question_id"), (vectors, "chunk_id"))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, members = batch.column("asked")[i].values, batch.column("members")[i].values
                a, b = unit_rows(asked.field("vector")), unit_rows(members.field("vector"))
                if a.shape[1] != b.shape[1]:
                    raise ValueError("vector dimensions differ")
                scores = np.round(a @ b.T, PLACES) + 0.0  # no negative zero
                at, to = pick(scores, members.field("id"))
                yield pa.RecordBatch.from_arrays([asked.field("id").take(pa.array(at)), members.field("id").take(pa.array(to)), pa.array(scores[at, to])], ["question_id", "chunk_id", "semantic"])

    return sorted_join(sent, held, "block").select("asked", "members").mapInArrow(score, ", ".join([*kinds, "semantic double"]))


def semantic_scores(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """``(question_id, chunk_id, semantic)`` of every question vector with every chunk vector ``(chunk_id, vector)``."""
    return _block_scores(vectors, questions, lambda scores, ids: np.nonzero(np.ones(scores.shape, bool)))


def nearest_chunks(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each question with their ``rank``; ties by ``chunk_id``. A block hands on k rows a question at most."""
    from .retrieval import top_k

    def pick(scores: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        place = np.empty(len(ids), np.int64)  # of ids in ascending order
        place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        best = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=1)[:, :k]
        return np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()

    return top_k(_block_scores(vectors, questions, pick), "semantic", k, tie="chunk_id")
