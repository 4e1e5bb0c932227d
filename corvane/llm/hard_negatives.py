"""Hard negatives by exact search in k-means inverted lists.

1. Vectors become integers (256 times, rounded down), so every score is exact and ties are real.
2. Index: k-means centroids are fitted on at most ``SAMPLE`` vectors (those of the smallest id hashes); every vector is then put in the list of its nearest
   centroid. Lists are cut into blocks of at most about ``BLOCK`` vectors, however many one centroid draws. A list's largest distance from its centroid is stored.
3. Bounds: an anchor q scores a vector of the list with centroid c and radius r between q.c - |q| r and q.c + |q| r (Cauchy-Schwarz).
4. Search in two waves. Each anchor first visits the ``FIRST`` lists of highest upper bound whose interval reaches its window; this gives a kth score.
   Then it visits every other list that reaches the window, in order of the bound, but for those whose bound falls strictly below the kth score, where it
   stops: an equal bound could still hold a tie of smaller id. Lists outside the window are never read.
5. Anchors that visit a list are dealt to chunks; a block and a chunk meet in one row and are scored by one matrix product of whole numbers in doubles, which
   hands on the best k a window. Positives are the same search with an open window over rows of the anchor's label.

Defined results: rows with a null ``vec_id`` or label, a null vector or a null or non-finite component take no part; an anchor without other rows of its label gives
no rows, nor does a positive without negatives in its window; of rows that share a ``vec_id`` the first by label, then vector stays; a shorter vector counts
as padded with zeros; components beyond +-2**27 (after scaling) are held there, so that a score fits a long; ties go to the smaller ``vec_id``; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, read_table

SCALE, LIMIT = 256, 1 << 27
SAMPLE, CENTROIDS, STEPS = 20_000, 1024, 8  # vectors that k-means is fitted on, most centroids, rounds
BLOCK, CHUNK = 2048, 256  # vectors a block, anchors a chunk
FIRST = 4
LOW, HIGH = -(1 << 62), 1 << 62  # an open window


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v array<long>)`` of the rows that take part, components scaled and rounded down."""
    told = embeddings.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "cast(embedding as array<double>) v").where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("v", lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x * SCALE).cast("double"))).cast("long"))
    rows = told.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("e")).select("vec_id", "e.label", "e.v")


def fit_centroids(sample: np.ndarray, n: int, steps: int = STEPS, seed: int = 13) -> np.ndarray:
    """Lloyd's k-means from random rows; centroids without rows keep their place."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(steps):
        own = nearest(sample, centroids)
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows, padded with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def build_lists(vectors: DataFrame, dims: int, centroids: np.ndarray, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``(list, block, ids, labels, m)``: blocks of vectors by nearest centroid; and each list's radius (-1: empty)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dims)
            own = nearest(m.astype(np.float64), centroids)
            far = np.sqrt(((m - centroids[own]) ** 2).sum(axis=1))
            raw = [r.tobytes() for r in m]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(own.astype(np.int32)), pa.array(far), pa.array(raw, pa.binary())], ["vec_id", "label", "list", "far", "v"])

    placed = materialize(vectors.mapInArrow(place, "vec_id long, label long, list int, far double, v binary"), "placed")
    sizes = materialize(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")), "sizes")
    radii = np.full(len(centroids), -1.0)
    for r in sizes.collect():  # at most CENTROIDS rows
        radii[r["list"]] = r["radius"]
    dealt = placed.join(sizes.select("list", "n"), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / block)).cast("int"))
    return materialize(dealt.groupBy("list", "block").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("rows")), "blocks"), radii


def bounds(anchors: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score that a vector of each list can have with each anchor, rounded outwards."""
    middle, reach = anchors @ centroids.T, np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.maximum(radii, 0)
    slack = 1e-6 * (np.abs(middle) + reach + 1)
    return np.floor(middle - reach - slack), np.ceil(middle + reach + slack)


def _visits(wanted: DataFrame, dims: int, centroids: np.ndarray, radii: np.ndarray, first: int, rest: bool) -> DataFrame:
    """``wanted(anchor_id, label, same, low, high, kth, v, ...)`` with a ``list`` to visit: the first ones by bound, or the rest down to ``kth``."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                low, high, kth = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("low", "high", "kth"))
                least, most = bounds(_matrix(part.column("v"), dims), centroids, radii)
                reached = (radii >= 0) & (most >= low) & (least <= high)
                order = np.argsort(np.where(reached, -most, np.inf), axis=1, kind="stable")
                turn = np.empty_like(order)
                np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
                at, visited = np.nonzero(reached & ((turn >= first) & (most >= kth) if rest else turn < first))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(visited.astype(np.int32))], [*part.schema.names, "list"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", list int"
    return wanted.mapInArrow(choose, schema)


def _scored(visits: DataFrame, blocks: DataFrame, dims: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """``(anchor_id, low, high, other_id, score)``: of each visit the best k of the list's blocks in its window."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, asked = batch.column("rows")[i].values, batch.column("asked")[i].values
                ids, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                m = np.frombuffer(b"".join(rows.field("v").to_pylist()), np.int64).reshape(len(ids), dims)
                anchor, label, same, low, high = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label", "same", "low", "high"))
                every = products(_matrix(asked.field("v"), dims), m)
                fit = ((labels == label[:, None]) == same[:, None]) & (ids != anchor[:, None]) & (every >= low[:, None]) & (every <= high[:, None])
                found = []
                for at in range(len(anchor)):
                    some = np.flatnonzero(fit[at])
                    some = some[np.lexsort((ids[some], -every[at, some]))[:k]]
                    found.append((np.full(len(some), at), ids[some], every[at, some]))
                at, other, points = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[at], low[at], high[at], other, points)], ["anchor_id", "low", "high", "other_id", "score"])

    dealt = visits.withColumn("chunk", F.xxhash64("anchor_id", "low", "high"))
    counts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    asked = dealt.join(counts, "list").groupBy("list", F.pmod("chunk", "chunks").alias("chunk")).agg(F.collect_list(F.struct("anchor_id", "label", "same", "low", "high", "v")).alias("asked"))
    return asked.join(blocks, "list").select("rows", "asked").mapInArrow(score, "anchor_id long, low long, high long, other_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "other_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_lists(wanted: DataFrame, blocks: DataFrame, dims: int, centroids: np.ndarray, radii: np.ndarray, k: int, first: int = FIRST) -> DataFrame:
    """``(anchor_id, low, high, other_id, score, rank)``: the best k of each of ``wanted(anchor_id, label, same, low, high, v)``, which differ in id or window;
    ``same`` asks for rows of the anchor's label, else for the others'."""
    start = _visits(wanted.withColumn("kth", F.lit(LOW)), dims, centroids, radii, first, False)
    seen = materialize(_best(_scored(start, blocks, dims, k), k).drop("rank"), "first")
    kth = seen.groupBy("anchor_id", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    open_ones = wanted.join(kth.drop("n"), ["anchor_id", "low", "high"], "left").withColumn("kth", F.coalesce("least", F.lit(LOW))).select(*wanted.columns, "kth")
    rest = _visits(open_ones, dims, centroids, radii, first, True)
    return materialize(_best(seen.unionByName(_scored(rest, blocks, dims, k)), k), "best")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """Of ``vectors(vec_id, label, v)``: for each anchor (``vec_id`` divisible by ``every``) and each of its ``positives`` nearest rows of its label, the
    ``negatives`` best rows of other labels whose score lies within ``low`` to ``high`` per cent of the positive's."""
    vectors = materialize(vectors, "vectors")
    n, dims = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, 1)
    wanted = min(CENTROIDS, math.isqrt(n) + 1)
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks(), dims).astype(np.float64)  # at most SAMPLE rows
    centroids = fit_centroids(sample, min(wanted, len(sample))) if len(sample) else np.zeros((1, dims))
    blocks, radii = build_lists(vectors, dims, centroids, block)
    anchors = materialize(vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    open_window = anchors.select("anchor_id", "label", F.lit(True).alias("same"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), "v")
    near = search_lists(open_window, blocks, dims, centroids, radii, positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers: low * p <= 100 * n <= high * p
    floor, ceiling = F.expr(f"-((-{low} * positive_score) div 100)"), F.expr(f"({high} * positive_score) div 100")
    exact_low = floor + F.expr(f"cast(-((-{low} * positive_score) div 100) * 100 < {low} * positive_score as int)")
    exact_high = ceiling - F.expr(f"cast((({high} * positive_score) div 100) * 100 > {high} * positive_score as int)")
    windows = materialize(near.withColumns({"low": exact_low, "high": exact_high}), "windows")
    asked = windows.where("low <= high").select("anchor_id", "low", "high").distinct().join(anchors, "anchor_id").select("anchor_id", "label", F.lit(False).alias("same"), "low", "high", "v")
    hard = search_lists(asked, blocks, dims, centroids, radii, negatives)
    return windows.join(hard, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = clean_vectors(read_table(spark, sf_dir, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", shifted))


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
