"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a min-aggregation and a join between stored tables, so nothing is gathered on the driver, a hub's edges are split by
AQE, and each step's result is a written table. The number of edges never grows; steps are logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least").withColumnRenamed("u", "k")
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least").withColumnRenamed("a", "k")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("k", "m")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: every linked node but the roots themselves, with its component's smallest node."""
    current = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = materialize(_small_star(materialize(_large_star(current), "large")), "small")
        state, before = _state(current), state
        if state == before:
            break
    return current.toDF("node", "root")
