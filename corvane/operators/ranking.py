"""Ranks in groups of any size, from sorted ranges instead of one window partition a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize


def numbered(rows: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 within ``by``, in the order given.

    Rows are dealt to ranges of (group, order); each range numbers its own, and what a group has in earlier ranges is a sum of one count
    a range and group. No task holds more than a range, however large the group.
    """
    ranged = materialize(rows.repartitionByRange(by, *order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range", by).orderBy(*order)
    earlier = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range", by).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranged.withColumn(name, F.row_number().over(inside)).join(before, ["range", by]).withColumn(name, F.col(name) + F.col("before")).drop("range", "before")
