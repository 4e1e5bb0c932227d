"""Shard placement by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order (offset and step from a hash of its name) and the
shards take turns claiming the next free slot of their walk, as many slots a turn as their weight says. A row's key
hashes to a slot, and the slot names the shard: one look-up in a broadcast table whose size is fixed by ``size``, not by
the data. Adding or removing a shard moves few slots between the others.

Keys are best unique (``doc_id``): then no shard gets more than its share whatever the sources' sizes. For placement by
a column with hot values, ``spread`` deals each value over that many sub-keys taken from ``doc_id``.

Defined results: null keys hash like any other value (each null column keeps the running hash), repeated rows land together, empty tables
give no rows, columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import read_table

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _preference(name: str, size: int) -> tuple[int, int]:
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1


def fill_table(shards: dict[str, int], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. ``shards`` maps names to positive weights; order of the mapping does not matter."""
    if not is_prime(size):
        raise ValueError("the table's size must be prime")
    if not shards or min(shards.values()) < 1 or sum(shards.values()) > size:
        raise ValueError("shards need positive weights that fit the table")
    names = sorted(shards)
    walk = {name: [*_preference(name, size)] for name in names}
    slots: list[str | None] = [None] * size
    free = size
    while free:
        for name in names:
            at, step = walk[name]
            for _ in range(min(shards[name], free)):
                while slots[at] is not None:
                    at = (at + step) % size
                slots[at] = name
                free -= 1
            walk[name][0] = at
            if not free:
                break
    return slots


def lookup_table(spark: SparkSession, shards: dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, size))), "slot int, shard string")


def place(rows: DataFrame, keys: list[str], shards: dict[str, int], size: int = TABLE_SIZE, spread: int = 1) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``. The broadcast table has exactly ``size`` rows."""
    rows = rows.drop("slot", "shard")
    parts = [F.col(f"`{k}`") for k in keys] + ([F.pmod(F.xxhash64("doc_id"), F.lit(spread))] if spread > 1 else [])
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64(*parts), F.lit(size)).cast("int"))
    return slotted.join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot")


def write_shards(rows: DataFrame, path: str, keys: list[str], shards: dict[str, int], size: int = TABLE_SIZE) -> None:
    """One folder a shard, without a shuffle: every task appends to the shards of its rows."""
    place(rows, keys, shards, size).drop("slot").write.partitionBy("shard").parquet(path)


PRODUCTION_SHARDS = {f"shard-{i:03d}": 1 for i in range(128)}


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(docs, ["doc_id"], PRODUCTION_SHARDS).select("doc_id", "source", "slot", "shard")
