"""Exact deduplication through a bucketed cuckoo-filter index of live digests.

Flow: every row gets the SHA-256 of its normalised text (built-in functions); each Arrow batch folds its rows to one
row a digest, so that a group of copies of any size sends at most one row a batch; the partial rows are dealt by
bucket (a range of digests) and inserted in that bucket's ``DigestIndex``: the filter tells which are new, and only its hits are looked up
in the bucket's content. Content and filters are written as one table and the content is joined back to the rows. The join stands between plain
exchanges, so that AQE splits a hot digest. ``update_index`` inserts into and deletes from a stored index in the same way.

Defined results: null text counts as empty; very long texts are read whole; rows with a null ``doc_id`` are reported, and a group's ``keep_id`` is null
only if all its ids are; rows that repeat both id and text are reported alike, each with ``kept`` as its id says (ties share the id, so all stay); an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuckoo import DigestIndex
from .storage import fresh_name, materialize

ROWS_PER_BUCKET = 20_000
#: One row a live digest; and one a bucket with a null digest, which holds the bucket's filter.
INDEX_SCHEMA = "bucket int, digest binary, keep_id long, group_size long, filter binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def bucket_of(digest: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n_buckets)).cast("int")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "min"), ("digest", "count")])
        yield from t.select(["digest", "doc_id_min", "digest_count"]).rename_columns(["digest", "keep_id", "group_size"]).to_batches()


def _table(bucket: int, index: DigestIndex) -> pa.Table:
    digests, ids, sizes = index.rows()
    columns = [[bucket] * (len(digests) + 1), [*digests, None], [*ids, None], [*sizes, None], [None] * len(digests) + [index.filter.stored()]]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "digest", "keep_id", "group_size", "filter"])


def _lists(rows: pa.Table) -> list[list]:
    return [rows.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")]


def _fill(key: tuple, rows: pa.Table) -> pa.Table:
    index = DigestIndex(len(rows))
    index.insert(*_lists(rows))
    return _table(key[0].as_py(), index)


def build_index(digests: DataFrame, n_buckets: int) -> DataFrame:
    """``digests(doc_id, digest)`` to the index table ``INDEX_SCHEMA``."""
    partial = digests.select(F.col("doc_id").cast("long"), "digest").mapInArrow(_fold, "digest binary, keep_id long, group_size long")
    return partial.withColumn("bucket", bucket_of(F.col("digest"), n_buckets)).groupBy("bucket").applyInArrow(_fill, INDEX_SCHEMA)


def _change(key: tuple, stored: pa.Table, changes: pa.Table) -> pa.Table:
    own = stored.filter(pc.is_valid(stored.column("digest")))
    filters = stored.column("filter").drop_null().to_pylist()
    index = DigestIndex.load(filters[0], *_lists(own)) if filters else DigestIndex(len(changes))
    n = changes.column("group_size")
    index.insert(*_lists(changes.filter(pc.greater(n, 0))))
    digests, _, copies = _lists(changes.filter(pc.less(n, 0)))
    index.delete(digests, [-c for c in copies])
    return _table(key[0].as_py(), index)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame, n_buckets: int) -> DataFrame:
    """Insert and delete ``(doc_id, digest)`` rows in a stored index. Both count together; a digest whose live copies
    reach zero leaves the index and the filter; deleting an unknown digest changes nothing."""
    plus = inserted.groupBy("digest").agg(F.min(F.col("doc_id").cast("long")).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    minus = deleted.groupBy("digest").agg(F.lit(None).cast("long").alias("keep_id"), (-F.count(F.lit(1))).alias("group_size"))
    changes = plus.unionByName(minus).withColumn("bucket", bucket_of(F.col("digest"), n_buckets)).groupBy("bucket", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(_change, INDEX_SCHEMA)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    digests = materialize(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    n_buckets = max(64, -(-digests.count() // ROWS_PER_BUCKET))
    index = materialize(build_index(digests, n_buckets).where("digest IS NOT NULL").select("digest", "keep_id", "group_size"), "index")
    return digests.join(index, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat both id and text count once."""
    stay = materialize(exact_groups(docs).where("kept").groupBy("doc_id", "digest").count(), "stay")
    own = fresh_name("digest", docs.columns)
    rows = docs.withColumn(own, digest_of(F.col("text")))
    match = rows["doc_id"].eqNullSafe(stay["doc_id"]) & (rows[own] == stay["digest"])
    kept = rows.join(stay, match, "left_semi")
    if stay.where("count > 1").head(1):  # only then do texts need a second shuffle
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .storage import read_table

    groups = exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
