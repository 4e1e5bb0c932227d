"""Line deduplication over overlapping windows of three lines, with built-in functions only.

A window is three consecutive lines (``\n``-split) and is known by the MD5 of its text. Of equal windows in the corpus
the first by (doc_id, hash of the text, line) stays; the lines that later ones cover are merged to intervals a document
and cut. Counting uses map-side partial aggregation, so that a window found everywhere sends one row a task; the
windows then meet the repeated ones in a join between plain exchanges, which AQE splits where a window is hot.

Defined results: null text counts as empty (one empty line); texts of fewer than three lines have no window and stay;
very long texts are read whole; rows that repeat id and text count as one document and get the same cut; a null ``doc_id`` sorts first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, read_table

WIDTH = 3


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))


def _windows(lines: DataFrame) -> DataFrame:
    starts = F.when(F.size("lines") >= WIDTH, F.sequence(F.lit(0), F.size("lines") - WIDTH))
    hashed = F.transform(starts, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, WIDTH), "\n"))))
    return lines.select("doc_id", "text_hash", F.posexplode(hashed).alias("line", "window"))


def covered_intervals(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, cuts)``: merged, ascending ``[first, end)`` line intervals of later occurrences."""
    windows = materialize(_windows(_lines(docs)), "windows")
    place = F.struct("doc_id", "text_hash", "line")
    repeated = windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select("window", "first"), "repeated")
    later = windows.join(repeated, "window").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line").distinct()
    of_doc = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    opens = (F.col("line") > F.coalesce(F.lag("line").over(of_doc), F.lit(-WIDTH - 1)) + WIDTH).cast("int")
    islands = later.withColumn("opens", opens).withColumn("island", F.sum("opens").over(of_doc))
    merged = islands.groupBy("doc_id", "text_hash", "island").agg(F.min("line").alias("first"), (F.max("line") + WIDTH).alias("end"))
    return merged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("cuts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` with later occurrences cut from ``text``."""
    lines, cuts = _lines(docs), covered_intervals(docs).withColumnsRenamed({"doc_id": "cut_id", "text_hash": "cut_hash"})
    rows = lines.join(cuts, lines["doc_id"].eqNullSafe(cuts["cut_id"]) & (lines["text_hash"] == cuts["cut_hash"]), "left")
    n = F.size("lines")
    cuts = F.coalesce("cuts", F.array().cast("array<struct<first:int,end:int>>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["first"]), F.array(n))
    spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["b"] > s["a"])
    kept = F.flatten(F.transform(spans, lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"])))
    removed = F.aggregate(cuts, F.lit(0), lambda x, c: x + c["end"] - c["first"])
    return rows.select("doc_id", F.array_join(kept, "\n").alias("text"), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': i - 1, 'txt': x}), recursive := true)
  FROM documents
), windows AS (
  SELECT doc_id, line, concat(txt, chr(10), lead(txt) OVER w, chr(10), lead(txt, 2) OVER w) AS body, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS r FROM windows WHERE line <= n - 3
), cut AS (
  SELECT DISTINCT doc_id, line + k AS line FROM ranked, (VALUES (0), (1), (2)) v(k) WHERE r > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
       sha256(coalesce(string_agg(l.txt, chr(10) ORDER BY l.line) FILTER (WHERE c.line IS NULL), '')) AS text_sha256
FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.line = c.line
GROUP BY l.doc_id
"""
