"""Chunking: size limits from a text's own structure, recursive splitting, stable ids and positions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.terms import infer_heading, stripped
from ..tables import materialize

# Fixed value: where lines end.
LINE_BREAK = r"\R|[\x0b\x0c\x1c-\x1e\x85  ]"
# Where to cut, coarsest first; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def _lengths(parts: Column) -> Column:
    return F.sort_array(F.filter(F.transform(parts, lambda p: F.length(stripped(p))), lambda n: n > 0))


def _upper_quartile(sorted_lengths: Column) -> Column:
    return F.get(sorted_lengths, F.floor((F.size(sorted_lengths) - 1) * 0.75).cast("int"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chunk_limits(text: Column) -> Column:
    """``struct<size, overlap>``: three typical paragraphs or twelve times the root of the length, no more than the text."""
    lengths = F.struct(_lengths(F.split(text, "\n\n")).alias("paragraphs"), _lengths(F.split(text, LINE_BREAK)).alias("lines"), F.greatest(F.lit(1), F.length(text)).alias("whole"))

    def size_of(told: Column) -> Column:
        paragraphs, whole = told["paragraphs"], told["whole"]
        typical = F.greatest(F.lit(80), F.least(_upper_quartile(paragraphs), _upper_quartile(told["lines"]) * 4))
        scale = F.greatest(F.lit(1), F.bround(F.sqrt(whole)).cast("int"))
        plain = F.least(F.greatest(typical * 3, scale * 12), whole)
        size = F.when(F.contains(text, F.lit("\nAnswer: ")), F.least(whole, F.greatest(plain, F.array_max(paragraphs)))).otherwise(plain)
        blank = F.size(paragraphs) == 0
        return F.struct(F.when(blank, whole).otherwise(size).cast("int").alias("size"), blank.alias("blank"))

    def with_overlap(told: Column) -> Column:
        size = told["size"]
        overlap = F.when(told["blank"] | (size <= 1), 0).otherwise(F.least(size - 1, F.bround(size * 0.15).cast("int")))
        return F.struct(size.alias("size"), overlap.alias("overlap"))

    return _once(_once(lengths, size_of), with_overlap)


def windows(text: Column, size: Column, overlap: Column) -> Column:
    """Fixed windows, the last step of splitting: stripped, blank ones left out."""
    last = F.greatest(F.lit(0), F.length(text) - overlap - 1)
    starts = F.sequence(F.lit(0), last, size - overlap)
    return F.filter(F.transform(starts, lambda s: stripped(F.substring(text, s + 1, size))), lambda w: w != "")


def chunk_id(source: Column, position: Column, page: Column, text: Column) -> Column:
    zero = F.char(F.lit(0))
    payload = F.concat(source, zero, position.cast("string"), zero, F.coalesce(page, F.lit(0)).cast("string"), zero, text)
    return F.concat(F.lit("chunk-"), F.substring(F.sha2(payload, 256), 1, 20))


def _units(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p + separator for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _fill(units: list[str], size: int, overlap: int) -> list[str]:
    """Units joined to chunks of at most ``size``; the last units of a chunk that fit in ``overlap`` open the next."""
    chunks, held, n = [], deque(), 0

    def close() -> None:
        if text := "".join(held).strip():
            chunks.append(text)

    for unit in filter(None, units):
        if held and n + len(unit) > size:
            close()
            carried = keep = 0
            while keep < len(held) and carried + len(held[-1 - keep]) <= overlap:
                carried += len(held[-1 - keep])
                keep += 1
            while len(held) > keep:
                held.popleft()
            n = carried
            while held and n + len(unit) > size:
                n -= len(held.popleft())
        held.append(unit)
        n += len(unit)
    close()
    return chunks


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped pieces of at most ``size`` characters, cut at the coarsest separator that the text has."""
    body = text.strip()
    if len(body) <= size:
        return [body] if body else []
    level = next(i for i, s in enumerate(separators) if s in text)
    separator, finer = separators[level], separators[level + 1 :] or ("",)
    if not separator:
        cuts = range(0, max(1, len(text) - overlap), size - overlap)
        return [w for w in (text[at : at + size].strip() for at in cuts) if w]
    units: list[str] = []
    for unit in _units(text, separator):
        units += [unit] if len(unit.strip()) <= size else split_text(unit, size, overlap, finer)
    return _fill(units, size, overlap)


@F.pandas_udf(ArrayType(StringType()))
def _split(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([split_text(t, int(n), int(o)) for t, n, o in zip(text, size, overlap)], dtype=object)


def running_number(source: str, order: str, size: Column) -> Column:
    """How many there are before a row in its source."""
    before = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0))


def _offsets(sizes: DataFrame) -> DataFrame:
    """``(source, offset)``: running sums of ``sizes(source, n)`` in the order of path parts. Sources are dealt to ranges; each range sums its own
    rows, and only the ranges' totals, one row a task, meet in one place."""
    ranged = sizes.withColumn("parts", F.split("source", "/")).repartitionByRange("parts").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    inside = Window.partitionBy("range").orderBy("parts").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total")).select("range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    summed = ranged.select("source", "range", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within")).join(totals, "range")
    return summed.select("source", (F.col("base") + F.col("within")).alias("offset"))


def chunk_sections(sections: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Sections ``(source, section, page, text)`` to chunks ``(chunk_id, position, source, page, heading, text)``.

    Limits left open follow each section's own structure. Numbers run on over a source's sections; ``position`` runs over
    everything in the order of path parts, from one row a source.
    """
    if size is not None and size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap is not None and (overlap < 0 or (size is not None and size <= overlap)):
        raise ValueError("overlap must be from 0 to below the chunk size")
    limits = chunk_limits(F.col("text"))
    told = sections.where(stripped(F.col("text")) != "").withColumn("limits", limits).withColumns({"size": F.lit(size) if size else F.col("limits.size"), "overlap": F.lit(overlap) if overlap is not None else F.col("limits.overlap")})
    fits = F.when(F.col("size") > F.col("overlap"), F.col("size")).otherwise(F.raise_error(F.lit("chunk size must exceed the overlap")).cast("int"))
    cut = told.select("source", "section", "page", infer_heading(F.col("text")).alias("heading"), _split("text", fits, "overlap").alias("pieces"))
    pieces = materialize(cut, "pieces")
    numbered = pieces.withColumn("before", running_number("source", "section", F.size("pieces")))
    each = numbered.select("source", "page", "heading", "before", F.posexplode("pieces").alias("i", "piece"))
    number = F.col("before") + F.col("i") + 1
    rows = each.select("source", "page", "heading", F.col("piece").alias("text"), number.alias("number"))
    sizes = pieces.groupBy("source").agg(F.sum(F.size("pieces")).alias("n"))
    placed = rows.join(_offsets(sizes), "source")
    return placed.select(chunk_id(F.col("source"), F.col("number"), F.col("page"), F.col("text")).alias("chunk_id"), (F.col("offset") + F.col("number") - 1).alias("position"), "source", "page", "heading", "text")

