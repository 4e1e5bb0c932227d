"""What a user asks about an index: summaries, differences, confidence, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

# How much to retrieve, (k or None for automatic, neighbour window).
PRESETS = {"Precise": (2, 0), "Balanced": (None, 2), "Thorough": (6, 3)}


def source_counts(chunks: DataFrame) -> DataFrame:
    """``(source, n_chunks, n_pages)``; page 0 and null are no pages."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct(F.when(F.col("page") != 0, F.col("page"))).alias("n_pages"))


def suffix(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"(\.[^./]+)$", 1))


def index_summary(chunks: DataFrame) -> DataFrame:
    """``(suffix, n_files, n_chunks)``."""
    return source_counts(chunks).groupBy(suffix(F.col("source")).alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chunks").alias("n_chunks"))


def skipped_note(names: list[str]) -> str:
    return ", ".join(names[:5]) + (f" +{len(names) - 5} more" if len(names) > 5 else "")


def index_diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Signatures ``(source, mtime_ns, size)`` now and as indexed to ``(source, state)``: changed, reused or removed."""
    a, b = current.alias("a"), indexed.alias("b")
    same = F.col("a.mtime_ns").eqNullSafe(F.col("b.mtime_ns")) & F.col("a.size").eqNullSafe(F.col("b.size"))
    state = F.when(F.col("a.source").isNull(), "removed").when(F.col("b.source").isNotNull() & same, "reused").otherwise("changed")
    return a.join(b, F.col("a.source") == F.col("b.source"), "full").select(F.coalesce("a.source", "b.source").alias("source"), state.alias("state"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("changed", "reused", "removed")])


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"), 0)


def loose_terms(text: Column, longer_than: int = 0) -> Column:
    """Case-folded letter and digit runs of the raw text."""
    found = F.transform(raw_tokens(text), lambda t: T.normal_form(t))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > longer_than))


def confidence_report(answers: DataFrame) -> DataFrame:
    """``answers(question_id, answer, sources, texts array, confidences array)`` to ``(question_id, overlap, level)``."""
    text = answers.select("question_id", "answer", F.size("sources").alias("n"), F.col("confidences"), "texts", loose_terms(F.col("answer"), 3).alias("asked"))
    shared = F.array_distinct(F.flatten(F.transform("texts", lambda t: F.array_intersect("asked", loose_terms(t)))))
    return _levels(text.select("question_id", "answer", "n", F.array_max("confidences").alias("best"), "texts", "asked", shared.alias("shared")))


def hits_report(hits: DataFrame) -> DataFrame:
    """``hits(question_id, answer, rank, text, confidence)`` to ``(question_id, overlap, level)``. Each text is brought to terms where it stands, before a question's
    hits are gathered; so no task works through all texts of many questions."""
    asked = hits.withColumn("asked", loose_terms(F.col("answer"), 3))
    each = asked.withColumn("shared", F.array_intersect("asked", loose_terms(F.coalesce("text", F.lit("")))))
    told = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"])
    gathered = each.groupBy("question_id").agg(F.first("answer").alias("answer"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"), told.alias("texts"), F.first("asked").alias("asked"), F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    return _levels(gathered)


def _levels(told: DataFrame) -> DataFrame:
    overlap = F.when(F.size("asked") == 0, 0.0).otherwise(F.size("shared") / F.size("asked"))
    exact = (F.col("answer") != "") & F.contains(F.array_join("texts", "\n"), F.col("answer"))
    worked = told.select("question_id", "n", F.coalesce("best", F.lit(0.0)).alias("best"), overlap.alias("overlap"), exact.alias("exact"))
    return worked.select("question_id", "overlap", T.confidence_level(F.col("n"), F.col("exact"), F.col("best"), F.col("overlap")).alias("level"))


def document_list(files: DataFrame, order: str = "Name", contains: str = "") -> DataFrame:
    """Files ``(source, mtime_ns, size)`` by Name, Newest, Largest or Type."""
    name = F.lower("source")
    keys = {"Name": [name], "Newest": [F.desc("mtime_ns"), name], "Largest": [F.desc("size"), name], "Type": [suffix(F.col("source")), name]}
    return files.where(F.contains(name, F.lit(contains.lower()))).orderBy(*keys[order])


def selection_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def inspector(results: DataFrame) -> DataFrame:
    """Results as shown to a user."""
    kind = F.when((F.col("lexical") == 0) & (F.col("semantic") == 0), "Neighbor").otherwise("Match")
    return results.select("question_id", "rank", "source", "page", kind.alias("kind"), *[F.round(c, 3).alias(c) for c in ("score", "confidence", "lexical", "semantic")], T.snippet(F.col("text")).alias("snippet"))


def first_offset(text: Column, quote: Column) -> Column:
    """Where the quote first stands, from 0; null if nowhere."""
    at = F.position(quote, text)
    return F.when((quote != "") & (at > 0), at - 1)


def term_offsets(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Whole-word occurrences, case ignored, longest terms first, in order of place."""
    import re

    if not (ordered := sorted(filter(None, terms), key=lambda t: (-len(t), t))):
        return []
    return [m.span() for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, ordered))})\b", text, re.I)]
