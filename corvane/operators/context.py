"""What of the results fits a model's context, as an ordered fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, PROMPT = 100, 384  # characters that a hit costs besides its text and source; tokens of the instructions


def fit_context(hits: DataFrame, context_length: int, max_output: int | None = None) -> DataFrame:
    """``(question_id, place, chunk_id, n_chars)`` of ``hits(question_id, question, rank, chunk_id, source, text)``, the best k of each question.

    In order of rank a hit is kept if it still fits; too long ones are passed over. A too long first one is cut and stands alone. The fold's state is what is
    used so far; it carries ids and lengths only, so texts are not gathered.
    """
    reserved = min(max_output or 512, max(128, context_length // 4))
    words = F.size(F.filter(F.split("question", r"\s+"), lambda w: w != ""))
    room = F.lit(3) * F.greatest(F.lit(128), F.lit(context_length - reserved - PROMPT) - 2 * words)
    cost = F.length("text") + F.length("source") + HEAD
    each = hits.select("question_id", room.alias("room"), F.struct("rank", "chunk_id", F.length("text").alias("n_chars"), cost.alias("cost")).alias("hit"))
    asked = each.groupBy("question_id", "room").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    first = F.get("hits", F.lit(0))
    nothing = F.struct(F.lit(0).alias("used"), F.filter("hits", lambda _: F.lit(False)).alias("kept"))

    def step(state, hit):
        fits = state["used"] + hit["cost"] <= F.col("room")
        return F.struct(F.when(fits, state["used"] + hit["cost"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(hit))).otherwise(state["kept"]).alias("kept"))

    alone = F.array(first.withField("n_chars", F.least(first["n_chars"], F.greatest(F.lit(1), F.col("room") - HEAD))))
    kept = F.when(first["cost"] > F.col("room"), alone).otherwise(F.aggregate("hits", nothing, step)["kept"])
    placed = asked.select("question_id", F.posexplode(kept).alias("place", "hit"))
    return placed.select("question_id", F.col("place").cast("long").alias("place"), "hit.chunk_id", F.col("hit.n_chars").cast("long").alias("n_chars"))
