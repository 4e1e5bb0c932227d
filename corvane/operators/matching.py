"""Many patterns in many texts: which texts hold which patterns, and where.

A pass over the texts runs one Aho-Corasick automaton a task, whose patterns are a slice of bounded size; more patterns take more passes. So the
cost is one reading of each text a slice, whatever the number of pairs, and nothing is joined pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_PATTERNS, SLICE_CHARACTERS = 50_000, 8_000_000  # of one automaton


def _automaton(patterns: dict[str, list]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, ids in patterns.items():
        found.add_word(pattern, (len(pattern), ids))
    found.make_automaton()
    return found


def substring_matches(texts: DataFrame, patterns: DataFrame, every: bool = False, slice_patterns: int = SLICE_PATTERNS) -> DataFrame:
    """``(text_id, pattern_id, offset)`` for ``texts(text_id, text)`` and ``patterns(pattern_id, pattern)``: where each pattern first stands in each text that
    holds it, from 0; with ``every`` all places, also overlapping ones. Null texts and patterns and empty patterns match nothing."""
    asked = patterns.where("pattern != ''").select("pattern_id", "pattern")
    n, characters = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    slices = max(-(-n // slice_patterns), -(-characters // SLICE_CHARACTERS))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((texts, "text_id"), (patterns, "pattern_id"))}
    schema = ", ".join([*(f"{c} {kind}" for c, kind in kinds.items()), "offset int"])
    out = texts.sparkSession.createDataFrame([], schema)
    for i in range(slices):
        part = asked.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == i).toArrow()  # bounded by the slice's size
        ids: dict[str, list] = {}
        for pattern, own in zip(part.column("pattern").to_pylist(), part.column("pattern_id").to_pylist()):
            ids.setdefault(pattern, []).append(own)
        out = out.union(texts.where("text IS NOT NULL").select("text_id", "text").mapInArrow(_search(ids, every, part.schema.field("pattern_id").type), schema))
    return out


def _search(patterns: dict[str, list], every: bool, id_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns)
        for batch in batches:
            row, found, places = [], [], []
            for i, text in enumerate(batch.column("text")):
                seen = set()
                for end, (length, ids) in automaton.iter(text.as_py()):
                    for own in ids if every else [x for x in ids if x not in seen]:
                        row.append(i)
                        found.append(own)
                        places.append(end - length + 1)
                    seen.update(ids)
            texts = batch.column("text_id").take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([texts, pa.array(found, id_type), pa.array(places, pa.int32())], ["text_id", "pattern_id", "offset"])

    return search
