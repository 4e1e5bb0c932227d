import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks, matching, ranking, vectors
from corvane.operators import retrieval as R
from corvane.operators.index import build_index


def table(spark, n, seed, name, dims=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, dims), 1)]) for i in range(n)] + [(n, None), (n + 1, [0.0] * dims)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>"), dict(rows)


def brute(a, b):
    x, y = np.array(a), np.array(b)
    norm = np.linalg.norm(x) * np.linalg.norm(y)
    return round(float(x @ y / norm), 9) + 0.0 if norm else 0.0


@pytest.mark.parametrize(("block", "panel"), [(2048, 128), (7, 3)])
def test_scores_by_blocks_equal_all_pairs(spark, monkeypatch, block, panel):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PANEL", panel)
    (held, v), (asked, q) = table(spark, 40, 1, "chunk_id"), table(spark, 9, 2, "question_id")
    want = {(i, c): brute(q[i], v[c]) for i in q for c in v if q[i] is not None and v[c] is not None}
    got = {(r.question_id, r.chunk_id): r.semantic for r in vectors.semantic_scores(held, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    best = {(r.question_id, r["rank"]): r.chunk_id for r in vectors.nearest_chunks(held, asked, 4).collect()}
    for i in {i for i, _ in want}:
        assert [best[i, k] for k in (1, 2, 3, 4)] == sorted((c for j, c in want if j == i), key=lambda c: (-got[i, c], c))[:4]


def test_no_side_of_the_scores_is_crossed_or_broadcast_by_hand(spark):
    (held, _), (asked, _) = table(spark, 10, 1, "chunk_id"), table(spark, 3, 2, "question_id")
    plan = vectors.semantic_scores(held, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert vectors.semantic_scores(held, asked.where("false")).count() == 0 and vectors.semantic_scores(held.where("false"), asked).count() == 0


def test_ranks_of_one_large_group_come_from_ranges(spark):
    rng = random.Random(1)
    rows = [("all" if rng.random() < 0.9 else f"g{rng.randrange(5)}", rng.randrange(50) / 10, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, s double, position long").repartition(7)
    want = {}
    for g in {r[0] for r in rows}:
        for rank, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = rank
    assert {r.position: r["rank"] for r in ranking.numbered(df, "g", [F.desc("s"), F.col("position")]).collect()} == want


@pytest.mark.parametrize("every", [False, True])
def test_substrings_equal_a_search_of_every_pair(spark, every):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(i, word(rng.randrange(60))) for i in range(80)] + [(80, None), (81, "")]
    patterns = [(f"p{i}", word(rng.randint(1, 5))) for i in range(50)] + [("same", "ab"), ("twice", "ab"), ("none", None), ("empty", "")]
    want = {(t, p, m.start()) for t, text in texts if text for p, pattern in patterns if pattern for m in [*re.finditer(f"(?={re.escape(pattern)})", text)][: None if every else 1]}
    a, b = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(patterns, "pattern_id string, pattern string")
    for size in (50_000, 9):
        got = matching.substring_matches(a, b, every, size).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hybrid_plans_have_no_cross_join(spark):
    rows = [(f"c{i}", i, "s", None, t, [1.0 * i, 1.0]) for i, t in enumerate(["ice on ice", "snow falls", "art of rain", "smart ice"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, position long, source string, heading string, text string, vector array<double>")
    asked = spark.createDataFrame([(0, "art", [1.0, 0.0]), (1, "where is the ice", [0.0, 1.0])], "question_id int, question string, vector array<double>")
    found = R.search(build_index(chunks), asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.where("question_id = 0 AND rank = 1").first().chunk_id == "c2"
    assert {r.chunk_id for r in found.where("question_id = 0").collect()} >= {"c2", "c3"}


def corpus(spark, n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{x}" for x in "abcdefghijklmnop"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(n)]
    rows = [(i, i, f"s{i % 3}", rng.choice([None, *words]), t, [round(rng.gauss(0, 1), 1) for _ in range(4)] if i % 5 else None) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "chunk_id long, position long, source string, heading string, text string, vector array<double>")
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), [round(rng.gauss(0, 1), 1) for _ in range(4)] if i % 4 else None) for i in range(11)] + [(11, "", None), (12, "the", None)]
    return held, spark.createDataFrame(asked, "question_id long, question string, vector array<double>"), rows, asked


def _found(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_blocks_and_panels_meet_without_a_broadcast(spark):
    """A panel goes to each block: small as files, the panels sent grow with the corpus, and the driver would hold them all."""
    texts, asked, _, _ = corpus(spark)
    index = build_index(texts)
    found = [R.bm25_best(index, asked, 3), R.rerank_features(index, asked), R.search(index, asked, 3), vectors.nearest_chunks(texts.select("chunk_id", "vector"), asked, 3)]
    for df in found:
        joins = re.findall(r"(\w+Join) \[(?:block|panel)#", df._jdf.queryExecution().executedPlan().toString())
        assert joins and set(joins) == {"SortMergeJoin"}


def test_a_partition_gathers_few_blocks(spark):
    rows = spark.range(400).withColumnRenamed("id", "chunk_id")
    dealt = blocks._dealt(rows, "chunk_id", 40, "block", "members")
    shares = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert dealt.rdd.getNumPartitions() == 20 and sum(r["count"] for r in shares) == 40
    assert sorted(m.chunk_id for r in dealt.collect() for m in r.members) == list(range(400))


def test_results_do_not_depend_on_blocks_or_slices(spark, monkeypatch):
    """Many small blocks, panels and slices of terms give the ranks that one block gives, where every pair is ranked at once."""
    held, asked, _, _ = corpus(spark)
    index = build_index(held)
    answers = asked.select("question_id", "question", F.col("question").alias("answer"))

    def results():
        return [
            _found(R.search(index, asked, 7), "question_id", "rank", "chunk_id", "score", "lexical", "semantic", "confidence"),
            _found(R.search(index, asked.drop("vector"), 100), "question_id", "rank", "chunk_id", "score"),
            _found(R.bm25_best(index, asked, 3), "question_id", "rank", "chunk_id", "lexical"),
            _found(R.rerank_features(index, asked), "question_id", "chunk_id", "rerank", "lexical_confidence"),
            _found(R.fused_ranks(index, held.select("chunk_id", "vector"), asked), "question_id", "chunk_id", "fused"),
            _found(R.source_context(index, answers, 2), "question_id", "source", "place", "chunk_id", "merit"),
        ]

    whole = results()
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "PANEL", 3)
    monkeypatch.setattr(blocks, "CELLS", 20)
    assert results() == whole and all(whole)


def test_no_pair_of_question_and_chunk_is_joined_to_texts(spark):
    held, asked, _, _ = corpus(spark)
    index = build_index(held)
    plan = R.source_context(index, asked.select("question_id", "question", F.col("question").alias("answer")))._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and not re.search(r"keys=\[question_id#\d+L?, chunk_id", plan)


def test_source_context_equals_a_loop(spark):
    held, asked, rows, questions = corpus(spark)
    answers = asked.select("question_id", "question", F.col("question").alias("answer"))
    lexical = {(r.question_id, r.chunk_id): r.lexical for r in R.bm25(build_index(held), asked).collect()}
    want = set()
    for q, text, _ in questions:
        terms = {t for t in text.split() if len(t) > 3}
        for source in {r[2] for r in rows}:
            merits = [(-round(5 * (text in r[4]) + len(terms & set(r[4].split())) + lexical[q, r[0]], 9), r[0]) for r in rows if r[2] == source and (q, r[0]) in lexical]
            want |= {(q, source, place, c) for place, (_, c) in enumerate(sorted(merits)[:2], 1)}
    assert set(_found(R.source_context(build_index(held), answers, 2), "question_id", "source", "place", "chunk_id")) == want
