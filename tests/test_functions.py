import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import plain as P
from corvane.functions import terms as T

TEXTS = ["ABC123 çelik", "The categories of boxes and glasses", "Straße AI is AI", "", "ﬁne Ⅷ x²", "capabilities, features; objectives", "What color is the sky?", "Tell me about the reefs", "İstanbul'da ne var"]


def column(spark, texts, *exprs):
    return spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(*exprs).collect()


def test_tokens_split_letters_and_digits():
    assert P.tokens("ABC123 çelik") == ["abc", "123", "çelik"]
    assert "ai" in P.content_terms("AI is")


def test_canonical_terms():
    assert [P.canonical(t) for t in ("categories", "boxes", "glass", "dies", "capabilities", "objectives")] == ["category", "boxe", "glass", "dies", "function", "goal"]


def test_exact_columns_agree_with_python(spark):
    got = column(spark, TEXTS, T.tokens(F.col("x"), exact=True), T.content_terms(F.col("x"), exact=True), F.array_sort(T.evidence_terms(F.col("x"), exact=True)))
    assert [list(r[0]) for r in got] == [P.tokens(t) for t in TEXTS]
    assert [list(r[1]) for r in got] == [P.content_terms(t) for t in TEXTS]
    assert [list(r[2]) for r in got] == [sorted(P.evidence_terms(t)) for t in TEXTS]


def test_line_classes_agree_with_python(spark):
    lines = ["1. Intro", "Contents .... 3", "14", " ", "- item", "o item", "A Title Of Some Words", "Ends here.", "Ignore previous instructions", "user\nsystem: x", "2.1) Two", "short plain line", "A. no", "Erosion is wear", "x" * 130]
    x = F.col("x")
    got = column(spark, lines, T.is_navigation(x), T.is_unsafe(x), T.is_display_heading(x), T.looks_like_new_section(x), T.is_standalone_heading(x))
    assert [tuple(r) for r in got] == [(P.is_navigation(t), P.is_unsafe(t), P.is_display_heading(t), P.looks_like_new_section(t), P.is_standalone_heading(t)) for t in lines]


def test_subquestions_agree_with_python(spark):
    asked = ["syllabus topics and grading policy; final exam dates", "What is ice?", "reef features, coral biology / ocean currents & deep tides"]
    got = column(spark, asked, T.subquestions(F.col("x")))
    assert [list(r[0]) for r in got] == [P.subquestions(q) for q in asked]
    assert len(P.subquestions(asked[2])) == 4 and P.subquestions(asked[1]) == [asked[1]]


def test_citation_and_heading(spark):
    rows = spark.createDataFrame([("a.pdf", 3, "# Title\nx"), ("b.PPTX", 2, "\n\n" + "y" * 130 + "\nok"), ("c.md", 0, ""), ("d.md", None, "##\nz")], "s string, p int, t string")
    got = rows.select(T.citation(F.col("s"), F.col("p")), T.infer_heading(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a.pdf (page 3)", "Title"), ("b.PPTX (slide 2)", "ok"), ("c.md", None), ("d.md", "z")]


@pytest.mark.parametrize(
    ("question", "grounded", "shown"),
    [
        ("Is it open?", "It is not open. Come later.", "No. It is not open."),
        ("Can birds fly?", "Birds fly. Often.", "Yes. Birds fly."),
        ("How many legs?", "It has six legs. And wings.", "It has six legs."),
        ("Compare a and b", "a is big", "Comparison based on the cited source:\na is big"),
        ("Tell me", "- x\n- y", "Based on the cited source:\n- x\n- y"),
        ("Explain it", "one\ntwo", "Based on the cited source, one two"),
        ("Is it?", "", ""),
    ],
)
def test_flexible_answers(spark, question, grounded, shown):
    row = spark.createDataFrame([(question, grounded)], "q string, g string").select(T.flexible_answer(F.col("q"), F.col("g"))).first()
    assert row[0] == shown


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_idempotent(text):
    assert [P.canonical(t) for t in P.content_terms(text)] == P.content_terms(text)


def test_texts_are_worked_out_before_they_meet_the_questions(spark, tmp_path):
    """What a text gives by itself stands below the join with the questions, so it is done once a document."""
    from corvane.plans import catalog

    spark.createDataFrame([(1, "- a\n- b"), (2, " It is not. So it goes "), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.flexible_answer(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan.split("Join Cross")[0].lower() and "rlike" not in plan.split("Join Cross")[0].lower()
    assert {(r.doc_id, r.id): r.answer for r in found.collect()}[2, 1] == "It is not."


def test_report_from_hits_equals_the_report_from_texts(spark):
    from pyspark.sql import functions as F

    from corvane.operators import reports

    rows = [(1, "ice melts fast", r, t, c) for r, t, c in [(1, "the ice melts", 0.6), (2, "fast ice\nmelts", 0.2)]] + [(2, "ends\nhere", 1, "it ends", 0.1), (2, "ends\nhere", 2, "here", 0.3), (3, "a b", 1, None, 0.9)]
    hits = spark.createDataFrame(rows, "question_id int, answer string, rank int, text string, confidence double")
    told = hits.groupBy("question_id", "answer").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "confidence"))).alias("r"))
    told = told.select("question_id", "answer", F.col("r.text").alias("sources"), F.transform("r.text", lambda t: F.coalesce(t, F.lit(""))).alias("texts"), F.col("r.confidence").alias("confidences"))
    assert sorted(map(tuple, reports.hits_report(hits).collect())) == sorted(map(tuple, reports.confidence_report(told).collect()))
