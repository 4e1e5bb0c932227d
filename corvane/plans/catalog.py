"""Named queries over the driver's tables, with their SQL counterparts.

Documents stand for chunks: ``doc_id`` is id and position, ``source`` the source, the inferred first heading the
heading. ``benchmark`` texts are the questions. Vector ``vec_id`` belongs to the document and to the question of that id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import vocabulary as V
from ..operators import answering as A
from ..operators import chunking as C
from ..operators import evidence as E
from ..operators import reports as P
from ..operators import retrieval as R
from ..operators.context import fit_context
from ..operators.matching import substring_matches
from ..operators.vectors import nearest_chunks
from ..operators.index import body_bags, build_index, corpus_stats, document_frequency
from ..sources import store as ST
from ..tables import materialize
from . import sql as S

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), "source", T.infer_heading(F.col("text")).alias("heading"), "text")
    if not vectors:
        return docs
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return docs.join(held, "chunk_id", "left")


def questions(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    if not vectors:
        return asked
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return asked.join(held, "question_id", "left")


def six(column: str):
    return F.round(column, 6).alias(column)


# ---- tokens, terms and statistics


@query(f"SELECT doc_id, len({S.tok('text')}) AS n_tokens, len({S.content('text')}) AS n_terms, len(list_distinct({S.content('text')})) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(text)).cast("long").alias("n_tokens"), F.size(T.content_terms(text)).cast("long").alias("n_terms"), F.size(T.term_set(text)).cast("long").alias("n_distinct"))


@query(f"WITH {S.CHUNKS} SELECT chunk_id, term, tf FROM bags")
def content_term_freq(spark, sf_dir):
    return body_bags(chunks(spark, sf_dir))


@query(f"WITH {S.CHUNKS} SELECT term, df FROM dfs")
def term_document_frequency(spark, sf_dir):
    return document_frequency(body_bags(chunks(spark, sf_dir)))


@query(f"WITH {S.CHUNKS} SELECT n_chunks, round(average_length, 6) AS average_length FROM stats")
def index_stats(spark, sf_dir):
    return corpus_stats(chunks(spark, sf_dir)).select("n_chunks", six("average_length"))


@query(f"WITH {S.CHUNKS} SELECT question_id, term, qf FROM qterms")
def query_term_multiplicity(spark, sf_dir):
    return R.question_terms(questions(spark, sf_dir)).select("question_id", "term", "qf")


# ---- retrieval


@query(f"""WITH {S.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, chunk_id) AS rank FROM bm25)
SELECT question_id, rank, chunk_id, round(lexical, 6) AS lexical FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    return R.bm25_best(build_index(chunks(spark, sf_dir)), questions(spark, sf_dir), 10).select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", six("lexical"))


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY semantic DESC, chunk_id) AS rank FROM sem)
SELECT question_id, rank, chunk_id, round(semantic, 6) AS semantic FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    best = nearest_chunks(held, questions(spark, sf_dir, vectors=True), 10)
    return best.select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", six("semantic"))


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}
SELECT question_id, chunk_id, round(rerank, 6) AS rerank, round(lexical_confidence, 6) AS lexical_confidence FROM features WHERE lexical > 0 OR rerank > 0""")
def rerank_features(spark, sf_dir):
    found = R.rerank_features(build_index(chunks(spark, sf_dir)), questions(spark, sf_dir)).where("lexical > 0 OR rerank > 0")
    return found.select("question_id", "chunk_id", six("rerank"), six("lexical_confidence"))


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, chunk_id) AS rank FROM bm25),
s AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY semantic DESC, chunk_id) AS rank FROM sem WHERE semantic > 0)
SELECT question_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused
FROM (SELECT question_id, chunk_id, rank FROM l UNION ALL SELECT question_id, chunk_id, rank FROM s) GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    asked = questions(spark, sf_dir, vectors=True)
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.fused_ranks(build_index(chunks(spark, sf_dir)), held, asked).select("question_id", "chunk_id", six("fused"))


def _hybrid(spark, sf_dir, k=10):
    return R.search(build_index(chunks(spark, sf_dir, vectors=True)), questions(spark, sf_dir, vectors=True), k)


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID}
SELECT question_id, rank, chunk_id, round(score, 6) AS score, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(confidence, 6) AS confidence
FROM results WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", six("score"), six("lexical"), six("semantic"), six("confidence"))


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID}
SELECT question_id, round(confidence, 6) AS confidence, round(least(0.45, 0.25 + 0.15 / sqrt(greatest(1, len(list_distinct(terms))))), 6) AS least_confidence,
       confidence < least(0.45, 0.25 + 0.15 / sqrt(greatest(1, len(list_distinct(terms))))) AS abstains
FROM results JOIN asked USING (question_id) WHERE rank = 1""")
def confidence_gate(spark, sf_dir):
    best = _hybrid(spark, sf_dir, 1).join(questions(spark, sf_dir), "question_id")
    least = T.minimum_confidence(F.col("question"))
    return best.select("question_id", six("confidence"), F.round(least, 6).alias("least_confidence"), (F.col("confidence") < least).alias("abstains"))


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID}, hits AS (SELECT * FROM results WHERE rank <= 3),
steps AS (SELECT d AS off, s AS side FROM (VALUES (1), (2)) a(d), (VALUES (0), (1)) b(s)),
ordered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
near AS (
  SELECT h.question_id, n.doc_id AS chunk_id, h.score / (off + 1) AS score, 1 AS hit, h.rank, off, side
  FROM hits h JOIN ordered o ON o.doc_id = h.chunk_id CROSS JOIN steps
  JOIN ordered n ON n.source = o.source AND n.place = o.place + CASE WHEN side = 0 THEN -off ELSE off END
), every AS (
  SELECT question_id, chunk_id, score, 0 AS hit, rank, 0 AS off, 0 AS side FROM hits UNION ALL SELECT * FROM near
), first AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY hit, rank, off, side) AS turn FROM every
)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY hit, rank, off, side) AS rank, chunk_id, round(score, 6) AS score,
       CASE WHEN hit = 1 THEN 'Neighbor' ELSE 'Match' END AS kind FROM first WHERE turn = 1""")
def neighbor_expand(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("source").orderBy("chunk_id"))
    near = chunks(spark, sf_dir).withColumn("position", place.cast("long"))
    hits = materialize(_hybrid(spark, sf_dir, 3), "ranked").drop("position").join(near.select("chunk_id", "position"), "chunk_id")
    return R.expand_neighbours(hits, near, 2).select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", six("score"), "kind")


@query("SELECT greatest(1, least(count(*), greatest(3, ceil(log2(count(*) + 1))))) :: INTEGER AS k, greatest(1, least(count(*), greatest(3, ceil(log2(count(*) + 1))), greatest(1, floor(((4096 - 512 - 256) * 3) / greatest(1, round_even(avg(length(text)), 0)))))) :: INTEGER AS k_context FROM documents")
def dynamic_top_k(spark, sf_dir):
    held = chunks(spark, sf_dir)
    return R.dynamic_k(held).crossJoin(R.dynamic_k(held, 4096, 512).withColumnRenamed("k", "k_context"))


# ---- chunking


@query(rf"""WITH p AS (
  SELECT doc_id, text, greatest(1, length(text)) AS n,
         list_sort(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: length({S.strip('x')})), lambda k: k > 0)) AS paragraphs,
         list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: length({S.strip('x')})), lambda k: k > 0)) AS lines
  FROM documents
), q AS (
  SELECT *, greatest(80, least(paragraphs[(floor((len(paragraphs) - 1) * 0.75) + 1)::INT], 4 * lines[(floor((len(lines) - 1) * 0.75) + 1)::INT])) AS typical,
         greatest(1, round_even(sqrt(n), 0)::INT) AS scale FROM p
), s AS (
  SELECT doc_id, len(paragraphs) AS np, n, CASE WHEN contains(text, chr(10) || 'Answer: ') THEN least(n, greatest(least(greatest(typical * 3, scale * 12), n), list_max(paragraphs)))
         ELSE least(greatest(typical * 3, scale * 12), n) END AS size FROM q
)
SELECT doc_id, (CASE WHEN np = 0 THEN n ELSE size END)::BIGINT AS size,
       (CASE WHEN np = 0 OR size <= 1 THEN 0 ELSE least(size - 1, round_even(size * 0.15, 0)) END)::BIGINT AS overlap FROM s""")
def chunk_limits(spark, sf_dir):
    limits = C.chunk_limits(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", limits["size"].cast("long").alias("size"), limits["overlap"].cast("long").alias("overlap"))


@query(f"SELECT doc_id, {S.heading('text')} AS heading FROM documents")
def infer_heading(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_heading(F.col("text")).alias("heading"))


@query("SELECT doc_id, 'chunk-' || substring(sha256(concat(source, chr(0), doc_id::VARCHAR, chr(0), '0', chr(0), text)), 1, 20) AS chunk_id FROM documents")
def stable_chunk_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.chunk_id(F.col("source"), F.col("doc_id"), F.lit(None).cast("int"), F.col("text")).alias("chunk_id"))


@query(f"""WITH w AS (
  SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 75 - 1), 425)) AS pos FROM documents
), p AS (SELECT doc_id, pos, {S.strip('substring(text, pos + 1, 500)')} AS piece FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal, piece FROM p WHERE piece != ''""")
def window_chunks(spark, sf_dir):
    pieces = C.windows(F.col("text"), F.lit(500), F.lit(75))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("ordinal", "piece")).withColumn("ordinal", F.col("ordinal").cast("long"))


def _sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.lit(0).alias("section"), F.lit(None).cast("int").alias("page"), "text")


@query()
def recursive_chunks(spark, sf_dir):
    return C.chunk_sections(_sections(spark, sf_dir))


@query("""WITH l AS (SELECT source, doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents)
SELECT source, doc_id, n_lines, coalesce(sum(n_lines) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l""")
def running_position(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return lines.withColumn("before", C.running_number("source", "doc_id", F.col("n_lines")))


# ---- question functions, on every benchmark text and every line of the documents

ASKED = [
    "What is a glacier?", "What color is the sky?", "what are the sizes of the modules", "What is the colour of coral", "How many polyps are there?",
    "Does the reef grow?", "Compare corals and sponges", "List the features", "Tell me about the document", "Which capabilities and objectives does the course have?",
    "What does erosion mean?", "Define AI", "When was the dam built?", "pros and cons of solar versus wind power", "Can it fly, and with which wings", "syllabus topics and grading policy details; exam dates list", "",
]
def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(rows)) + ") v(id, line)"


_LINES = """(SELECT 'b' || item_id AS id, text AS line FROM benchmark
UNION ALL SELECT 'd' || doc_id || ':' || i, txt FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'txt': x}), recursive := true) FROM documents)) v"""


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.col("text").alias("line"))
    return asked.unionByName(lines.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(":"), F.col("i")).alias("id"), "line"))


@query(f"""SELECT id, CASE WHEN {S.matches('line', V.YES_NO_QUESTION_CI)} THEN 'yes_no' WHEN {S.matches('line', V.SHORT_VALUE_QUESTION_CI)} THEN 'short_value'
WHEN {S.matches('line', V.COMPARISON_QUESTION_CI)} THEN 'comparison' WHEN {S.matches('line', V.LIST_QUESTION_CI)} THEN 'list' ELSE 'other' END AS class,
{S.attribute('line')} AS attribute, {S.matches('line', V.DEFINITION_QUESTION_CI)} AS definition FROM {_LINES}""")
def question_classes(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("id", T.question_class(line).alias("class"), T.is_attribute_question(line).alias("attribute"), T.is_definition_question(line).alias("definition"))


@query(f"SELECT id, array_to_string(list_sort({S.evidence_terms('line')}), ' ') AS evidence, array_to_string(list_sort({S.rerank_terms('line')}), ' ') AS ranked FROM {_LINES}")
def evidence_terms(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("id", F.array_join(F.array_sort(T.evidence_terms(line)), " ").alias("evidence"), F.array_join(F.array_sort(T.rerank_terms(line)), " ").alias("ranked"))


@query(f"""WITH q AS (SELECT item_id, text FROM benchmark)
SELECT item_id, round(least(0.45, 0.25 + 0.15 / sqrt(greatest(1, len(list_distinct({S.content('text')}))))), 6) AS least_confidence FROM q""")
def min_confidence(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(T.minimum_confidence(F.col("text")), 6).alias("least_confidence"))


@query(rf"""WITH l AS (SELECT id, line FROM {_LINES}), w AS (SELECT *, list_filter(string_split({S.compact('line')}, ' '), lambda x: x != '') AS words FROM l)
SELECT id, {S.matches('line', V.UNSAFE_CI, 'im')} AS unsafe,
       ({S.compact('line')} = '' OR {S.matches(S.compact('line'), V.PAGE_LEADER, 'c')} OR regexp_full_match({S.compact('line')}, '\p{{Nd}}+')) AS navigation,
       (length(line) <= 90 AND NOT regexp_matches(line, '[.!?:;,]$') AND ({S.matches('line', V.NUMBERED, 'c')} OR
         (regexp_matches(line, '^\p{{Lu}}') AND len(words) BETWEEN 1 AND 8 AND len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= greatest(1, len(words) - 1)))) AS heading,
       ({S.strip('line')} = '' OR {S.matches('line', V.NUMBERED, 'c')} OR (NOT {S.matches('line', V.LIST_ITEM_CI)} AND NOT regexp_matches({S.strip('line')}, '[.!?:;,]$') AND length({S.strip('line')}) <= 120)) AS new_section
FROM w""")
def line_flags(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("id", T.is_unsafe(line).alias("unsafe"), T.is_navigation(line).alias("navigation"), T.is_display_heading(line).alias("heading"), T.looks_like_new_section(line).alias("new_section"))


@query(f"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {S.matches('line', V.UNSAFE_CI, 'im')}) AS n_unsafe, count(*) FILTER (WHERE {S.compact('line')} = '' OR regexp_full_match({S.compact('line')}, '\\p{{Nd}}+')) AS n_navigation FROM d GROUP BY doc_id""")
def document_line_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_unsafe(F.col("line"))).alias("n_unsafe"), F.count_if(T.is_navigation(F.col("line"))).alias("n_navigation"))


@query(rf"""WITH p AS (
  SELECT id, line, list_transform(regexp_split_to_array(line, '(?i)\b(?:and|plus|also|with)\b|[,/;&]'), lambda x: regexp_replace(x, '^[ ,;:.?\t\n]+|[ ,;:.?\t\n]+$', '', 'g')) AS parts FROM {_LINES}
), k AS (SELECT id, line, list_filter(parts, lambda x: len({S.evidence_terms('x')}) >= 2) AS kept FROM p)
SELECT id, array_to_string(CASE WHEN len(kept) < 2 THEN [line] ELSE kept END, ' | ') AS parts FROM k""")
def subquestions(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.array_join(T.subquestions(F.col("line")), " | ").alias("parts"))


@query(rf"""WITH d AS (SELECT doc_id, {S.strip('text')} AS t, {S.compact('text')} AS flat FROM documents),
f AS (SELECT v.id, v.line, d.*, CASE WHEN regexp_matches(flat, '[.!?]\s') THEN regexp_extract(flat, '^(.*?[.!?])\s', 1) ELSE flat END AS first FROM d, {_values(ASKED)})
SELECT doc_id, id, CASE WHEN t = '' THEN t
  WHEN {S.matches('line', V.YES_NO_QUESTION_CI)} THEN (CASE WHEN {S.matches('first', V.NEGATIVE_CI)} THEN 'No. ' ELSE 'Yes. ' END) || first
  WHEN {S.matches('line', V.SHORT_VALUE_QUESTION_CI)} THEN first
  WHEN {S.matches('line', V.COMPARISON_QUESTION_CI)} THEN 'Comparison based on the cited source:' || chr(10) || t
  WHEN t LIKE '- %' OR t LIKE '* %' OR contains(t, chr(10) || '- ') OR ({S.matches('line', V.LIST_QUESTION_CI)} AND contains(t, chr(10))) THEN 'Based on the cited source:' || chr(10) || t
  ELSE 'Based on the cited source, ' || flat END AS answer FROM f""")
def flexible_answer(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "id int, line string")  # the questions above
    asked = F.broadcast(asked.select("id", T.question_class(F.col("line")).alias("asked"), T.matches(F.col("line"), V.LIST_QUESTION_CI).alias("lists")))
    # what a text gives by itself is worked out before it meets the questions
    told = table(spark, sf_dir, "documents").select("doc_id", T.stripped(F.col("text")).alias("text")).select("*", T.compact(F.col("text")).alias("flat")).select("*", T.first_sentence(F.col("flat")).alias("first"))
    told = told.select("*", T.is_negative(F.col("first")).alias("negative"), T.is_listed(F.col("text")).alias("listed"), F.contains("text", F.lit("\n")).alias("lines"))
    answer = T.shaped_answer(*[F.col(c) for c in ("text", "flat", "first", "negative", "listed", "lines", "asked", "lists")])
    return told.crossJoin(asked).select("doc_id", "id", answer.alias("answer"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '.pdf' WHEN doc_id % 3 = 1 THEN source || '.pptx (slide ' || (doc_id % 7 + 1) || ')' ELSE source || '.pdf (page ' || (doc_id % 7 + 1) || ')' END AS citation FROM documents""")
def citations(spark, sf_dir):
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 1, ".pptx").otherwise(".pdf"))
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 + 1).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", T.citation(name, page).alias("citation"))


# ---- evidence and answers


def _hits(spark, sf_dir, k=5):
    index = build_index(chunks(spark, sf_dir))
    best = materialize(R.search(index, questions(spark, sf_dir), k), "ranked")
    return best.join(index.chunks.drop("position"), "chunk_id").join(questions(spark, sf_dir), "question_id")


def _per_question(frame: DataFrame, f, schema: str) -> DataFrame:
    fields = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source", F.lit(None).cast("int").alias("page"), "heading", "text", "position", "score", "confidence")))
    grouped = frame.groupBy("question_id", "question").agg(fields.alias("results"))

    def work(frames):
        for pdf in frames:
            rows = [(int(r.question_id), *x) for r in pdf.itertuples(index=False) for x in f(r.question, [A._hit(h) for h in r.results])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return grouped.mapInPandas(work, schema)


@query()
def segment_scores(spark, sf_dir):
    return _per_question(_hits(spark, sf_dir), lambda q, hits: [(x.chunk_id, x.quote, s) for s, x in E.scored_segments(q, hits)], "question_id long, chunk_id string, quote string, score double")


@query()
def segment_select(spark, sf_dir):
    return _per_question(_hits(spark, sf_dir), lambda q, hits: [(x.chunk_id, x.quote) for x in E.sentences(q, hits)], "question_id long, chunk_id string, quote string")


# (question, source, heading, page, position, score, confidence, text)
SECTIONS = [
    ("What are the features of the tool?", "guide.pdf", None, 1, 0, 1.0, 1.0, "intro\n1. Features of the tool\nlogin\nsearch"),
    ("What are the features of the tool?", "guide.pdf", None, 2, 1, 0.5, 0.4, "export\nsharing\n\nother text"),
    ("What are the features of the tool?", "other.pdf", None, 1, 2, 0.4, 0.3, "Features of the tool\nnone at all"),
    ("Which topics are covered in chemistry?", "course.md", None, None, 3, 0.9, 0.8, "Topics covered in chemistry\n- acids\n- bases\n2. Grading\nexams"),
    ("Explain photosynthesis", "talk.pptx", "Photosynthesis", 4, 5, 0.9, 0.9, "Photosynthesis\nplants use light"),
    ("Compare the advantages", "x.md", None, None, 6, 0.2, 0.1, "nothing here"),
]


@query("""SELECT * FROM (VALUES
(0, '1. Features of the tool' || chr(10) || 'login' || chr(10) || 'search | export' || chr(10) || 'sharing'),
(1, 'Topics covered in chemistry' || chr(10) || '- acids' || chr(10) || '- bases'),
(2, 'Photosynthesis' || chr(10) || 'plants use light'), (3, '')) v(id, quotes)""")
def section_quotes(spark, sf_dir):
    """Slides, sections and their continuation over inline results."""
    asked = list(dict.fromkeys(r[0] for r in SECTIONS))
    rows = [(asked.index(q), q, f"c{i}", *more) for i, (q, *more) in enumerate(SECTIONS)]
    frame = spark.createDataFrame(rows, "id int, question string, chunk_id string, source string, heading string, page int, position int, score double, confidence double, text string")

    def work(key, pdf):
        hits = [E.Hit(r.chunk_id, r.source, r.text, None if pd.isna(r.page) else int(r.page), r.heading, r.position, r.score, r.confidence) for r in pdf.sort_values("position").itertuples()]
        quotes = E.slide(key[1], hits) or E.sections(key[1], hits)
        return pd.DataFrame({"id": [key[0]], "quotes": [" | ".join(q.quote for q in quotes)]})

    return frame.groupBy("id", "question").applyInPandas(work, "id int, quotes string")


@query("""SELECT l_orderkey, 'Order ' || l_orderkey || CASE WHEN count(*) = 1 THEN ': ' ELSE ':' || chr(10) || '- ' END || string_agg('line ' || l_linenumber || ' of part ' || l_partkey, chr(10) || '- ' ORDER BY l_linenumber, l_partkey) AS answer FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY l_orderkey""")
def answer_format(spark, sf_dir):
    """Every order as a heading with its lines, laid out as a list; a single line goes on behind the heading."""
    line = F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" of part "), F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", line.alias("line")).alias("l"))
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l")).alias("lines"))  # of one order
    text = F.concat(F.lit("Order "), F.col("l_orderkey"), F.lit(":\n"), F.array_join(F.col("lines.line"), "\n"))
    return orders.select("l_orderkey", text.alias("text")).select("l_orderkey", A.drop_repeats_column(A.format_quote_column("text")).alias("answer"))


@query()
def document_layout(spark, sf_dir):
    """Every document laid out for reading, repeated sentences dropped."""
    return table(spark, sf_dir, "documents").select("doc_id", A.drop_repeats_column(A.format_quote_column("text")).alias("answer"))


@query()
def document_segments(spark, sf_dir):
    """Answer-sized spans of every document."""

    def work(frames):
        for pdf in frames:
            rows = [(i, k, s) for i, t in zip(pdf["doc_id"], pdf["text"]) for k, s in enumerate(E.segments(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "segment"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(work, "doc_id long, ordinal long, segment string")


@query("SELECT b.item_id, d.doc_id, d.source, instr(d.text, b.text) - 1 AS first_offset FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def evidence_validate(spark, sf_dir):
    """Which documents hold a quote word for word, and where."""
    docs = table(spark, sf_dir, "documents")
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    found = substring_matches(docs.select(F.struct("doc_id", "source").alias("text_id"), "text"), quotes)
    return found.select(F.col("pattern_id").alias("item_id"), "text_id.doc_id", "text_id.source", F.col("offset").cast("long").alias("first_offset"))


@query(f"""WITH RECURSIVE {S.CHUNKS}, {S.FEATURES}, {S.LEXICAL}, hits AS (
  SELECT r.question_id, r.rank, r.chunk_id, length(c.text) AS n, length(c.text) + length(c.source) + 100 AS cost,
         3 * greatest(128, 4096 - 512 - 384 - 2 * len(list_filter(regexp_split_to_array(q.question, '\\s+'), lambda w: w != ''))) AS room
  FROM results r JOIN chunks c USING (chunk_id) JOIN asked q USING (question_id) WHERE r.rank <= 10
), fold AS (
  SELECT question_id, rank, chunk_id, CASE WHEN cost <= room THEN cost ELSE 0 END AS used, true AS kept, cost > room AS ends,
         CASE WHEN cost <= room THEN n ELSE least(n, greatest(1, room - 100)) END AS n_chars
  FROM hits WHERE rank = 1
  UNION ALL
  SELECT h.question_id, h.rank, h.chunk_id, CASE WHEN f.used + h.cost <= h.room THEN f.used + h.cost ELSE f.used END, f.used + h.cost <= h.room, false, h.n
  FROM fold f JOIN hits h ON h.question_id = f.question_id AND h.rank = f.rank + 1 WHERE NOT f.ends
)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS place, chunk_id, n_chars FROM fold WHERE kept""")
def context_fit(spark, sf_dir):
    fitted = fit_context(_hits(spark, sf_dir, 10), 4096, 512)
    return fitted.select("question_id", "place", "chunk_id", "n_chars")


@query(rf"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'line': i, 'txt': {S.strip('x')}}}), recursive := true) FROM documents),
s AS (SELECT doc_id, line, unnest(list_transform(list_filter(regexp_split_to_array(regexp_replace(txt, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x != ''), lambda x, i: {{'i': i, 'sentence': x}}), recursive := true) FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {S.low(S.compact('sentence'))} ORDER BY line, i) AS turn FROM s),
told AS (SELECT doc_id, line, string_agg({S.strip('sentence')}, ' ' ORDER BY i) AS said FROM r WHERE turn = 1 GROUP BY doc_id, line)
SELECT doc_id, md5(coalesce(string_agg(said, chr(10) ORDER BY line), '')) AS digest FROM documents LEFT JOIN told USING (doc_id) GROUP BY doc_id""")
def answer_dedup(spark, sf_dir):
    """Every document as an answer: the first of equal sentences stays."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.drop_repeats_column("text")).alias("digest"))


@query(f"""SELECT item_id, item_id % 4 != 3 AS was_read, CASE WHEN item_id % 4 IN (1, 3) THEN '' ELSE item_id || '=' || {S.strip('text')} || ';next=' || {S.strip('text')} END AS quotes FROM benchmark""")
def model_reply_parse(spark, sf_dir):
    """A reply for every benchmark text, plain, after thoughts in a fence, in prose, or without a reply: its quotes, and whether it could be read."""
    asked = table(spark, sf_dir, "benchmark")
    quote = lambda i, text: F.struct(i.cast("string").alias("chunk_id"), F.concat(F.lit(" "), text).alias("quote"))
    text = F.col("text")
    told = lambda yes, quotes: F.to_json(F.struct(F.lit(yes).alias("answerable"), quotes.alias("evidence")))
    given = told(True, F.array(quote(F.col("item_id"), text), quote(F.lit(""), text), quote(F.lit("next"), text)))
    refused = F.concat(F.lit('<think>hm {"a": 1}</think>```json\n'), told(False, F.array(quote(F.col("item_id"), text))), F.lit("\n```"))
    kind = F.col("item_id") % 4
    reply = F.when(kind == 0, given).when(kind == 1, refused).when(kind == 2, F.concat(F.lit("Sure: "), given, F.lit(" done"))).otherwise(F.concat(F.lit("no reply: "), F.regexp_replace(text, "[{}]", "")))

    def work(frames):
        for pdf in frames:
            parsed = [E.parse_reply(x) for x in pdf["reply"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "quotes": [";".join(f"{q.chunk_id}={q.quote.strip()}" for q in quotes) for quotes, _ in parsed], "was_read": [read for _, read in parsed]})

    return asked.select("item_id", reply.alias("reply")).mapInPandas(work, "item_id long, quotes string, was_read boolean")


@query()
def ask_batch(spark, sf_dir):
    """Retrieval, gate, neighbours, evidence, validation, formatting and citations for every question."""
    index = build_index(chunks(spark, sf_dir))
    return A.answer_questions(index, questions(spark, sf_dir), neighbours=1, exact=False).select("question_id", "text", F.array_join("sources", "; ").alias("sources"), F.array_join("diagnostics", "; ").alias("diagnostics"), F.size("results").alias("n_results"))


# ---- reports


_DIFF = """SELECT coalesce('d/' || doc_id, 'd/' || vec_id) AS source, CASE WHEN doc_id IS NULL THEN 'removed' WHEN vec_id IS NOT NULL AND n_chars % 2 = label % 2 THEN 'reused' ELSE 'changed' END AS state
FROM documents FULL JOIN (SELECT vec_id + 100 AS vec_id, label FROM embeddings) ON doc_id = vec_id"""


@query(_DIFF)
def index_diff(spark, sf_dir):
    """Documents as the files of now, vectors (their ids moved on by 100) as the files of then."""

    def signatures(frame, key, stamp):
        return frame.select(F.concat(F.lit("d/"), key.cast("string")).alias("source"), (stamp % 2).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"))

    now = signatures(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("n_chars"))
    return P.index_diff(now, signatures(table(spark, sf_dir, "embeddings"), F.col("vec_id") + 100, F.col("label")))


@query(f"SELECT count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'reused') AS reused, count(*) FILTER (WHERE state = 'removed') AS removed FROM ({_DIFF})")
def index_diff_counts(spark, sf_dir):
    return P.diff_counts(index_diff(spark, sf_dir))


@query("SELECT source, count(*) AS n_chunks, count(DISTINCT nullif(doc_id % 4, 0)) AS n_pages FROM documents GROUP BY source")
def source_chunk_counts(spark, sf_dir):
    return P.source_counts(table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 4).alias("page")))


@query("""SELECT '.' || lang AS suffix, count(DISTINCT source) AS n_files, count(*) AS n_chunks FROM documents GROUP BY lang""")
def index_summary(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.concat_ws(".", "source", "lang").alias("source"), F.lit(0).alias("page"))
    return P.index_summary(named)


_ASKED_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(answer, '{V.TOKEN}'), lambda x: {S.low('x')}), lambda x: length(x) > 3))"


def _told_terms(body: str) -> str:
    return f"list_transform(regexp_extract_all({body}, '{V.TOKEN}'), lambda x: {S.low('x')})"


@query(f"""WITH {S.CHUNKS}, {S.FEATURES}, {S.HYBRID},
g AS (SELECT question_id, question AS answer, string_agg(c.text, chr(10) ORDER BY rank) AS body, max(confidence) AS best
  FROM results JOIN chunks c USING (chunk_id) JOIN asked USING (question_id) WHERE rank <= 10 GROUP BY ALL),
t AS (SELECT *, {_ASKED_TERMS} AS wanted, {_told_terms('body')} AS told FROM g),
o AS (SELECT *, CASE WHEN len(wanted) = 0 THEN 0.0 ELSE len(list_intersect(wanted, told)) / len(wanted) END AS overlap FROM t)
SELECT question_id, round(overlap, 6) AS overlap, CASE WHEN contains(body, answer) OR (best >= 0.55 AND overlap >= 0.75) THEN 'High' WHEN best >= 0.30 AND overlap >= 0.50 THEN 'Medium' ELSE 'Low' END AS level FROM o""")
def confidence_level(spark, sf_dir):
    """How well ten results carry the question's own text as an answer."""
    best = materialize(_hybrid(spark, sf_dir).select("question_id", "rank", "chunk_id", "confidence"), "ranked")
    hits = best.join(questions(spark, sf_dir).withColumnRenamed("question", "answer"), "question_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return P.hits_report(hits).select("question_id", six("overlap"), "level")


@query(f"""WITH {S.CHUNKS}, a AS (SELECT b.question_id, q.question AS answer, c.source, b.chunk_id, c.text, b.lexical FROM bm25 b JOIN asked q USING (question_id) JOIN chunks c USING (chunk_id)),
t AS (SELECT *, {_ASKED_TERMS} AS wanted, {_told_terms('text')} AS told FROM a),
m AS (SELECT *, round((CASE WHEN contains(text, answer) THEN 5 ELSE 0 END) + len(list_intersect(wanted, told)) + lexical, 9) AS merit FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY merit DESC, chunk_id) AS place FROM m)
SELECT question_id, source, chunk_id, place, round(merit, 6) AS merit FROM r WHERE place <= 8""")
def source_context_top8(spark, sf_dir):
    answers = questions(spark, sf_dir).withColumn("answer", F.col("question"))
    return R.source_context(build_index(chunks(spark, sf_dir)), answers).select("question_id", "source", "chunk_id", F.col("place").cast("long").alias("place"), six("merit"))


@query(f"SELECT doc_id, CASE WHEN length({S.compact('text')}) > 220 THEN rtrim(substring({S.compact('text')}, 1, 217)) || '...' ELSE {S.compact('text')} END AS snippet FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT count(*) AS n_files, sum(n_chars)::BIGINT AS size FROM documents")
def selection_size(spark, sf_dir):
    return P.selection_size(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")))


# ---- store


@query("SELECT DISTINCT sha256(concat('m', chr(0), text)) AS text_hash FROM documents WHERE sha256(concat('m', chr(0), text)) NOT IN (SELECT sha256(concat('m', chr(0), text)) FROM documents JOIN labels USING (doc_id))")
def cache_misses(spark, sf_dir):
    """Distinct texts without a cached vector, if those of labelled documents are cached."""
    docs = table(spark, sf_dir, "documents").select(ST.text_hash("m", F.col("text")).alias("text_hash"), "doc_id", "text")
    cached = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("text_hash")
    return ST.missing(docs.select("text_hash", "text"), cached).select("text_hash")


@query("SELECT source || '/' || doc_id AS source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune_stale(spark, sf_dir):
    """Stored documents that are still active, if the labelled ones are."""
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source")
    docs = table(spark, sf_dir, "documents")
    return ST.prune(docs.select(name, "n_chars"), docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(name))


@query("SELECT count(*) AS n_vectors, min(len(embedding))::INTEGER AS least_dimension, max(len(embedding))::INTEGER AS most_dimension, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 OR len(embedding) = 0) AS n_invalid FROM embeddings")
def embedding_validate(spark, sf_dir):
    return ST.vector_check(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector")))
