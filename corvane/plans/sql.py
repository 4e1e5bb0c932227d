"""SQL fragments (DuckDB) for the oracle queries."""

from ..functions import vocabulary as V


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def low(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tok(x: str) -> str:
    return rf"regexp_extract_all({low(x)}, '{V.TOKEN}')"


def content_of(tokens: str) -> str:
    stem = "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"
    synonym = "CASE u " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.SYNONYMS.items()) + " ELSE u END"
    kept = f"list_filter({tokens}, lambda t: t NOT IN ({_list(V.STOPWORDS)}))"
    return f"list_transform(list_transform({kept}, lambda t: {stem}), lambda u: {synonym})"


def content(x: str) -> str:
    return content_of(tok(x))


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def compact(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _boundaries(pattern: str) -> str:
    """Word boundaries that know letters beyond ASCII, as Java's and Python's do and RE2's do not: at the start of a pattern or behind a word."""
    word = r"[^\p{L}\p{N}_]"
    lead = pattern.startswith(r"\b")
    return (f"(?:^|{word})" if lead else "") + pattern[2 * lead :].replace(r"\b", f"(?:$|{word})")


def matches(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, '{_boundaries(pattern).replace(chr(39), chr(39) * 2)}', '{flags}')"


def attribute(x: str) -> str:
    return matches(x, V.ATTRIBUTE_QUESTION_CI)


def without(terms: str, words) -> str:
    return f"list_filter({terms}, lambda t: t NOT IN ({_list(words)}))"


def rerank_terms(x: str) -> str:
    terms = f"list_distinct({content(x)})"
    return f"CASE WHEN {attribute(x)} THEN {without(terms, V.ATTRIBUTE_TERMS)} ELSE {terms} END"


def evidence_terms(x: str) -> str:
    plain = without(f"list_distinct({content(x)})", V.META_TERMS)
    return f"CASE WHEN {attribute(x)} THEN {without(plain, V.ATTRIBUTE_TERMS)} ELSE {plain} END"


def heading(x: str) -> str:
    lines = rf"list_transform(string_split({x}, chr(10)), lambda l: {strip(rf'regexp_replace({strip("l")}, {chr(39)}^#+{chr(39)}, {chr(39)}{chr(39)})')})"
    return f"list_filter({lines}, lambda l: length(l) BETWEEN 1 AND 120)[1]"


CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS position, source, text, {heading('text')} AS heading,
         {content('text')} AS terms, array_to_string({tok('text')}, ' ') AS words FROM documents
), stats AS (
  SELECT count(*) AS n_chunks, CASE WHEN sum(len(terms)) = 0 THEN 1.0 ELSE avg(len(terms)) END AS average_length FROM chunks
), bags AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM chunks) GROUP BY ALL
), dfs AS (
  SELECT term, count(*) AS df FROM bags GROUP BY term
), asked AS (
  SELECT item_id AS question_id, text AS question, {content('text')} AS terms, {rerank_terms('text')} AS ranked,
         array_to_string({tok('text')}, ' ') AS words FROM benchmark
), qterms AS (
  SELECT question_id, term, count(*) AS qf FROM (SELECT question_id, unnest(terms) AS term FROM asked) GROUP BY ALL
), bm25 AS (
  SELECT q.question_id, b.chunk_id,
         round(sum(ln(1 + (s.n_chunks - f.df + 0.5) / (f.df + 0.5)) * b.tf * 2.2
             / (b.tf + 1.2 * (0.25 + 0.75 * len(c.terms) / s.average_length)) * q.qf), 9) AS lexical
  FROM qterms q JOIN bags b USING (term) JOIN dfs f USING (term) JOIN chunks c USING (chunk_id) CROSS JOIN stats s
  GROUP BY ALL
)"""

FEATURES = f"""pairs AS (
  SELECT a.question_id, c.chunk_id, c.position, c.source, a.ranked AS q,
         list_distinct({content("concat_ws(' ', c.source, coalesce(c.heading, ''))")}) AS meta,
         list_distinct({content("coalesce(c.heading, '')")}) AS head, c.terms AS body,
         CASE WHEN a.words != '' AND contains(c.words, a.words) THEN 0.15 ELSE 0.0 END AS phrase,
         coalesce(b.lexical, 0.0) AS lexical
  FROM asked a CROSS JOIN chunks c LEFT JOIN bm25 b ON b.question_id = a.question_id AND b.chunk_id = c.chunk_id
), counted AS (
  SELECT *, len(list_intersect(q, meta)) AS n_scope, len(list_intersect(q, head)) AS n_head, len(list_intersect(q, body)) AS n_body,
         len(list_filter(list_intersect(q, body), lambda t: NOT list_contains(meta, t))) AS n_own, len(q) AS n
  FROM pairs
), parts AS (
  SELECT *, CASE WHEN n - n_scope > 0 THEN n_own / (n - n_scope) ELSE n_body / n END AS coverage, n_scope / n AS mc, n_head / n AS hc
  FROM counted
), features AS (
  SELECT question_id, chunk_id, position, source, lexical,
         CASE WHEN n = 0 THEN 0.0 ELSE coverage + mc * 0.15 + hc * 0.6 + phrase END AS rerank,
         CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, least(1.0, coverage + mc * 0.35 + phrase) + hc * 0.5) END AS lexical_confidence
  FROM parts
)"""

HYBRID = """sem AS (
  SELECT item_id AS question_id, v.vec_id AS chunk_id,
         round(coalesce(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
           / nullif(sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0.0), 9) AS semantic
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings v
), signals AS (
  SELECT f.*, coalesce(s.semantic, 0.0) AS semantic FROM features f LEFT JOIN sem s USING (question_id, chunk_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, position) AS lr,
         row_number() OVER (PARTITION BY question_id ORDER BY semantic DESC, position) AS sr
  FROM signals WHERE lexical > 0 OR semantic > 0 OR rerank > 0
), scored AS (
  SELECT *, CASE WHEN lexical > 0 THEN 1.0 / (60 + lr) ELSE 0 END + CASE WHEN semantic > 0 THEN 1.0 / (60 + sr) ELSE 0 END AS fused
  FROM ranked
), totals AS (
  SELECT *, round(fused + rerank * 0.1 + greatest(semantic, 0.0) * 0.05, 9) AS score, greatest(lexical_confidence, greatest(semantic, 0.0) * 0.75) AS confidence
  FROM scored
), results AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position) AS rank FROM totals
)"""

# the same without vectors
LEXICAL = "sem AS (SELECT 0 AS question_id, 0 AS chunk_id, 0.0 AS semantic WHERE false), signals AS" + HYBRID.partition("), signals AS")[2]
