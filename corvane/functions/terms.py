"""Tokens and terms as Column expressions.

``exact=True`` normalises with an Arrow UDF (NFKC, then case folding); without it a built-in expression is used, equal for text
that is in NFKC already and holds no special case foldings but ß.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _any_of(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def normal_form(text: Column, exact: bool = False) -> Column:
    return _fold(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, exact: bool = False) -> Column:
    """Letter runs and digit runs of the normal form."""
    return F.regexp_extract_all(normal_form(F.coalesce(text, F.lit("")), exact), F.lit(V.TOKEN), 0)


def _singular(term: Column) -> Column:
    long, last = F.length(term) > 4, F.length(term)
    stem = F.when(long & term.endswith("ies"), F.concat(F.substring(term, F.lit(1), last - 3), F.lit("y")))
    return stem.when(long & term.endswith("s") & ~term.endswith("ss"), F.substring(term, F.lit(1), last - 1)).otherwise(term)


def _synonym(term: Column) -> Column:
    (first, other), *pairs = V.SYNONYMS.items()
    told = F.when(term == first, other)
    for word, other in pairs:
        told = told.when(term == word, other)
    return told.otherwise(term)


def canonical(term: Column) -> Column:
    """Singular by two suffix rules, then synonyms."""
    return _synonym(_singular(term))


def is_stopword(token: Column) -> Column:
    return token.isin(*sorted(V.STOPWORDS))


def content_of(token_array: Column) -> Column:
    """Two transforms, so that a stem is worked out once."""
    kept = F.filter(token_array, lambda t: ~is_stopword(t))
    return F.transform(F.transform(kept, _singular), _synonym)


def content_terms(text: Column, exact: bool = False) -> Column:
    """Canonical terms with repeats, less stopwords."""
    return content_of(tokens(text, exact))


def term_set(text: Column, exact: bool = False) -> Column:
    return F.array_distinct(content_terms(text, exact))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def is_attribute_question(question: Column) -> Column:
    return matches(question, V.ATTRIBUTE_QUESTION_CI)


def is_definition_question(question: Column) -> Column:
    return matches(question, V.DEFINITION_QUESTION_CI)


def question_class(question: Column) -> Column:
    """The first class that fits: yes_no, short_value, comparison, list, other."""
    return (
        F.when(matches(question, V.YES_NO_QUESTION_CI), "yes_no")
        .when(matches(question, V.SHORT_VALUE_QUESTION_CI), "short_value")
        .when(matches(question, V.COMPARISON_QUESTION_CI), "comparison")
        .when(matches(question, V.LIST_QUESTION_CI), "list")
        .otherwise("other")
    )


def evidence_terms(question: Column, exact: bool = False) -> Column:
    """Distinct terms of a question that evidence must hold."""
    plain = F.array_except(term_set(question, exact), _any_of(V.META_TERMS))
    return F.when(is_attribute_question(question), F.array_except(plain, _any_of(V.ATTRIBUTE_TERMS))).otherwise(plain)


def rerank_terms(question: Column, exact: bool = False) -> Column:
    """Distinct terms of a question that ranking uses."""
    plain = term_set(question, exact)
    return F.when(is_attribute_question(question), F.array_except(plain, _any_of(V.ATTRIBUTE_TERMS))).otherwise(plain)


def minimum_confidence(question: Column, exact: bool = False) -> Column:
    return F.least(F.lit(0.45), 0.25 + 0.15 / F.sqrt(F.greatest(F.lit(1), F.size(term_set(question, exact)))))


def is_unsafe(text: Column) -> Column:
    """Text that gives orders to a model instead of facts."""
    return text.rlike(f"(?im){V.UNSAFE_CI}")


def is_navigation(text: Column) -> Column:
    """Blank, a page number, or a line of a table of contents."""
    flat = compact(text)
    return (flat == "") | flat.rlike(V.PAGE_LEADER) | flat.rlike(r"^\p{Nd}+$")


def is_display_heading(line: Column) -> Column:
    words = F.filter(F.split(compact(line), " "), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    short = (F.length(line) <= 90) & ~line.rlike(r"[.!?:;,]$")
    titled = line.rlike(r"^\p{Lu}") & F.size(words).between(1, 8) & (capital >= F.greatest(F.lit(1), F.size(words) - 1))
    return short & (line.rlike(V.NUMBERED) | titled)


def looks_like_new_section(line: Column) -> Column:
    flat = stripped(line)
    return F.when((flat == "") | flat.rlike(V.NUMBERED), True).when(matches(flat, V.LIST_ITEM_CI), False).when(flat.rlike(r"[.!?:;,]$"), False).otherwise(F.length(flat) <= 120)


def is_standalone_heading(segment: Column) -> Column:
    lines = F.filter(F.transform(F.split(segment, "\n"), stripped), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    padded = F.concat(F.lit(" "), normal_form(compact(line)), F.lit(" "))
    words = F.regexp_extract_all(line, F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0)
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    titled = F.size(words).between(1, 12) & (capital >= F.greatest(F.lit(1), F.size(words) - 2))
    defines = F.exists(_any_of(V.DEFINITION_PHRASES), lambda p: F.contains(padded, p))
    open_end = (F.length(line) <= 140) & ~line.rlike(r"[.!?:;,]$")
    return F.coalesce((F.size(lines) == 1) & open_end & ~defines & (line.rlike(r"^\s*(?:[A-Z]\.)?\d+(?:\.\d+)*[.)]?\s+\S") | titled), F.lit(False))


def subquestions(question: Column) -> Column:
    """The parts of a question for several topics, else the question itself."""
    parts = F.transform(F.split(question, f"(?i){V.SUBQUESTION_CUT_CI}"), lambda p: F.regexp_replace(p, r"^[ ,;:.?\t\n]+|[ ,;:.?\t\n]+$", ""))
    told = F.filter(parts, lambda p: F.size(evidence_terms(p)) >= 2)
    whole = F.array(question)
    several = F.get(F.transform(F.array(told), lambda t: F.when(F.size(t) < 2, whole).otherwise(t)), F.lit(0))  # an array's lambda: worked out once
    return F.when(question.rlike(f"(?i){V.SUBQUESTION_CUT_CI}"), several).otherwise(whole)  # a null question is no match


def citation(source: Column, page: Column) -> Column:
    place = F.when(F.lower(source).rlike(r"\.pptx?$"), "slide").otherwise("page")
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(source, F.lit(" ("), place, F.lit(" "), page.cast("string"), F.lit(")"))).otherwise(source)


def infer_heading(text: Column) -> Column:
    """The first line of 1 to 120 characters once leading # are gone."""
    lines = F.transform(F.split(text, r"\R"), lambda x: stripped(F.regexp_replace(stripped(x), "^#+", "")))
    return F.get(F.filter(lines, lambda x: F.length(x).between(1, 120)), F.lit(0))


def flexible_answer(question: Column, grounded: Column) -> Column:
    """A grounded answer put in the form that the question asks for; no fact is added."""
    text = stripped(grounded)
    flat = compact(text)
    first = first_sentence(flat)
    return shaped_answer(text, flat, first, is_negative(first), is_listed(text), F.contains(text, F.lit("\n")), question_class(question), matches(question, V.LIST_QUESTION_CI))


def first_sentence(flat: Column) -> Column:
    return F.get(F.split(flat, r"(?<=[.!?])\s+", 2), F.lit(0))


def is_negative(sentence: Column) -> Column:
    return matches(sentence, V.NEGATIVE_CI)


def is_listed(text: Column) -> Column:
    return text.startswith("- ") | text.startswith("* ") | F.contains(text, F.lit("\n- "))


def shaped_answer(text: Column, flat: Column, first: Column, negative: Column, listed: Column, lines: Column, asked: Column, lists: Column) -> Column:
    """``flexible_answer`` from what its text and its question (``asked``: its class, ``lists``: whether it asks for a list) give by themselves."""
    return (
        F.when((text == "") | text.startswith(V.NO_ANSWER), text)
        .when(asked == "yes_no", F.concat(F.when(negative, "No").otherwise("Yes"), F.lit(". "), first))
        .when(asked == "short_value", first)
        .when(asked == "comparison", F.concat(F.lit("Comparison based on the cited source:\n"), text))
        .when(listed | (lists & lines), F.concat(F.lit("Based on the cited source:\n"), text))
        .otherwise(F.concat(F.lit("Based on the cited source, "), flat))
    )


def snippet(text: Column, width: int = 220) -> Column:
    flat = compact(text)
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 3)), F.lit("..."))).otherwise(flat)


def confidence_level(n_sources: Column, exact_quote: Column, best: Column, overlap: Column) -> Column:
    return F.when(n_sources == 0, "Low").when(exact_quote | ((best >= 0.55) & (overlap >= 0.75)), "High").when((best >= 0.30) & (overlap >= 0.50), "Medium").otherwise("Low")
