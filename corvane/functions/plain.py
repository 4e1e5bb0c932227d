"""The term functions on Python strings, for code that works through one question's results in an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

from . import vocabulary as V

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_ATTRIBUTE = re.compile(V.ATTRIBUTE_QUESTION_CI, re.I)
_DEFINITION = re.compile(V.DEFINITION_QUESTION_CI, re.I)
_UNSAFE = re.compile(V.UNSAFE_CI, re.I | re.M)
_NUMBERED = re.compile(V.NUMBERED)
_LIST_ITEM = re.compile(V.LIST_ITEM_CI, re.I)
_LEADER = re.compile(V.PAGE_LEADER)
_CUT = re.compile(V.SUBQUESTION_CUT_CI, re.I)
_LETTERED_NUMBER = re.compile(r"^\s*(?:[A-Z]\.)?\d+(?:\.\d+)*[.)]?\s+\S")
CLOSERS = tuple(".!?:;,")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def canonical(term: str) -> str:
    if len(term) > 4:
        if term.endswith("ies"):
            term = f"{term[:-3]}y"
        elif term[-1] == "s" != term[-2]:
            term = term[:-1]
    return V.SYNONYMS.get(term, term)


def content_terms(text: str) -> list[str]:
    return [canonical(t) for t in tokens(text) if t not in V.STOPWORDS]


def term_set(text: str) -> frozenset[str]:
    return frozenset(content_terms(text))


LIST_TERMS = frozenset(map(canonical, V.LIST_TERMS))


def is_attribute_question(question: str) -> bool:
    return bool(_ATTRIBUTE.search(question.strip()))


def is_definition_question(question: str) -> bool:
    return bool(_DEFINITION.search(question.strip()))


def evidence_terms(question: str) -> frozenset[str]:
    dropped = V.META_TERMS | V.ATTRIBUTE_TERMS if is_attribute_question(question) else V.META_TERMS
    return term_set(question) - dropped


def flat(text: str) -> str:
    return " ".join(text.split())


def padded(text: str) -> str:
    return f" {flat(text).casefold()} "


def holds_any(text: str, phrases: tuple[str, ...]) -> bool:
    spaced = padded(text)
    return any(p in spaced for p in phrases)


def is_unsafe(text: str) -> bool:
    return bool(_UNSAFE.search(text))


def is_numbered(line: str) -> bool:
    return bool(_NUMBERED.match(line))


def is_list_item(line: str) -> bool:
    return bool(_LIST_ITEM.match(line))


def is_navigation(text: str) -> bool:
    line = flat(text)
    return not line or line.isdigit() or bool(_LEADER.search(line))


def capitals(words: list[str]) -> int:
    return sum(w[:1].isupper() for w in words)


def is_standalone_heading(segment: str) -> bool:
    lines = [x for x in map(str.strip, segment.splitlines()) if x]
    if len(lines) != 1 or len(lines[0]) > 140 or lines[0].endswith(CLOSERS) or holds_any(lines[0], V.DEFINITION_PHRASES):
        return False
    words = re.findall(r"[^\W\d_]+", lines[0])
    return bool(_LETTERED_NUMBER.match(lines[0])) or (1 <= len(words) <= 12 and capitals(words) >= max(1, len(words) - 2))


def is_display_heading(line: str) -> bool:
    if len(line) > 90 or line.endswith(CLOSERS):
        return False
    words = line.split()
    return is_numbered(line) or (line[:1].isupper() and 1 <= len(words) <= 8 and capitals(words) >= max(1, len(words) - 1))


def looks_like_new_section(line: str) -> bool:
    line = line.strip()
    if not line or is_numbered(line):
        return True
    return not is_list_item(line) and not line.endswith(CLOSERS) and len(line) <= 120


def subquestions(question: str) -> list[str]:
    told = [p for p in (part.strip(" ,;:.?\t\n") for part in _CUT.split(question)) if len(evidence_terms(p)) >= 2]
    return told if len(told) > 1 else [question]
