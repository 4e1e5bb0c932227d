"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans are the leftmost non-overlapping matches of each kind that pass its check. They seed the bootstrapping:

1. Every identifier-like string of the corpus (base spans, and other tokens with a digit or @) is an occurrence with its
   contexts: the word before, the two words before, the words on both sides, with digits masked.
2. Contexts are patterns and occurrences' strings are instances of a bipartite graph, kept as a table of distinct edges.
3. Rounds: a pattern's confidence for a kind is the summed score of its instances over their number plus a prior, given
   enough distinct known instances; an instance's score is the noisy-or of its confident patterns, lessened by ``UNLIKE`` if its
   shape was never seen with that kind. Seeds score 1 for their own kind and 0 for others, always.
4. Occurrences that are no base span and reach ``ACCEPT`` become added spans, unless they overlap an earlier span.

Each round is two aggregations and two joins between stored tables; only confident patterns enter the second join.

Defined results: null text is empty; very long texts are read whole, and identifiers of any length are occurrences (over ``NAME`` characters they
stand in the graph under their beginning and a digest, so that different ones never merge); contexts are words within 120 characters before and
60 after, cut at 40; of kinds with equal scores the last in alphabetical order is given; repeated rows get equal spans; a table without seeds adds
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, read_table
from .workers import fresh

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENT, ACCEPT, SUPPORT, PRIOR, UNLIKE = 0.8, 0.85, 5, 1.0, 0.95

AT_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
AT_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GROUPS = re.compile(r"(?<![^\x20\x09-\x0D])\(?[0-9][0-9()\x20.-]{5,28}[0-9](?![^\x20\x09-\x0D.,;:!?])")
TOKEN = re.compile(GROUPS.pattern + r"|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
TRIM = ".,;:!?\"'()[]{}<>|"

NAME = 80

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Every @ in turn with the run of local characters before it, so that no run is scanned twice."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and AT_LEFT.match(text[start - 1]):
            start -= 1
        if start < at and (m := AT_RIGHT.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    found = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def describe(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def shape(string: str) -> str:
    """Digits to 9, letters to a, runs to one."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", string)))


def _masked(word: str) -> str:
    return re.sub(r"\d", "9", word.lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of an occurrence; words are cut at 40 characters."""
    left = [_masked(w[-40:]) for w in text[max(0, start - 120) : start].split()[-2:]]
    right = [_masked(w[:40]) for w in text[end : end + 60].split()[:1]]
    found = []
    if left:
        found.append(f"{left[-1]} _")
        if right:
            found.append(f"{left[-1]} _ {right[0]}")
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} _")
    return found


def name_of(string: str) -> str:
    """What an occurrence is called in the graph."""
    return string if len(string) <= NAME else f"{string[:NAME]}\u2026{hashlib.sha256(string.encode()).hexdigest()}"


def occurrences(text: str) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, string, kind or None, patterns) of base spans and of other identifier-like tokens."""
    spans = base_spans(text)
    known = sorted((a, b, kind) for kind in KINDS for a, b in spans[kind])
    found = [(a, b, name_of(text[a:b]), kind, contexts(text, a, b)) for a, b, kind in known]
    i = 0
    for m in TOKEN.finditer(text) if "@" in text or DIGIT.search(text) else ():
        a, b = m.span()
        while a < b and text[a] in TRIM and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while a < b and text[b - 1] in TRIM:
            b -= 1
        while i < len(known) and known[i][1] <= a:
            i += 1
        if b - a >= 4 and not any(y > a for _, y, _ in itertools.takewhile(lambda k: k[0] < b, itertools.islice(known, i, None))):
            found.append((a, b, name_of(text[a:b]), None, contexts(text, a, b)))
    return found


OCCURRENCE = "array<struct<start:int,end:int,string:string,kind:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, found)``: the occurrences of every text, one row a row of ``docs``."""
    fields = [("start", pa.int32()), ("end", pa.int32()), ("string", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        names = [f for f, _ in fields]
        for batch in batches:
            found = [[dict(zip(names, o)) for o in occurrences(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.struct(fields)))], ["doc_id", "text_hash", "found"])

    known = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) text_hash", "text")
    return known.mapInArrow(run, f"doc_id long, text_hash long, found {OCCURRENCE}")


def _shape(column: str):
    masked = F.regexp_replace(F.regexp_replace(column, "[0-9]", "9"), r"\p{L}", "a")
    return F.regexp_replace(masked, r"(.)\1+", "$1")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(string, kind, score)`` of strings that confident patterns mark and that are no seed."""
    each = scanned.select(F.explode("found").alias("o")).select("o.string", "o.kind", F.explode("o.patterns").alias("pattern"))
    edges = materialize(each.groupBy("string", "pattern").agg(F.max("kind").alias("kind")), "edges")
    seeds = materialize(edges.where("kind IS NOT NULL").select("string", "kind").distinct(), "seeds")
    shapes = materialize(seeds.select("kind", _shape("string").alias("shape")).distinct(), "shapes")
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {SUPPORT}")
    scores = seeds.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        positive = edges.select("string", "pattern").join(scores, "string").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support"))
        confident = positive.where(f"support >= {SUPPORT}").join(total, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + PRIOR)).alias("confidence"))
        confident = materialize(confident.where(f"confidence >= {CONFIDENT}"), "patterns")
        marked = edges.where("kind IS NULL").select("string", "pattern").join(confident, "pattern")
        score = 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        marked = marked.groupBy("string", "kind").agg(score.alias("score")).withColumn("shape", _shape("string"))
        alike = shapes.withColumn("alike", F.lit(1.0))
        marked = marked.join(alike, ["kind", "shape"], "left").select("string", "kind", (F.col("score") * F.coalesce("alike", F.lit(UNLIKE))).alias("score"))
        best = marked.groupBy("string").agg(F.max(F.struct("score", "kind")).alias("b")).select("string", "b.kind", "b.score")
        found = materialize(best.join(seeds.select("string"), "string", "left_anti"), "found")
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(found.where(f"score >= {CONFIDENT}"))
    return found.where(f"score >= {ACCEPT}")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, base, added)``: arrays of (kind, start, end), ends exclusive, in code points."""
    scanned = materialize(scan(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id()), "occurrences")
    accepted = bootstrap(scanned)
    open_ones = scanned.select("row", F.explode("found").alias("o")).where("o.kind IS NULL").select("row", "o.string", "o.start", "o.end")
    span = F.struct("kind", "start", "end")
    added = materialize(open_ones.join(accepted, "string").groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("added")), "added")
    base = F.transform(F.filter("found", lambda o: o["kind"].isNotNull()), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(added, "row", "left").select("doc_id", "text_hash", base.alias("base"), F.coalesce("added", none).alias("added"))


def _listing(spans):
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans merge, the first one's kind names them."""
    out, free, end_of_last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end_of_last:
            free = end_of_last = max(end_of_last, b)
            continue
        out += [text[free:a], f"[{kind.upper()}]"]
        free = end_of_last = b
    return "".join(out) + text[free:]
