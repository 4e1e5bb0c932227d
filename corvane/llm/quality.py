"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when one measure exceeds a cutoff. A policy is a cutoff for every rule, or none; ``LADDER`` lists
policies from the most lenient to the strictest, each adding one rule or lowering one cutoff, so that they reject more and more. On labelled rows
(quality 1 is good) every stratum and step is a hypothesis "this policy rejects more than ``risk`` of the stratum's good documents", refused
when the exact binomial probability of so few rejected good documents under that rate is at most its level. A stratum's hypotheses are
tested in the order of the ladder and testing ends with the first that stands: in a fixed sequence every test may use the whole level, so
the grid costs nothing. The strata share ``delta`` equally (Bonferroni). The last policy refused is the stratum's: with confidence 1 - ``delta``
no stratum's rules together reject more than ``risk`` of its good documents. ``least_labels`` tells how many good labels without a
rejection turn the first rule on: 108 at four strata.

Ladder and grid are fixed beforehand and no cutoff is fitted to the rows that certify it, so all labelled rows are holdout.

Defined results: null text has no words; empty text fails the base rules; very long texts are read whole; null strata form a stratum of their own; a
stratum without certified rules keeps everything that the base rules keep; a measure equal to its cutoff passes;
labels with a null ``quality`` or ``doc_id`` are not used; of several labels of one id every one counts; rows that repeat count each; without any
labels no rule is active; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, read_table

MEASURES_SCHEMA = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
#: rule -> its measure, a share of the words or characters in hundredths
RULES = {
    "symbols": "100.0 * n_symbols / greatest(n_words, 1)",
    "dup_lines": "100.0 * n_dup_lines / greatest(n_words, 1)",
    "repeat_words": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "long_words": "1.0 * word_chars / greatest(n_words, 1)",
}
GRID = {
    "symbols": (2, 5, 10, 20, 50, 100, 200),
    "dup_lines": (1, 2, 3, 5, 8, 12),
    "repeat_words": (5, 10, 15, 20, 30, 40),
    "long_words": (8, 10, 12, 15, 20, 40),
}
RISK, DELTA = 0.04, 0.05


def ladder(grid: dict[str, tuple[int, ...]]) -> list[dict[str, int]]:
    """Policies from lenient to strict: the rules take turns, each going from its highest cutoff to its lowest."""
    policy: dict[str, int] = {}
    steps = []
    for level in range(max(map(len, grid.values()))):
        for rule, cuts in grid.items():
            if level < len(cuts):
                policy = policy | {rule: sorted(cuts, reverse=True)[level]}
                steps.append(policy)
    return steps


LADDER = ladder(GRID)


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Bytes split at exactly [\\x20\\x09-\\x0D]."""
    words = text.encode("utf-8", "surrogatepass").split()
    joined = b"".join(words).decode("utf-8", "surrogatepass")
    n_symbols = len(text) - len(text.translate(SYMBOLS)) if any(c in text for c in "#*$%&|<>") else 0
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
    repeat, windows = 0, list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        reach = 0  # words before this one are counted already
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeat += i + 3 - max(reach, i)
                reach = i + 3
    return len(words), len(joined), n_symbols, dup, repeat


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 5)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *columns], ["doc_id", "stratum", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", f"cast(`{stratum}` as string) stratum", "text").mapInArrow(scan, MEASURES_SCHEMA)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exact: terms are summed downwards from k until they no longer count."""
    if k >= n:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, ratio, i = 1.0, 1.0, k
    while i > 0 and (ratio > 1e-17 * total):
        ratio *= i * (1 - p) / ((n - i + 1) * p)
        total += ratio
        i -= 1
    return min(0.0, term + math.log(total))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate, k of n seen, at confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if log_binomial_cdf(k, n, mid) > math.log(delta):
            low = mid
        else:
            high = mid
    return high


def least_labels(risk: float, level: float) -> int:
    """The fewest good labels that certify a policy which rejects none of them."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def _rejects(policy: dict[str, int]) -> str:
    return " OR ".join(f"{RULES[rule]} > {cut}" for rule, cut in policy.items())


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, n_good, steps, bound, <rule>_cutoff ...)``: one row a stratum with labels; ``steps``: certified policies; ``bound``: the exact upper
    bound of the share of good documents that the chosen one rejects; null cutoff: rule off."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"))
    held = measured.join(good, measured["doc_id"] == good["label_id"])
    counts = [F.sum(F.expr(f"cast({_rejects(policy)} as long)")).alias(f"step_{i}") for i, policy in enumerate(LADDER)]
    table = materialize(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *counts), "rejected")
    level = delta / max(1, table.count())
    schema = "stratum string, n_good long, steps int, bound double, " + ", ".join(f"{rule}_cutoff double" for rule in RULES)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                n, steps, bound, policy = int(r.n_good), 0, None, {}
                for i, tried in enumerate(LADDER):
                    rejected = int(getattr(r, f"step_{i}"))
                    if log_binomial_cdf(rejected, n, risk) > math.log(level):
                        break
                    steps, bound, policy = i + 1, upper_bound(rejected, n, level), tried
                rows.append([r.stratum, n, steps, bound, *[policy.get(rule) for rule in RULES]])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return table.mapInPandas(choose, schema)


def apply_rules(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, kept and, for each rule, whether it rejected."""
    cuts = materialize(cutoffs.withColumnRenamed("stratum", "cut_stratum").drop("n_good", "steps", "bound"), "cutoffs")
    rows = measured.join(cuts, measured["stratum"].eqNullSafe(cuts["cut_stratum"]), "left")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    hits = {rule: F.coalesce(F.expr(f"{RULES[rule]} > {rule}_cutoff"), F.lit(False)) for rule in RULES}
    rejected = base
    for hit in hits.values():
        rejected = rejected | hit
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*own, base.alias("base_failed"), (~rejected).alias("kept"), *[hit.alias(f"failed_{rule}") for rule, hit in hits.items()])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    measured = materialize(measures(docs, stratum), "measures")
    return apply_rules(measured, certified_cutoffs(measured, labels, risk, delta))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
