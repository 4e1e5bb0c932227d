import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import quality as Q

from .conftest import ROWS


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x1c\x85é", max_size=60))
def test_measures(text):
    assert Q.measure(text) == brute(text)


def test_exact_bounds():
    cdf = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 10, 0.1), (3, 200, 0.04), (50, 60, 0.5), (10, 10, 0.3)):
        assert abs(math.exp(Q.log_binomial_cdf(k, n, p)) - cdf(k, n, p)) < 1e-8
    assert abs(cdf(3, 200, Q.upper_bound(3, 200, 0.05)) - 0.05) < 1e-9
    assert Q.upper_bound(0, 0, 0.1) == 1.0


def test_cutoffs_are_certified_and_reject_junk(spark):
    good = [(i, "plain words of a good text number %d " % i + " ".join(f"w{j}" for j in range(60))) for i in range(1500)]
    junk = [(2000 + i, " ".join(f"j{j}###" for j in range(60))) for i in range(50)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in good + junk] + [(9000, good[0][1], "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in junk) and got[2000].failed_symbols
    assert got[9000].kept  # a stratum without labels keeps what the base rules keep
    (cut,) = Q.certified_cutoffs(Q.measures(docs), labels).collect()
    assert cut.n_good == 1500 and cut.bound <= Q.RISK + 1e-9 and cut.symbols_cutoff is not None


def test_ladder_only_grows_stricter():
    assert len(Q.LADDER) == sum(map(len, Q.GRID.values())) and {r: min(c) for r, c in Q.GRID.items()} == Q.LADDER[-1]
    for a, b in zip(Q.LADDER, Q.LADDER[1:]):
        assert all(rule in b and b[rule] <= cut for rule, cut in a.items()) and a != b


def test_rules_turn_on_at_the_stated_number_of_labels(spark):
    n = Q.least_labels(Q.RISK, Q.DELTA)
    assert Q.least_labels(Q.RISK, Q.DELTA / 4) == 108
    for labelled, on in ((n - 1, False), (n, True)):
        docs = spark.createDataFrame([(i, f"w{i} " * 60, "en") for i in range(labelled)], "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(i, 1) for i in range(labelled)], "doc_id long, quality int")
        (cut,) = Q.certified_cutoffs(Q.measures(docs), labels).collect()
        assert (cut.symbols_cutoff is not None) == on


def brute_query(docs, labels):
    """Every column of the query, with the binomial sums written out."""
    good, measured = [d for d, q in labels if q == 1 and d is not None], [(d, lang, brute(t or "")) for d, t, lang in docs]
    value = {
        "symbols": lambda m: 100 * m[2] / max(m[0], 1),
        "dup_lines": lambda m: 100 * m[3] / max(m[0], 1),
        "repeat_words": lambda m: 100 * m[4] / max(m[0], 1),
        "long_words": lambda m: m[1] / max(m[0], 1),
    }
    held = {}
    for d, lang, m in measured:
        held.setdefault(lang, []).extend([m] * good.count(d))
    held = {lang: ms for lang, ms in held.items() if ms}
    chosen = {}
    for lang, ms in held.items():
        for policy in Q.LADDER:
            k, n = sum(any(value[r](m) > c for r, c in policy.items()) for m in ms), len(ms)
            if sum(math.comb(n, i) * Q.RISK**i * (1 - Q.RISK) ** (n - i) for i in range(k + 1)) > Q.DELTA / len(held):
                break
            chosen[lang] = policy
    out = []
    for d, lang, m in measured:
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        failed = [value[r](m) > chosen.get(lang, {}).get(r, math.inf) for r in Q.RULES]
        out.append((d, *m, base, not base and not any(failed), *failed))
    return sorted(out, key=str)


def test_whole_query_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    docs, quality = [], [rng.choice([1, 1, 1, 0]) for _ in range(900)]
    for i in range(900):
        words = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 400)) for _ in range(rng.randint(45, 70))]
        text = " ".join(words) + ("\n" + " ".join(words[:4])) * (rng.random() < 0.01 if quality[i] else rng.choice([0, 2, 7])) + " #" * (rng.random() < 0.02 if quality[i] else rng.choice([0, 3, 30, 150]))
        docs.append((i, text, rng.choice(["en", "en", "en", "de", "fr", None])))
    docs += [(1, docs[1][1], "en"), (None, None, "en"), (5000, "", "xx")]
    labels = [(i, quality[i] if i % 40 else None) for i in range(850)] + [(3, 1), (None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got, want = sorted(map(tuple, Q.query(spark, str(tmp_path)).collect()), key=str), brute_query(docs, labels)
    assert got == want and sum(not r[6] and not r[7] for r in got) > 20


def test_few_labels_certify_nothing(spark):
    docs = spark.createDataFrame([(i, "a### " * 60, "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r.symbols_cutoff is None for r in Q.certified_cutoffs(Q.measures(docs), labels).collect())


def test_odd_and_empty(odd, empty, no_labels):
    got = Q.judge(odd, no_labels).collect()
    assert len(got) == len(ROWS) and all(r.base_failed for r in got if r.n_words < 50)
    assert sum(r.n_words for r in got) == sum(brute(t or "")[0] for _, t in ROWS)
    assert Q.judge(empty, no_labels).count() == 0
