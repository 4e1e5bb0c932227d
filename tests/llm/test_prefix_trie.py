import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, node string, n string, block string, one string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            nodes[built[:d]].append((c, d == len(built)))
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in nodes.items()}
    out = []
    for p, members in nodes.items():
        children = [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(not any(len(x) == len(q) + 1 and x[:-1] == q for x in nodes) for q in below)
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), parent, len(members), len(children), leaves, sum(map(saved.get, below)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(260), n):
        for turn in range(rng.choice([0, 1, 2, 4, 7])):
            rows.append((c, rng.choice([turn, None, turn - 1]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes é", "", None, "no" * 3])))
    return rows


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (3, 2)])
def test_trie_by_brute_force(spark, primes):
    """Small primes make most fingerprints collide, so that groups are split many times."""
    rows = made(7, 90)
    rows += [(100, None, None, None), (None, 0, "user", "lost"), (205, 1, "user", "b"), (205, 1, "user", "a"), (205, 1, "user", "a")]
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows), primes)) == brute_trie(rows)


def test_long_and_hot_conversations(spark):
    rows = [(0, i, "user", f"t{i % 7}") for i in range(900)] + [(300, i, "user", f"t{i % 7}") for i in range(901)]
    rows += [(c, i, "bot", "same") for c in range(1000, 1040) for i in range(8)] + [(5, 0, "user", "word " * 50_000)]
    table = conversations(spark, rows).repartition(5)
    got = collected(prefix_trie.prefix_trie(table))
    assert len(got) == len({tuple(g[:2]) for g in got})
    root = next(g for g in got if g[1] == 0)
    assert root[3] == 43 and max(g[1] for g in got) == 901
    small = [r for r in rows if r[0] >= 1000 or r[0] == 5]
    assert collected(prefix_trie.prefix_trie(conversations(spark, small))) == brute_trie(small)


def test_empty_and_turnless(spark):
    assert collected(prefix_trie.prefix_trie(conversations(spark, []))) == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)  # gives up all its turns and gets none
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_segmented_scan(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 2, 2, 2, 9]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, at long, v long").repartition(6)
    sums, want = defaultdict(int), {}
    for k, at, v in rows:
        sums[k] += v
        want[at] = sums[k]
    assert {r["at"]: r.v_sum for r in prefix_trie.segmented_scan(df, "k", [F.col("at")], ["v"]).collect()} == want
    assert {r["at"]: r.v_sum for r in prefix_trie.segmented_scan(df, "k", [F.col("at")], ["v"], (11,)).collect()} == {a: s % 11 for a, s in want.items()}
