import random
import re

import numpy as np
import pytest

from corvane.llm import minhash

from .conftest import ROWS, frame


def brute_set(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def brute_groups(rows, shingle, percent):
    sets, root = [brute_set(t, shingle) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_odd_rows(odd, empty):
    assert collected(minhash.minhash_groups(odd)) == brute_groups(ROWS, 2, 80)
    assert collected(minhash.minhash_groups(empty)) == []


@pytest.mark.parametrize(("block", "percent", "shingle"), [(1024, 80, 2), (4, 80, 2), (8, 60, 1)])
def test_groups_by_brute_force(spark, block, percent, shingle):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(300)]
    passage, rows = [rng.choice(words) for _ in range(60)], []
    for base in range(6):  # copies of growing distance, and texts that are mostly one passage
        text = [rng.choice(words) for _ in range(80)]
        for _ in range(12):
            near = list(text)
            for _ in range(rng.randint(0, 9)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append(" ".join(near))
        rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(10, 30))]) for _ in range(8)]
    rows += ["one two three four five six", "one two three four five six seven", "ONE two three four five", "a b", "A  b", "b a", "x", "x", " "]
    rng.shuffle(rows)
    table = [(i, t) for i, t in enumerate(rows)]
    assert collected(minhash.minhash_groups(frame(spark, table), shingle, percent, block=block)) == brute_groups(table, shingle, percent)


def test_threshold_and_signatures():
    for percent in (60, 80, 95):
        m = minhash.match_threshold(percent, 64)
        rng = np.random.default_rng(percent)
        assert 0 < m < 64 * percent / 100 and (rng.binomial(64, percent / 100, 200_000) < m).mean() < 1e-4
    assert minhash.match_threshold(100, 64) == 64
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (800, 100, 100))
    agree = np.mean([(minhash.signature(np.append(shared ^ s, a ^ s)) == minhash.signature(np.append(shared ^ s, b ^ s))).mean() for s in rng.integers(0, 1 << 63, 40, np.uint64)])
    assert abs(agree - 0.8) < 0.03
