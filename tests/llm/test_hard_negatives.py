import math
import random

import numpy as np
import pytest

from corvane.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, list string, block string, score string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def brute(rows, every, positives, negatives):
    seen, wide = {}, max((len(e) for _, e, _ in rows if e), default=0)
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(seen[a][1] + [0] * wide, seen[b][1] + [0] * wide))
    out = []
    for a in (a for a in seen if a % every == 0):
        near = sorted((-score(a, b), b) for b in seen if b != a and seen[b][0] == seen[a][0])[:positives]
        far = sorted((-score(a, b), b) for b in seen if seen[b][0] != seen[a][0])
        for p, b in near:
            hard = [(n, c) for n, c in far if -30 * p <= -100 * n <= -90 * p][:negatives]
            out += [(a, b, rank, c, -p, -n) for rank, (n, c) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, every=10, positives=5, negatives=10, **kw):
    return sorted(map(tuple, H.mine(H.clean_vectors(vectors(spark, rows)), every, positives, negatives, **kw).collect()))


@pytest.mark.parametrize(("seed", "block", "grid"), [(1, 2048, 0), (2, 16, 0), (3, 32, 4)])
def test_by_brute_force(spark, seed, block, grid):
    """A coarse grid makes most scores ties; small blocks cut every list."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    value = lambda x: round(x * grid) / grid if grid else x
    rows = [(i, [value(c + rng.gauss(0, 0.2)) for c in rng.choice(centres)], rng.randint(0, 2)) for i in rng.sample(range(2000), 500)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(150)]  # a vector that is very common
    assert mined(spark, rows, block=block) == brute(rows, 10, 5, 10)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(60)]
    rows += [(None, [1.0] * 4, 0), (70, None, 0), (71, [1.0, None, 0.0, 0.0], 0), (72, [1.0, math.nan, 0.0, 0.0], 0), (73, [math.inf, 0.0, 0.0, 0.0], 1), (80, [1.0] * 4, None)]
    rows += [(90, [0.5, 0.5], 0), (100, [], 1), (20, [0.1] * 4, 0), (20, [0.1] * 4, 0), (20, [0.2] * 4, 1), (110, [0.0] * 4, 0), (120, [9.0] * 4, 5)]
    assert mined(spark, rows) == brute(rows, 10, 5, 10)
    assert mined(spark, []) == [] and mined(spark, [(10, [1.0], 1)]) == []
    huge = [(i, [3e38 * (1 if i % 3 else -1), float(i)], i % 2) for i in range(30)]
    assert all(abs(r[4]) <= 2**55 for r in mined(spark, huge))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1000, (6, 8))
    rows = np.rint(centres[rng.integers(0, 6, 300)] + rng.normal(0, 5, (300, 8))).astype(np.int64)
    centroids = H.fit_centroids(rows.astype(float), 12)
    own = H.nearest(rows.astype(float), centroids)
    radii = np.array([max((np.linalg.norm(r - centroids[c]) for r in rows[own == c]), default=-1) for c in range(12)])
    least, most = H.bounds(rows[:50], centroids, radii)
    every = H.products(rows[:50], rows)
    assert (every >= least[:, own]).all() and (every <= most[:, own]).all()
    kth = np.sort(every, axis=1)[:, -10]
    assert (most[:, radii >= 0] < kth[:, None]).mean() > 0.3  # lists that the search need not read
    big = rng.integers(-(1 << 27), 1 << 27, (3, 8))
    assert (H.products(big, big) == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in big] for a in big]).all()
