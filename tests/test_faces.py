"""Face pairs and groups against brute force."""
import random

import numpy as np
import pytest

from framelake.operators import people as P
from framelake.plans.similarity import average_link


def faces(n, people, seed, noise=0.35, dim=16):
    r = np.random.default_rng(seed)
    c = r.normal(size=(people, dim))
    v = c[r.integers(0, people, n)] + noise * r.normal(size=(n, dim)) * np.sqrt(1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def greedy(v, t):
    """Merge the single best pair of groups until none is above t."""
    groups = [[i] for i in range(len(v))]
    s = v @ v.T
    while True:
        best = max(((np.mean([[s[x, y] for y in b] for x in a]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(-2, 0, 0))
        if best[0] <= t:
            return {x: min(g) for g in groups for x in g}
        groups[best[1]] += groups[best[2]]
        del groups[best[2]]


def frame(spark, v, parts=3):
    rows = [(0, i, [float(x) for x in w]) for i, w in enumerate(v)]
    return spark.createDataFrame(rows, "g int, key long, vec array<double>").repartition(parts)


def test_pairs_match_brute_force(spark):
    v = faces(700, 9, 1)
    s = v @ v.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] > 0.5}
    got = {(r.a, r.b) for r in P.cosine_pairs(frame(spark, v), 0.5, tile=64).collect()}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_greedy(spark, seed):
    """Whatever order the rows come in, rounds give the groups of merging the single best pair each time."""
    v = faces(70, 5, seed, noise=0.6)
    rows = [(g, i, w.tolist()) for g in (0, 1) for i, w in enumerate(v if g else v[::-1])]
    random.Random(seed).shuffle(rows)
    got = {(r.g, r.key): r.cluster for r in average_link(spark.createDataFrame(rows, "g int, key long, vec array<double>"), 0.363).collect()}
    assert got == {(g, k): c for g in (0, 1) for k, c in greedy(v if g else v[::-1], 0.363).items()}
