"""Spherical-cap filters against all cosines."""
import math

import numpy as np
import pytest

from framelake.llm import embeddings as E
from framelake.llm.queries import op6_embedding_dedup


def brute(rows, threshold):
    """{key position: set of linked positions} over (key, vector) rows."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and 0 < sum(x * x for x in v) < math.inf]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold - 1e-12)):
            if a != b:
                links[own[a]].add(own[b])
    return links


def check(got, rows, threshold, recall):
    links = brute(rows, threshold)
    assert len(got) == len(rows)
    want = {k: len(links[i]) for i, (k, _) in enumerate(rows)}
    assert all(r.n_links <= want[r.vec_id] for r in got)
    total = sum(want.values())
    assert not total or sum(r.n_links for r in got) >= recall * total
    # components lie within those of all true links, and are named by their smallest member
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, bs in links.items():
        for b in bs:
            root[max(find(a), find(b))] = min(find(a), find(b))
    at = {k: i for i, (k, _) in enumerate(rows)}
    for r in got:
        assert r.component_id <= r.vec_id and find(at[r.component_id]) == find(at[r.vec_id]) and r.kept == (r.vec_id == r.component_id)
    return sum(r.n_links for r in got) / total if total else 1.0


def test_op6(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op6_embedding_dedup(spark, sf).collect(), rows, 0.9, 0.95)


@pytest.mark.parametrize("tile", [16, 1024])
def test_clusters(spark, monkeypatch, tile):
    """A hot cluster over many tiles, pairs near the threshold, and counts that do not depend on the tiles."""
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 24))
    rows = []
    for i in range(700):
        b = base[0] if i % 3 == 0 else base[rng.integers(20)]
        v = b + rng.normal(size=24) * np.linalg.norm(b) / np.sqrt(24) * rng.choice([0.01, 0.2, 0.3])
        rows.append((i, v.tolist()))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]          # exact copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = E.near_duplicate_vectors(df).collect()
    assert check(got, rows, 0.9, 0.95) > 0.95
    copies = {r.vec_id: r.n_links for r in got}
    assert copies[1000] == copies[0]


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [-1.0, -2.0]),
            (11, [0.0, 1.0]), (12, [-0.0, 1.0]), (13, [1.0]), (14, [3.0]), (15, [1.0, 2.0, 0.0]), (16, [1e-200, 1.0]), (17, [1e200, 1e200]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(df, 0.9).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 17: (0, 17, True),
                   7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 10: (0, 10, True), 11: (2, 11, True), 12: (2, 11, False), 16: (2, 11, False),
                   13: (1, 13, True), 14: (1, 13, False), 15: (0, 15, True)}
    assert E.near_duplicate_vectors(df, 0.9).count() == len(rows)
    assert E.near_duplicate_vectors(df.limit(0), 0.9).count() == 0
    null = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.1]), (5, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, (tuple(r) for r in E.near_duplicate_vectors(null).collect()))) == sorted(map(str, [(None, 1, None, False), (None, 1, None, False), (5, 0, 5, True)]))


def test_list_decoding_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for t in range(E.CODES):
        rotation, code = E.product_code(10, 9, t)
        y = x @ rotation
        total = (y[:, :5] @ code[0])[:, :, None] + (y[:, 5:] @ code[1])[:, None, :]
        want |= {(i, t * 81 + a * 9 + b) for i, a, b in zip(*np.nonzero(total >= 1.5))}
    assert set(zip(*map(np.ndarray.tolist, E.list_decode(x, 1.5, 9)))) == want


def test_filter_size_follows_the_input():
    assert abs(E.both_exceed(1.0, 0.0) - E._tail(1.0) ** 2) < 1e-5
    for n in (100, 10_000, 10 ** 7, 10 ** 10):
        z, words = E.filter_size(n, 0.9)
        assert E.SHARED <= E.CODES * words ** 2 * E.both_exceed(z, 0.9) and (E.SHARED > E.CODES * (words - 1) ** 2 * E.both_exceed(z, 0.9) or words == 4)
