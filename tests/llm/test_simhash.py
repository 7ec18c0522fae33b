"""SimHash against a brute-force version."""
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import simhash as S
from framelake.llm.common import components
from framelake.llm.queries import op4_simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, tau):
    """prints: list of (key, fp)."""
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(root, 2):
        if (a ^ b).bit_count() <= tau:
            root[find(a)] = find(b)
    low = {}
    for k, f in prints:
        if k is not None:
            low[find(f)] = min(k, low.get(find(f), k))
    return sorted(((k, f"{f:016x}", low.get(find(f))) for k, f in prints), key=str)


def test_op4(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op4_simhash(spark, sf).collect()), key=str) == brute_components([(d, brute_print(t)) for d, t in docs], 4)


def test_odd(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text").collect()
    got = sorted(map(tuple, S.near_duplicates(odd_documents, 4).collect()), key=str)
    assert got == brute_components([(d, brute_print(t)) for d, t in docs], 4)
    assert S.near_duplicates(odd_documents.limit(0), 4).count() == 0


def edited(words, share, rng):
    return [f"new{rng.randrange(10 ** 9)}" if rng.random() < share else w for w in words]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents(spark):
    """Pairs well above the similarity are found, pairs well below it are not, exact copies always."""
    rng = random.Random(2)
    rows, pairs = [], []
    for i in range(150):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([80, 200, 600]))]
        copy = edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.06, 0.1, 0.2]), rng)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, "\n".join(copy))]
        pairs.append(jaccard(base, copy))
    comp = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [comp[2 * i] == comp[2 * i + 1] for i in range(150)]
    assert all(x for x, j in zip(linked, pairs) if j == 1)
    assert np.mean([x for x, j in zip(linked, pairs) if j >= 0.85]) > 0.93
    assert np.mean([x for x, j in zip(linked, pairs) if j < 0.55]) < 0.07
    assert all(c in (d, d - 1) for d, c in comp.items())              # and never anything else


def test_keep_one(spark, odd_documents):
    more = odd_documents.unionByName(odd_documents.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text"), "length", "_text"))
    kept = S.keep_one_of_each(more)
    assert kept.columns == more.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        ((r.doc_id, r.text) for r in odd_documents.dropDuplicates(["text"]).collect() if r.doc_id not in (1, 3, 7)), key=str) or \
        sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "4", "5", "6", "8", "9", "None"]
    assert S.keep_one_of_each(more.limit(0)).count() == 0


@pytest.mark.parametrize("n,tile", [(3000, 64), (3000, 2048)])
def test_links_of_clusters(spark, monkeypatch, n, tile):
    """Clusters of every density, a hot one over many tiles, and chains; every plan finds the same components."""
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fps = set()
    for i in range(n):
        f = int(base[0] if i % 3 == 0 else rng.choice(base))
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    f = int(base[1]) ^ 0xFFFF
    for b in range(0, 60, 3):                       # a chain
        f ^= 0b111 << b
        fps.add(f)
    prints = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "k long, fp long")
    want = {(k, c) for k, _, c in brute_components(prints, 4)}
    for plan in (None, [([*range(20)], 1), ([*range(20, 42)], 1), ([*range(42, 64)], 0)], [([*range(32)], 1), ([*range(32, 64)], 2)]):
        if plan and tile == 64:
            continue
        if plan:
            monkeypatch.setattr(S, "allocate", lambda *a, p=plan: p)
        comp = components(S.near_edges(df.select("fp", F.col("k").alias("node"), F.lit(b"").alias("more")), 4), node="k", root="root")
        rows = df.join(comp, "k", "left").withColumn("root", F.coalesce("root", "k")).collect()
        low = {}
        for r in rows:
            low[r.root] = min(r.k, low.get(r.root, r.k))
        assert {(r.k, low[r.root]) for r in rows} == want


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    for n in (10, 10 ** 5, 10 ** 7, 10 ** 10):
        for tau in (0, 1, 3, 4, 6):
            x = rng.integers(0, 2, (500, 64)).astype(float)
            x[:, 10:20] = x[:, :10]
            corr, p = S.correlation(x.T @ x, 500)
            plan = S.allocate(n, corr, p, tau)
            bits = [b for g, _ in plan for b in g]
            assert len(bits) == len(set(bits))
            skipped = int(len(bits) < 64)
            assert sum(t for _, t in plan) + len(plan) >= tau + 1 or skipped and sum(t + 1 for _, t in plan) >= tau + 1


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, find(x)) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub(spark):
    """Each star's centre is the largest, the smallest or a middle node, and holds a third of all edges."""
    stars = spark.range(1, 60_000).selectExpr("id * 3 + id % 3 AS a", "array(-5L, 1000000L, 90001L)[cast(id % 3 AS int)] AS b")
    got = components(stars.repartition(7))
    assert {(r[0], r[1]) for r in got.groupBy("component").count().collect()} == {(-5, 20_000), (4, 20_001), (8, 20_001)}


@pytest.mark.parametrize("tile", [512, 8])
def test_similarity_is_exact(spark, monkeypatch, tile):
    """Components against brute-force Jaccard, with most pairs around the similarity: edited pairs, one hot template whose
    members are about 0.7 alike, near copies, and texts that repeat one passage and differ in the rest."""
    monkeypatch.setattr(S, "SET_TILE", tile)
    monkeypatch.setattr(S, "SMALL", 5 if tile == 8 else S.SMALL)
    rng = random.Random(5)
    texts = []
    for i in range(150):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 100, 300]))]
        texts += [base, edited(base, rng.choice([0.015, 0.022, 0.03]), rng)]
    template = [f"t{i}" for i in range(200)]
    texts += [edited(template, 0.018, rng) for _ in range(60)]
    copy = [f"c{i}" for i in range(200)]
    texts += [edited(copy, 0.003, rng) for _ in range(60)]
    texts += [["again", "and", "over", "once", "more"] * 100 + [f"v{rng.randrange(10 ** 6)}" for _ in range(30)] for _ in range(10)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    near = []
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    for a, b in combinations(range(len(texts)), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        near.append(j)
        if j >= 0.8:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert sum(0.75 <= j < 0.8 for j in near) > 20 and sum(0.8 <= j < 0.85 for j in near) > 20
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_keep_one_with_one_key_on_two_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    docs = spark.createDataFrame([(1, one), (1, two), (2, two), (0, three), (1, three), (1, one)], "doc_id long, text string")
    assert sorted(map(tuple, S.keep_one_of_each(docs).collect())) == [(0, three), (1, one), (1, two)]
