"""Substring deduplication against brute force over all windows."""
import hashlib
import random
import re

import numpy as np
import pytest

from framelake.llm import substrings as S
from framelake.llm.queries import op2_substring_dedup


def brute(rows, k=20):
    """rows: (doc_id, text) in their order; the order of documents: key, nulls last, then position."""
    docs = sorted(((d if d is not None else 2 ** 63, i, d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (d, t) in enumerate(rows)), key=lambda x: x[:2])
    seen, out = set(), []
    for _, i, d, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            x = tuple(w[s:s + k])
            if x in seen:
                gone[s:s + k] = [True] * k
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_op2(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op2_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs])


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            kind = rng.randrange(6)
            w += rng.choice(passages) if kind < 2 else ["same"] * rng.randrange(60) if kind == 2 else ["a", "b", "c"] * rng.randrange(15) if kind == 3 else [rng.choice(vocab) for _ in range(rng.randrange(50))]
        rows.append((i * 3, " ".join(w) if i % 7 else "\n\t ".join(w)))
    for i in range(n // 3):                                # a hot passage in varied surroundings
        rows.append((10_000 + i, " ".join([f"x{i}", f"y{i}"] * rng.randrange(12) + passages[3] + [f"z{i}"] * rng.randrange(3))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, monkeypatch, seed):
    rows = corpus(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if seed == 2:                                          # every minimiser is hot: single windows travel
        real = S.hot_minimisers
        monkeypatch.setattr(S, "partitions", lambda s: 4)
        monkeypatch.setattr(S, "hot_minimisers", lambda d, t: (np.unique(np.concatenate([S.Batch([(x or "").encode()]).minimiser for _, x in rows])), real(d, t)[1]))
    assert result(S.dedup_substrings(df)) == brute(rows)


def test_odd(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    out = S.dedup_substrings(odd_documents)
    assert out.columns == [*odd_documents.columns, "n_words", "n_removed"]
    got = result(out)
    assert got == brute(rows)
    assert S.dedup_substrings(odd_documents.limit(0)).count() == 0
    twice = odd_documents.where("doc_id = 5").unionAll(odd_documents.where("doc_id = 5"))
    assert sorted(r.n_removed for r in S.dedup_substrings(twice).collect()) == sorted(b[2] for b in brute(rows[6:7] * 2))


def test_hot_minimisers_are_found(spark):
    hot = " ".join(f"h{i}" for i in range(25))
    rows = [(i, f"{' '.join(f'u{i}_{j}' for j in range(30))} {hot} {' '.join(f'v{i}_{j}' for j in range(30))}") for i in range(200)]
    found, windows = S.hot_minimisers(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "text")
    assert windows == 200 * (85 - 19) and 0 < len(found) <= 32
    assert set(S.Batch([hot.encode()]).minimiser.tolist()) & set(found.tolist())


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"q{rng.randrange(10 ** 6)}" for _ in range(300_000)]
    t = " ".join(words + words[1000:1100])
    assert len(t) > 2 * S.BATCH_BYTES
    rows = [(1, t), (2, " ".join(words[-500:]))]
    assert result(S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def gathered(docs):
    """(packs of strings, stretches that left at once) of documents that one task gathers."""
    p, unpack = S.Packs(1, 1), S.zstandard.ZstdDecompressor().decompress
    p.add(S.Batch([t for _, t in docs]), np.array([d for d, _ in docs]), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64))
    rows = [(part, unpack(x)) for b in p.flush() for part, x in zip(b.column("part").to_pylist(), b.column("pack").to_pylist())]
    return [x for part, x in rows if part < 0], [np.frombuffer(x, np.int64).reshape(4, -1).T.tolist() for part, x in rows if part >= 0]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(S.zlib, "crc32", lambda b: 1)
    a, b = (" ".join(f"{c}{i}" for i in range(30)).encode() for c in "ab")
    one, gone = gathered([(5, a), (6, b), (7, a)])
    assert gone == [[[7, 0, 0, 30]]]                       # in one task a copy is one stretch, whatever the hashes
    two, gone = gathered([(8, a)])
    assert gone == []
    d, _, s, e = S.repeated_in_bucket(one + two)           # and among tasks it meets the earlier one in the bucket
    assert set(d.tolist()) == {8} and min(s) == 0 and max(e) == 30


def test_a_common_window_brings_one_place_a_pack():
    text = " ".join(f"w{i}" for i in range(20)).encode()
    packs, gone = gathered([(d, text) for d in range(9999, -1, -1)])
    assert [S._unpack(x)[2].tolist() for x in packs] == [[0]]
    assert [g[0] for g in gone[0]] == list(range(1, 10000))
