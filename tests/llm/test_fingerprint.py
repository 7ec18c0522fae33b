"""Locally consistent parsing: equal substrings share interior names, and the comparison with the next document."""
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import fingerprint as P
from framelake.llm.queries import op10_fingerprint


def brute(docs):
    """docs in order: key descending, nulls last."""
    order = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -2 ** 63), d[1] or ""))
    out = []
    for (k, t), (_, u) in zip(order, [*order[1:], *order[:1]]):
        t, u = t or "", u or ""
        h = len(t) // 2
        e = t[:len(t) - h] + u[:h]
        f, g, nxt = (P.sketch(P.phrases([x])[0]) for x in (t, e, u))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, P.likeness(f, g), P.likeness(f, nxt)))
    return sorted(out, key=str)


def test_op10(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op10_fingerprint(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
    assert np.mean([r.near_edited for r in got]) > 0.25 and np.mean([r.near_next for r in got]) < 0.05


@pytest.mark.parametrize("parts", ["1", "4"])
def test_odd(spark, odd_documents, parts, monkeypatch):
    monkeypatch.setattr(P, "BATCH", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, P.compare_with_next(odd_documents).collect()), key=str)
        assert got == brute(odd_documents.select("doc_id", "text").collect())
        assert P.compare_with_next(odd_documents.limit(0)).count() == 0
        one = odd_documents.where("doc_id = 2")
        assert P.compare_with_next(one).first().near_next == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_plain_fingerprints(spark, odd_documents):
    rows = P.fingerprint_documents(odd_documents).collect()
    text = {(r.doc_id, r.text) for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    assert {(r.doc_id, r.fingerprint) for r in rows} == {(k, P.sketch(P.phrases([t or ""])[0])) for k, t in text}


@settings(max_examples=100, deadline=None)
@given(st.text("abcd ef", max_size=60), st.text("abcd ef", max_size=60), st.integers(0, 2 ** 32))
def test_equal_substrings_share_names(before, after, seed):
    rng = np.random.default_rng(seed)
    core = "".join(rng.choice(list("abcdefghij klm"), 400))
    a, b = P.phrases([core, before + core + after])
    for level in P.KEEP:
        shared = len(np.intersect1d(a[level], b[level]))
        assert shared >= len(a[level]) - 8         # but for the phrases at the edges


def test_long_runs_and_blocks():
    t = "a" * (P.BLOCK + 5) + "bc" * 100
    assert P.sketch(P.phrases([t])[0]) == P.sketch(P.phrases(["x", t])[1])
    assert P.likeness("-", "-") == 1.0 and P.likeness(P.sketch(P.phrases(["abc"])[0]), "-") == 0.0
