"""Collocations against plain counting."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import collocations as C


def plain(docs, threshold, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        own = {p: a for p, a in own.items() if a >= threshold}
        inside = Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        found = []
        for p, a in own.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.mark.parametrize("threshold,first", [(100, 2000), (7, 50)])
def test_against_plain_counts(spark, sf, monkeypatch, threshold, first):
    monkeypatch.setattr(C, "BATCH_BYTES", 5000)             # texts are cut between words
    monkeypatch.setattr(C, "HELD", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    docs = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang"))).repartition(5)
    assert sorted(map(tuple, C.collocations(docs, threshold, first).collect())) == plain([tuple(r) for r in docs.collect()], threshold, first)


def test_one_phrase_in_a_third_of_all_rows_and_full_filters(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", (1 << 3, 1 << 6))
    rows = [("en" if i % 2 else None, f"Common  phrase\there, a{i % 9} b{i % 4} c{i % 2}. x{i}") for i in range(900)] + [("en", "und " * 50)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert sorted(map(tuple, C.collocations(docs, 20, 100).collect())) == plain(rows, 20, 100)


def test_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumn("lang", F.when(F.col("doc_id") > 4, "en")).withColumn("phrase", F.lit("clash"))
    assert sorted(map(tuple, C.collocations(docs, 2, 100).collect())) == plain([(r.lang, r.text) for r in docs.collect()], 2, 100)
    assert C.collocations(docs.limit(0)).count() == 0


def test_collisions_are_told_apart_by_the_words(monkeypatch):
    monkeypatch.setattr(C, "_mix", lambda x: x * np.uint64(0))          # every word and sequence collides
    w = C.Words(b"a b a b\nb b a", 13, np.array([8, 14]), np.array([1, 2], dtype=np.uint64))
    ids = w.ids()
    assert len(set(ids.tolist())) == 2
    at, fp = w.sequences(2)
    first, n = C.verified_counts(w, 2, at, fp, ids)
    assert Counter({(int(w.owner[i]), w.phrase(i, 2)): c for i, c in zip(first.tolist(), n.tolist())}) == {(0, b"a b"): 2, (0, b"b a"): 1, (1, b"b b"): 1, (1, b"b a"): 1}
