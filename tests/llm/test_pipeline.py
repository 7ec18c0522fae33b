"""The pipeline against plain Python: the classifiers text by text, fingerprints and windows by brute force."""
import re
from itertools import combinations

import numpy as np
from test_tokens import check_packing

import corpus_pipeline as C
from framelake.llm import language as L
from framelake.llm import quality as Q


def without_repeats(docs, k=20):
    seen, out = set(), []
    for d, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            x = tuple(w[s:s + k])
            if x in seen:
                gone[s:s + k] = [True] * k
            seen.add(x)
        out.append((d, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def one_of_each(docs):
    """The smallest doc_id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {d: d for d in sets}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def find(d):
        while low[d] != d:
            d = low[d]
        return d
    near = {p for h in holders.values() for p in combinations(sorted(h), 2)} | {p for p in combinations([d for d, s in sets.items() if not s], 2)}
    for a, b in near:
        if not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            low[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in sets if find(d) == d}


def test_run(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    model = Q.fit_quality(docs.where(~L.in_fold()), spark.read.parquet(f"{sf}/labels.parquet").where(~L.in_fold()))
    good = [d for d, t in texts if model.score([Q.encode_passages(t)])[0] >= Q.THRESHOLD]
    langs = L.fit_languages(docs.where(docs.doc_id.isin(good) & ~L.in_fold()))
    kept = [(d, t) for d, t in texts if d in set(good)]
    kept = [(d, t) for d, t in kept if langs.classify([t])[0][0] != "und"]
    ones = one_of_each(kept)
    kept = [(d, t) for d, t in kept if d in ones]
    check_packing(C.run(spark, sf).collect(), without_repeats(kept))
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert np.mean([d in set(good) for d in fine]) > 0.97 and np.mean([d in set(good) for d in bad]) < 0.1


def test_stages_on_odd_rows(spark, odd_documents, sf):
    from pyspark.sql import functions as F
    docs = odd_documents.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                                F.lit("clash").alias("score"), F.lit("clash").alias("_text"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    for name, stage in C.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf)
            if name != "packing":
                assert out.columns == C.COLUMNS
            assert out.count() <= some.count() or name == "packing"


def test_near_duplicates_by_shingles(spark, sf):
    """The stage keeps what brute-force Jaccard of five-word shingles keeps."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    assert {r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()} == one_of_each([(r.doc_id, r.text) for r in docs.collect()])


def test_stages_that_cannot_learn_keep_everything(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", None, "s", 10) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.quality(spark, docs, str(tmp_path)).count() == 20
    assert C.language(spark, docs, str(tmp_path)).count() == 20
    assert C.quality(spark, docs.limit(0), str(tmp_path)).count() == C.language(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_workers_of_every_stage_return_their_memory(spark, sf, monkeypatch):
    """A worker that keeps what it freed counts against the executor in all later stages."""
    from pyspark.sql.classic.dataframe import DataFrame
    kept, wrapped, plain = set(), set(), DataFrame.mapInArrow

    def seen(df, func, *a, **b):
        (wrapped if func.__name__ == "with_return" else kept).add(f"{func.__module__}.{func.__qualname__}")
        return plain(df, func, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", seen)
    C.run(spark, sf).count()
    assert wrapped and not kept
