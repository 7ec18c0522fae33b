"""Language identification against naive parsing; quality model by gradients and held-out accuracy."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import language as L
from framelake.llm import quality as Q
from framelake.llm.queries import op8_language, op9_quality


def phrases(train, s):
    """Greedy longest matches of s in any of the training sequences, stretch by stretch. A symbol that training does not
    have ends a phrase and belongs to none."""
    n = 0
    for k in range(0, len(s), L.STRETCH):
        n, now = n + 1, ""
        for c in s[k:k + L.STRETCH]:
            now += c
            if not any(now in t for t in train):
                n, now = n + 1, c if any(c in t for t in train) else ""
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), min_size=1, max_size=4), st.lists(st.text("bcd e", max_size=12), min_size=1, max_size=3),
       st.lists(st.text("abcde x.1É", max_size=40), max_size=5))
def test_parsing(one, two, texts):
    model = L.LanguageModel({"p": one, "q": two})
    codes = L._codes(tuple(model.letters))
    as_text = lambda t: "".join(map(chr, L.to_symbols(t, codes) + 65))
    names, scores = model.classify(texts)
    for t, name, score in zip(texts, names, scores):
        if not model.languages or not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0.0)
            continue
        cost = []
        for k, train in (("p", one), ("q", two)):
            if k in model.languages:
                cost.append((phrases([as_text(x) for x in train], as_text(t)) * model.bits[model.languages.index(k)], k))
        assert name == min(cost)[1] and 0 <= score <= 1


def test_counts_are_exact():
    rng = np.random.default_rng(2)
    train = ["".join(rng.choice(list("abc "), 50)) for _ in range(3)]
    model = L.LanguageModel({"p": train})
    codes = L._codes(tuple(model.letters))
    as_text = lambda t: "".join(map(chr, L.to_symbols(t, codes) + 65))
    for _ in range(30):
        t = "".join(rng.choice(list("abc d"), 90))
        s = L.to_symbols(t, codes)
        assert model._count(s.astype(np.int32)[:, None])[0, 0] == phrases([as_text(x) for x in train], as_text(t))


def test_op8(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language(spark, sf).collect()
    import zlib
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) > 0.95


def test_op8_odd(spark, odd_documents, sf):
    model = L.fit_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = L.identify_languages(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 7}
    assert L.identify_languages(odd_documents.limit(0), model).count() == 0
    none = L.fit_languages(spark.createDataFrame([(1, None, "x"), (2, "en", None)], "doc_id long, lang string, text string"))
    assert {(r.lang_pred, r.score) for r in L.identify_languages(odd_documents, none).collect()} == {("und", 0.0)}


def test_gradient():
    rng = np.random.default_rng(0)
    m = Q.AttentionModel(hidden=3, gate=2)
    x, starts, owner = rng.normal(size=(7, Q.WIDTH)), np.array([0, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 2])
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        s = m._forward(x, starts, owner)[-1]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()
    g = m._gradient(x, y, w, starts, owner)
    for k, p in m.p.items():
        p = m.p[k] = np.array(p, dtype=float)
        for i in list(np.ndindex(p.shape))[:5]:
            old = p[i]
            p[i] = old + 1e-6
            up = loss()
            p[i] = old - 1e-6
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-6 - np.asarray(g[k])[i]) < 1e-5


def test_op9(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95 and np.mean([p for p, y in held if y]) > 0.97


def test_op9_odd(spark, odd_documents):
    labels = spark.createDataFrame([(2, 1), (2, 0), (4, 1), (5, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = Q.fit_quality(odd_documents, labels)
    rows = Q.score_quality(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.score_quality(odd_documents.limit(0), Q.fit_quality(odd_documents, labels.limit(0))).count() == 0
    a, b = Q.encode_passages("one two " * 40_000), Q.encode_passages("one two " * 40)
    assert len(a) == 1000 and np.allclose(a[500], b[0], atol=0.01) and Q.encode_passages(None).shape == (1, Q.WIDTH)


def test_op8_sample(spark):
    """Copies count once, and every chosen text is learned from, from its beginning to its end."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = [(i, "p", " ".join(word() for _ in range(150))) for i in range(900)] + [(i, "p", "a copy " * 150) for i in range(900, 1400)] + [(2000, "q", "kurz"), (2001, "q", "zz " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {k: [r._t for r in L.sample_languages(docs).where(f"lang = '{k}'").orderBy("_k").collect()] for k in "pq"}
    texts = {t for _, k, t in rows if k == "p"}
    owners = [next(t for t in texts if all(x in t for x in pieces)) for pieces in found["p"]]
    assert len(set(owners)) == len(owners) == L.SAMPLE_TEXTS and owners != sorted(owners)
    first = [min(owner.index(x) for x in pieces) / len(owner) for owner, pieces in zip(owners, found["p"]) if "copy" not in owner]
    last = [max(owner.index(x) for x in pieces) / len(owner) for owner, pieces in zip(owners, found["p"]) if "copy" not in owner]
    assert max(first) < 0.3 and min(last) > 0.6
    assert sorted(map(len, map("".join, found["q"]))) == [4, L.SAMPLE_SYMBOLS // 2]
    # all of it is in the automaton: every piece is parsed as one phrase
    model = L.fit_languages(docs)
    codes = L._codes(tuple(model.letters))
    for pieces in found["p"]:
        for x in pieces:
            assert model._count(L.to_symbols(x, codes).astype(np.int32)[:, None])[0, model.languages.index("p")] == 1


def test_op8_every_language_and_letter(spark):
    """More languages than one shard, and scripts of many letters, none of which is dropped or lumped together."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(70):                             # each language has its own 40 of 2,800 Chinese letters
        own = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        rows += [(100 * k + i, f"l{k:02}", "".join(rng.choice(own, 60))) for i in range(2 + (k < 69))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    model = L.fit_languages(docs)
    assert len(model.languages) == 70 and set(model.letters) == {c for _, _, t in rows for c in t}
    assert {r.doc_id: r.lang_pred for r in L.identify_languages(docs, model).collect()} == {d: k for d, k, _ in rows}
    assert model.classify([t for _, _, t in rows])[0] == [k for _, k, _ in rows]


def test_op9_reads_every_passage_of_what_it_learns_from(spark):
    """One loud passage after 150 plain ones decides the label; a fit that skips passages would seldom see it."""
    rng = np.random.default_rng(8)
    plain = lambda n: [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(Q.PASSAGE)) for _ in range(n)]
    loud = " ".join(["BUY NOW!!!"] * (Q.PASSAGE // 2))
    rows = []
    for i in range(120):
        passages = plain(150)
        if i % 2:
            passages[int(rng.integers(150))] = loud
        rows.append((i, " ".join(passages)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()}
    assert np.mean([got[i] == 1 - i % 2 for i in range(80, 120)]) > 0.95


def test_nothing_to_learn(spark):
    """Without both labels every score is 0.5; a kept column of an operator's own name gives way to it."""
    docs = spark.createDataFrame([(1, "some text", 9.0), (2, None, 8.0)], "doc_id long, text string, score double")
    model = Q.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert not model.learned
    assert [(r.score, r.predicted) for r in Q.score_quality(docs, model, keep=["doc_id", "score"]).collect()] == [(0.5, 0)] * 2
    found = L.identify_languages(docs, L.LanguageModel({}), keep=["doc_id", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score"] and {r.lang_pred for r in found.collect()} == {"und"}
