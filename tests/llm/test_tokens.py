"""Packing and byte-level BPE against the libraries themselves."""
import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import bpe, packing
from framelake.llm.queries import op1_best_fit_packing, op7_byte_bpe
from framelake.llm.tokens import PieceEncoder, load_json, load_ranks

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BY_RANK = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BY_RANK, special_tokens={})
HF, OWN = load_json(JSON), PieceEncoder(load_ranks(RANKS, PATTERN))
HFP = PieceEncoder(HF)
texts = st.text(st.one_of(st.sampled_from(" \n\t\u00a0\u3000'st.,!?09aeinAE\x1cé漢\u200d"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_piecewise_ids_are_the_ids_of_the_whole_text(t):
    assert np.frombuffer(OWN.encode(t), "<u4").tolist() == TIK.encode_ordinary(t)
    assert np.frombuffer(HFP.encode(t), "<u4").tolist() == HF.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(texts)
def test_decoding_and_offsets(t):
    table = bpe.ByteTable(OWN.tok.get_vocab())
    ids = np.frombuffer(OWN.encode(t), "<u4")
    assert table.decode(ids) == t.encode() and table.text(ids) == t
    s, e = table.offsets(t.encode(), ids)
    assert (e - s >= 0).all() and (not len(ids) or (s[0] == 0 and e[-1] == len(t)))
    for a, b, i in zip(s, e, ids):
        whole = table.words[i].decode("utf-8", "ignore")
        assert whole in t[a:b]


def test_split_character():
    table = bpe.ByteTable(OWN.tok.get_vocab())
    ids = np.frombuffer(OWN.encode("\U0001F9D1"), "<u4")
    assert len(ids) > 1 and table.text(ids[:1]) == "\ufffd" and table.text(ids) == "\U0001F9D1"


def check_bpe(rows, docs):
    want = Counter()
    for d, t in docs:
        ids = TIK.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_op7(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_bpe(op7_byte_bpe(spark, sf).collect(), docs)


def test_op7_odd(spark, odd_documents):
    out = bpe.encode_documents(odd_documents, RANKS, PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
    check_bpe(out.collect(), odd_documents.select("doc_id", "text").collect())
    assert bpe.encode_documents(odd_documents.limit(0), RANKS, PATTERN).count() == 0


def check_packing(rows, docs, slack=1.02):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    copies, ids = Counter(d for d, _ in docs), {}
    for d, t in docs:
        ids[d] = HF.encode(t or "", add_special_tokens=False).ids + [2]
    assert set(pieces) == set(ids)
    for d, rs in pieces.items():
        n = len(ids[d])
        seen = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rs)
        first, want, at, k = n % 1024 or 1024, Counter(), 0, 0
        while at < n:
            end = first if k == 0 else at + 1024
            want[k, at, end - at, zlib.crc32(np.array(ids[d][at:end], "<u4").tobytes())] = copies[d]
            at, k = end, k + 1
        assert seen == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= max(-(-total // 1024) * slack + 1, sum(r.length > 512 for r in rows))


def test_op1(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_packing(op1_best_fit_packing(spark, sf).collect(), docs)


def test_op1_odd(spark, odd_documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 5)         # several salts
    docs = odd_documents.select("doc_id", "text").collect()
    check_packing(packing.pack_documents(odd_documents, JSON).collect(), docs)
    assert packing.pack_documents(odd_documents.limit(0), JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
def test_plan_is_best_fit(counts):
    """The plan on counts fills bins as piece-by-piece best fit does after the matching of large lengths."""
    cap = 30
    plan = packing.plan_bins(counts, cap)
    filled, ranks = defaultdict(list), defaultdict(list)
    for size, rank, first, n, each, offset in plan.tolist():
        for k in range(n * each):
            filled[first + k // each].append((offset + k % each * size, size))
            ranks[size].append(rank + k)
    assert {s: len(r) for s, r in ranks.items()} == counts and all(sorted(r) == list(range(len(r))) for r in ranks.values())
    large = 0
    for b in filled.values():
        at = 0
        for o, s in sorted(b):
            assert o == at
            at += s
        assert at <= cap and sum(3 * s > cap for _, s in b) <= 2
        large += any(3 * s > cap for _, s in b)
    # piece by piece
    left = Counter({s: c for s, c in counts.items() if 3 * s > cap})
    gaps = []
    while +left:
        a = max(+left)
        left[a] -= 1
        b = max((s for s in +left if s <= cap - a), default=0)
        left[b] -= bool(b)
        gaps.append(cap - a - b)
    assert large == len(gaps)
    for s in sorted((s for s in counts if 3 * s <= cap), reverse=True):
        for _ in range(counts[s]):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(cap - s)
            else:
                gaps.remove(fit)
                gaps.append(fit - s)
    assert len(gaps) == len(filled)


def test_kept_pieces_do_not_change_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, two = (sorted(map(tuple, packing.token_pieces(docs, path, 64, 2, keep_pieces=k).collect())) for k in (True, False))
    assert one == two and one


def test_columns_are_encoded_as_their_texts(monkeypatch):
    """Also where cuts are not safe, texts fall into several runs, and known pieces are given up meanwhile."""
    import public_tokenizers
    import pyarrow as pa

    from framelake.llm import tokens
    monkeypatch.setattr(tokens, "TOGETHER_BYTES", 40)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    texts = ["", None, " ", "a", "a b", " a", "a  b", "a\nb c", "x  y z w", "　a b", "é, è. ×. ÷! ß? 1. don't, 's. a  b", "中文 文字 。 a",
             "a b ", "\tq r", "a \x1c b c", "x. y, z; ª. µ! ÿ: É? ñ,", "a .. b", "a ., b", "\x85 b", "a \x85", "a b c", "a  b c", "word " * 50 + "word."]
    enc = tokens.PieceEncoder(tokens.load_json(public_tokenizers.path("byte_bpe_50k.json")))
    column = pa.array(["not read", *texts]).slice(1)
    for _ in range(2):
        got = [bytes(x) for x in enc.encode_column(column)]
        assert got == [enc._alone(t or "") for t in texts]
    assert list(enc.encode_column(pa.array([], pa.string()))) == []
    assert [bytes(x) for x in enc.encode_column(pa.array([None, " ", "a  "]))] == [enc._alone(t) for t in ("", " ", "a  ")]
    # what a mark follows is learned once, with or without it, and known to the texts that come next
    monkeypatch.setattr(tokens, "CACHE_PIECES", 1000)
    enc, learned = tokens.PieceEncoder(enc.tok), []
    monkeypatch.setattr(enc, "_learned", lambda p, learn=enc._learned: learned.extend(p.to_pylist()) or learn(p))
    list(enc.encode_column(pa.array(["a été, été bc! bc?", "a bc, été."] * 30)))
    assert sorted(learned) == ["bc", "été"]


def test_few_pieces_kept_by_a_task_do_not_change_ids():
    """A task's encoder keeps the pieces of the last texts when they are more than it may."""
    import public_tokenizers
    import pyarrow as pa

    from framelake.llm import tokens
    enc = tokens.PieceEncoder(tokens.load_json(public_tokenizers.path("byte_bpe_50k.json")), 3)
    for texts in (["a b c d"], ["a e, f"], ["a b, e", "f  g h"]):
        assert [bytes(x) for x in enc.encode_column(pa.array(texts))] == [enc._alone(t) for t in texts]
        assert len(enc.known[0]) <= 5
