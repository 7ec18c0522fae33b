"""Sum-of-squares packing against the rule worked out plainly."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm.queries import op11_online_packing
from framelake.llm.squares import SquaresPacker, pack_online
from framelake.llm.tokens import load_json

JSON = public_tokenizers.path("byte_bpe_50k.json")
HF = load_json(JSON)


def two(n):
    return n & (n - 1) == 0


def placed(packer):
    out = {}
    for w in packer.done + [w for ws in packer.levels for w in ws]:
        at = 0
        for doc, start, ids in w.pieces:
            out[doc, start] = (w.id, at, len(ids) // 4)
            at += len(ids) // 4
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=60), st.sampled_from([10, 12, 16]))
def test_each_item_joins_the_level_with_the_least_sum_of_squares(sizes, capacity):
    packer, levels = SquaresPacker(capacity), []
    for i, size in enumerate(sizes):
        packer.add(i, bytes(4 * size))
        size %= capacity
        if not size:
            continue
        best = None
        for h in {0, *(x for x in levels if x + size <= capacity)}:
            after = Counter(levels)
            after[h] -= h > 0
            after[h + size] += 1
            cost = sum(n * n for level, n in after.items() if 0 < level < capacity and not two(level))
            best = min(best or (cost, -h), (cost, -h))
        h = -best[1]
        if h:
            levels.remove(h)
        if h + size < capacity:
            levels.append(h + size)
        assert sorted(levels) == [h for h in range(capacity) for _ in packer.levels[h]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([10, 16]), st.sampled_from([1, 3, 100]))
def test_every_token_has_one_place_and_no_window_is_padded(sizes, capacity, limit):
    packer = SquaresPacker(capacity, limit=limit)
    for i, size in enumerate(sizes):
        packer.add(i, np.arange(size, dtype="<u4").tobytes())
        assert packer.n_open <= limit
    packer.close()
    fill, seen = Counter(), defaultdict(list)
    for w in packer.done:
        for doc, start, ids in w.pieces:
            fill[w.id] += len(ids) // 4
            seen[doc] += [(start + k, x) for k, x in enumerate(np.frombuffer(ids, "<u4").tolist())]
    assert all(n == capacity or two(n) and n < capacity for n in fill.values())
    assert {d: sorted(x) for d, x in seen.items()} == {i: [(k, k) for k in range(n)] for i, n in enumerate(sizes)}


def check(rows, docs, capacity=1024, end=0):
    want, got = Counter(), defaultdict(list)
    ids = {}
    for d, t in docs:
        ids[d] = HF.encode(t or "", add_special_tokens=False).ids + [end]
        want[d] += len(ids[d])
    for r in rows:
        got[r.doc_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    copies = Counter(d for d, _ in docs)
    assert {d: sum(r.length for r in rs) for d, rs in got.items()} == dict(want)
    for d, rs in got.items():
        covered = Counter(i for r in rs for i in range(r.start, r.start + r.length))
        assert set(covered.values()) == {copies[d]} and len(covered) == len(ids[d])
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at == capacity or two(at)


def test_op11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(op11_online_packing(spark, sf).collect(), docs)


def test_odd_rows(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text").collect()
    for limit in (2, 4096):
        check(pack_online(odd_documents, JSON, open_windows=limit).collect(), docs)
    assert pack_online(odd_documents.limit(0), JSON).count() == 0
