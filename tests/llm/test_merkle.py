"""The manifest against a plain tree, and addresses against the recursive layout."""
import hashlib
import zlib
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def layout(top, levels):
    """Nodes (level, index) of a complete tree in van Emde Boas order, written out recursively."""
    if levels == 1:
        return [top]
    half = levels // 2
    out = layout(top, half)
    level, index = top[0] + half, top[1]
    for i in range(index * M.FAN ** half, (index + 1) * M.FAN ** half):
        out += layout((level, i), levels - half)
    return out


@pytest.mark.parametrize("fan,levels", [(2, 1), (2, 2), (2, 5), (2, 8), (3, 4), (16, 3)])
def test_addresses(monkeypatch, fan, levels):
    monkeypatch.setattr(M, "FAN", fan)
    for at, (level, index) in enumerate(layout((0, 0), levels)):
        assert M.address(level, index, levels) == at


def climb(nodes):
    """(root, for each node the siblings to its left and right level by level)."""
    ways, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            ways[k].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        level, at = [H(*r) for r in runs], [i // 16 for i in at]
    return level[0], ways


def plain(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    order = sorted(rows, key=lambda r: (r.source is not None, (r.source or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    groups = [(k, list(g)) for k, g in groupby(order, key=lambda r: r.source)]
    trees = [climb([leaf(r, r.text) for r in g]) for _, g in groups]
    root, above = climb([t[0] for t in trees])
    out = []
    for (_, g), (sub, ways), up in zip(groups, trees, above):
        for r, way in zip(g, ways):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for a, b in way + up:
                x = H(a, x, b)
            out.append((r.doc_id, leaf(r, r.text), sub, root, H(*(s for ab in way + up for s in ab)), x, x == root))
    return out


def same(spark, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, M.manifest(docs).collect()), key=key) == sorted(plain(docs.collect()), key=key)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_against_plain_tree(spark, sf, monkeypatch, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    # one source with most rows, many with one, one without a name
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 7 == 0, F.concat(F.lit("é"), "doc_id")).when(F.col("doc_id") % 11 > 0, F.col("source")))
    same(spark, docs)


def test_odd_rows(spark, odd_documents):
    docs = odd_documents.select("doc_id", F.when(F.col("doc_id") < 3, "s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(7).cast("long").alias("n_chars"), "text", F.lit("clash").alias("g"), F.lit("clash").alias("pos"))
    same(spark, docs)
    one = docs.limit(1)
    same(spark, one)
    assert M.manifest(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2))
def test_blocks_fold_to_their_root(n, more):
    height = more
    while 16 ** height < n:
        height += 1
    nodes = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    b = M.Block.build(nodes, height)
    for i, way in enumerate(b.paths([])):
        assert M.fold(nodes[i].tobytes().hex(), way) == b.tree[0].tobytes().hex() and M._unpack(M._pack(way)) == way
