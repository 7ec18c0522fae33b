"""Document fingerprints by locally consistent parsing."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import partitions

#: Longer texts are parsed in blocks of this many code points, so memory is bounded; only phrases at block edges differ.
BLOCK = 1 << 20
#: Texts parsed together in one batch, in code points.
BATCH = 1 << 18
#: Sketch sizes: names kept of the phrases of the third level (about 30 characters each) and of the second (about 10).
KEEP, LEVELS = {3: 24, 2: 12}, 3
#: A text with fewer third-level phrases is compared by its second-level phrases.
FEW = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit; x has no zeros."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)


def parse_level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names of the phrases, document of each). names: of the symbols of all documents one after another.

    Runs of one symbol become a single symbol named by symbol and length. Then neighbours differ, and deterministic coin
    tossing shortens labels: each becomes the place of the lowest bit in which it differs from its left neighbour, and that
    bit. Four rounds take 64-bit names to at most six labels that still differ from their neighbours; a phrase begins at
    each local maximum. So where phrases begin depends on a handful of symbols around, not on the offset."""
    if not len(names):
        return names, doc
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    names, doc = _mix(names[at] + (length - np.uint64(1)) * _ODD), doc[at]
    # two adjacent runs get different names: symbol or length differ, and _mix keeps 64-bit values apart but for chance
    first = np.ones(len(names), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    label = names
    for _ in range(4):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[0] = 0
        apart = np.where(first, np.uint64(1), label ^ left)
        apart = np.where(apart == 0, np.uint64(1), apart)
        place = _low_bit(apart)
        label = (place << np.uint64(1)) | ((label >> place) & np.uint64(1))
    last = np.roll(first, -1)
    high = ~first
    high[1:] &= label[1:] > label[:-1]
    high[:-1] &= label[:-1] > label[1:]
    start = np.flatnonzero(first | (high & ~last))
    # phrase names: symbols mixed with their place in the phrase, summed
    size = np.diff(np.append(start, len(names)))
    place = (np.arange(len(names)) - np.repeat(start, size)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(names + (place + np.uint64(1)) * _ODD), start)), doc[start]


def phrases(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """For each text the sorted distinct phrase names of the kept levels."""
    blocks, owner = [], []
    for i, t in enumerate(texts):
        for k in range(0, len(t), BLOCK):
            blocks.append(np.frombuffer(t[k:k + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4"))
            owner.append(i)
    out: list[dict[int, np.ndarray]] = [{n: np.zeros(0, np.uint64) for n in KEEP} for _ in texts]
    if not blocks:
        return out
    names = _mix(np.concatenate(blocks).astype(np.uint64) + _ODD)
    doc = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    owner = np.array(owner)
    for level in range(1, LEVELS + 1):
        names, doc = parse_level(names, doc)
        if level in KEEP:
            text = owner[doc]
            order = np.lexsort((names, text))
            t, n = text[order], names[order]
            keep = np.ones(len(n), dtype=bool)
            keep[1:] = (n[1:] != n[:-1]) | (t[1:] != t[:-1])
            t, n = t[keep], n[keep]
            at = np.searchsorted(t, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                out[i][level] = n[at[i]:at[i + 1]]
    return out


def sketch(sets: dict[int, np.ndarray]) -> str:
    """The smallest names of each kept level as hex digits (12 each, 48 of 64 bits), levels parted by '-'. Names are hash values, so
    these are a uniform sample that two sets share as they overlap."""
    return "-".join("".join(f"{x >> 16:012x}" for x in sets[n][:k].tolist()) for n, k in KEEP.items())


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases of two fingerprints, 0 to 1; equal ones, also of empty texts, give 1."""
    if a == b:
        return 1.0
    x, y = ([[s[i:i + 12] for i in range(0, len(s), 12)] for s in f.split("-")] for f in (a, b))
    level = 0 if min(len(x[0]), len(y[0])) >= FEW else 1
    k = list(KEEP.values())[level]
    p, q = set(x[level]), set(y[level])
    if not p or not q:
        return 0.0
    # a sketch shorter than k is its whole set; else the k smallest names of the union all lie in the two sketches
    union = sorted(p | q)[:k if max(len(p), len(q)) == k else None]
    return sum(u in p and u in q for u in union) / len(union)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


OUT = [("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()),
       ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64())]


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of each whole text, without any shuffle. A null text counts as empty (fingerprint '-')."""
    source = docs.select(key, docs[text].alias("_text"))

    def run(batches):
        for b in batches:
            prints = []
            for group in _groups(v.as_py() or "" for v in b.column("_text")):
                prints += map(sketch, phrases(group))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(prints, pa.string())], names=[key, "fingerprint"])

    return source.mapInArrow(run, T.StructType([source.schema[key], T.StructField("fingerprint", T.StringType())]))


def _groups(texts):
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= BATCH:
            yield group
            group, n = [], 0
    if group:
        yield group


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, where the
    edited text borrows from the next document by descending key (after the last: the first).

    Null texts count as empty, null keys follow all others, rows with one key follow by text; repeated rows each return.
    Other columns are not read. Texts are shuffled once: the keys alone are sorted first to find where each part begins
    (one key a part reaches the driver), then texts go to their part, the first document of a part also to the part
    before it, and every task reads its part in order, two documents at a time."""
    spark = docs.sparkSession
    kind = docs.schema[key]
    source = docs.select(F.coalesce(F.col(key), F.lit(-2 ** 63)).cast("long").alias("_k"), F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = partitions(spark)

    def top(batches):
        best = [max(b.column("_k").to_pylist()) for b in batches if b.num_rows]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([max(best)], pa.int64())], names=["_k"])

    firsts = sorted({r[0] for r in source.select("_k").repartitionByRange(n, F.col("_k").desc()).mapInArrow(top, "_k long").collect()}, reverse=True)
    schema = T.StructType([kind, *(T.StructField(c, t) for c, t, _ in OUT)])
    if not firsts:
        return spark.createDataFrame([], schema)
    falling = -np.array(firsts, dtype=object)       # Python integers: -(-2 ** 63) has no place in 64 bits
    parts = len(firsts)

    @F.pandas_udf("array<int>")
    def places(keys):
        import pandas as pd
        first = {k: (i - 1) % parts for i, k in enumerate(firsts)}
        found = np.searchsorted(falling, [-int(k) for k in keys], side="right") - 1
        return pd.Series([[int(i), parts + first[int(k)]] if int(k) in first else [int(i)] for i, k in zip(found, keys)])

    dealt = (source.withColumn("_place", F.explode(places("_k")))
             .withColumn("_tail", F.col("_place") >= parts).withColumn("_part", F.col("_place") % parts)
             .repartitionById(parts, F.col("_part")).sortWithinPartitions("_tail", F.col("_k").desc(), "_text")
             .select(key, "_text", "_tail"))

    def run(batches):
        ids, texts = [], []
        names = [kind.name, *(c for c, _, _ in OUT)]

        def close(ids, texts, after):
            """Rows of texts; after: the text that follows the last one."""
            both = [edited(t, u) for t, u in zip(texts, [*texts[1:], after])]
            own, new = [sketch(s) for s in phrases([*texts, after])], [sketch(s) for s in phrases(both)]
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in both]
            cols = [[len(t) for t in texts], sha, own[:-1], new, [likeness(a, b) for a, b in zip(own, new)], [likeness(a, b) for a, b in zip(own, own[1:])]]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, (_, _, t) in zip(cols, OUT))], names=names)

        done = False
        for b in batches:
            id_type = b.schema.field(kind.name).type
            for i, t, tail in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if done:
                    break
                t = t.as_py()
                if texts and (tail or sum(map(len, texts)) >= BATCH):
                    yield close(ids, texts, t)
                    ids, texts = [], []
                done = tail
                if not tail:
                    ids.append(i)
                    texts.append(t)

    return dealt.mapInArrow(run, schema)
