"""SimHash fingerprints and their near-duplicate components by the generalised pigeonhole principle."""
from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.collocations import marked
from framelake.llm.common import components, gives_back, partitions, written

SEED, SHINGLE = 42, 4
#: Fingerprints of one bucket that are compared at once; larger buckets are cut into tiles of this size.
TILE = 8192
#: MinHash values and bits of a shingle set, values in a band, and how probable it may be, for each of the three conditions of
#: a candidate, that a pair at the stated similarity fails it.
MINHASHES, ROWS, MISS = 128, 3, 1e-6
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, MINHASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD, _BIT = _MIX[0], _MIX[1]
#: SimHash bits in which texts may differ that are candidates whatever their MinHash values.
MAX_BITS = 4
#: Shingle sets compared at once, and shingles in them; sets of a larger candidate component that every tile of it sees; rows of a
#: few numbers that may travel to every task.
SET_TILE, SET_SHINGLES, LEADERS, SMALL = 1024, 1 << 22, 8, 200_000
#: Costs of the plan in seconds: one row through a shuffle and into a task, one comparison inside a task.
ROW_COST, PAIR_COST = 2e-6, 2e-9


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of `size` words, in order, repeats included: none without a word, one of a shorter text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()      # bytes: A-Z only, ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - size + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())), dtype=np.uint64, count=n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of 64 bits: a bit is 1 if it is set in over half the hashes of all shingles of `size` words, repeats included. Zero
    without a word."""
    return simhash(shingles(text, size))


def simhash(h: np.ndarray) -> int:
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[i:i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprint_column(text: str):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x) for x in texts), dtype=np.uint64, count=len(texts)).view(np.int64))
    return fp(F.col(text))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long. A null text has no words, as an empty one."""
    return docs.select(key, fingerprint_column(text).alias("fp"))


# --- the plan: correlated bits together, thresholds by dynamic programming ---------------------------------------------

def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are set; summed by Spark, 2,080 numbers reach the driver."""
    def count(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column("fp").to_numpy().astype(np.int64)).astype(np.float32)
            for i in range(0, len(x), 1 << 16):
                total += x[i:i + (1 << 16)].T @ x[i:i + (1 << 16)]
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64))], names=["ij", "n"])
    out = np.zeros((64, 64))
    for ij, n in fps.select("fp").mapInArrow(gives_back(count), "ij long, n long").groupBy("ij").agg(F.sum("n")).collect():
        out[ij // 64, ij % 64] = out[ij % 64, ij // 64] = n
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64, bit 0 (lowest) first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(both: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(p * (1 - p))
    scale = np.outer(sd, sd)
    c = np.divide(both / max(n, 1) - np.outer(p, p), scale, out=np.zeros((64, 64)), where=scale > 0)
    return np.abs(c), p


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows from the most correlated free bit by the bit closest to the group."""
    free, groups = set(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))] if size else []
        free -= {*group}
        while len(group) < size:
            b = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def agreement(bits: list[int], corr: np.ndarray, p: np.ndarray, most: int) -> list[float]:
    """Estimated shares of pairs whose bits of this group differ in at most 0, 1, ... `most` places: bits count as
    independent, and as fewer bits the more they are correlated."""
    n = len(bits)
    off = corr[np.ix_(bits, bits)] ** 2
    mean = (off.sum() - np.trace(off)) / max(n * (n - 1), 1)
    effective = max(1, round(n / (1 + (n - 1) * mean)))
    differ = float(np.clip(np.mean(2 * p[bits] * (1 - p[bits])), 1e-9, 0.5))
    return [min(1.0, sum(comb(effective, k) * differ ** k * (1 - differ) ** (effective - k) for k in range(t + 1))) for t in range(most + 1)]


def allocate(n: int, corr: np.ndarray, p: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed. Two fingerprints within tau agree within its threshold in at least
    one group whenever the thresholds (-1: not probed) sum to tau - m + 1. For every m, dynamic programming spreads that
    sum so that rows sent plus estimated candidate comparisons cost least; the cheapest m is taken."""
    best = None
    for m in range(1, tau + 3):
        groups = group_bits(corr, m)
        if max(map(len, groups)) > 56:
            continue
        costs = []
        for g in groups:
            share = agreement(g, corr, p, tau)
            costs.append({-1: 0.0} | {t: n * ROW_COST * (1 + (t > 0) * sum(comb(len(g), k) for k in range(t + 1)))
                                      + n * n / 2 * share[t] * (1 + (t > 0)) * PAIR_COST for t in range(tau + 1)})
        state = {0: (0.0, ())}                   # sum of thresholds so far -> (cost, thresholds)
        for c in costs:
            step: dict[int, tuple[float, tuple]] = {}
            for total, (cost, chosen) in state.items():
                for t, more in c.items():
                    new = (cost + more, (*chosen, t))
                    if total + t not in step or new < step[total + t]:
                        step[total + t] = new
            state = step
        found = (*state[tau - m + 1], groups)
        if best is None or found[0] < best[0]:
            best = found
    return [(g, t) for g, t in zip(best[2], best[1]) if t >= 0]


# --- probing and verification ----------------------------------------------------------------------------------------

BOTH, INDEX, PROBE = 0, 1, 2


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, node, fp, more, role): every fingerprint under its own value in each group and, where the threshold is over 0,
    under all values within it."""
    def run(batches):
        for b in batches:
            node, fp, more = b.column("node"), b.column("fp").to_numpy().astype(np.int64), b.column("more")
            bits = _bits(fp).astype(np.int64)
            for k, (group, t) in enumerate(plan):
                own = (bits[:, group] << np.arange(len(group))).sum(axis=1) | (k << 57)
                yield _rows(own, node, fp, more, INDEX if t else BOTH)
                for masks in _masks(len(group), t) if t else ():
                    at = pa.array(np.repeat(np.arange(len(fp)), len(masks)))
                    yield _rows((own[:, None] ^ masks).ravel(), node.take(at), np.repeat(fp, len(masks)), more.take(at), PROBE)
    return fps.select("node", "fp", "more").mapInArrow(gives_back(run), "bucket long, node long, fp long, more binary, role byte")


def _rows(bucket, node, fp, more, role):
    return pa.RecordBatch.from_arrays([pa.array(bucket), node, pa.array(fp), more, pa.array(np.full(len(fp), role, dtype=np.int8))], names=["bucket", "node", "fp", "more", "role"])


def _masks(n: int, t: int):
    """All flips of up to t of n bits, in blocks."""
    block: list[int] = []
    for k in range(t + 1):
        for c in combinations(range(n), k):
            block.append(sum(1 << i for i in c))
            if len(block) == 64:
                yield np.array(block, dtype=np.int64)
                block = []
    if block:
        yield np.array(block, dtype=np.int64)


def _links(a: tuple, b: tuple, tau: int, wide: int | None):
    """Positions of the pairs of a and b (fingerprints, further words) within tau and, over all words, within `wide`, in
    blocks: a tile of near copies has very many."""
    fa, fb = a[0].view(np.uint64), b[0].view(np.uint64)     # of signed values, bitwise_count counts the magnitude's bits
    for i in range(0, len(fa), 64):
        apart = np.bitwise_count(fa[i:i + 64, None] ^ fb[None, :])
        p, q = np.nonzero(apart <= tau)
        if wide is not None and len(p):
            near = np.bitwise_count(a[1][i + p] ^ b[1][q]).sum(axis=1, dtype=np.int64) + apart[p, q] <= wide
            p, q = p[near], q[near]
        yield p + i, q


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i and j: label[x] is the first member of x's component, before and after."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low < high
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        root = np.arange(len(label))
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) among nodes reduced to one edge from each node to the first of its component: at most as many
    edges as nodes, however many links there are."""
    return star(nodes, merge(np.arange(len(nodes)), i, j))


def star(nodes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


FOUND = "a long, b long, bucket long, tile int, nodes binary, fps binary, mores binary, roles binary"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def near_edges(fps: DataFrame, tau: int, wide: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes that connect distinct fingerprints exactly as all links do, without listing all links.
    fps(node, fp, more): fingerprints link within tau bits; with `wide`, also within so many bits over fp and the further
    words in `more`."""
    n = fps.count()
    corr, p = correlation(bit_counts(fps), n)
    return linked(probes(fps, allocate(n, corr, p, tau)), tau, wide)


def linked(rows: DataFrame, tau: int, wide: int | None = None) -> DataFrame:
    """Edges as of near_edges between rows (see probes) that share a bucket.

    Buckets are read in sorted runs, so a task holds one tile of a bucket. A bucket of several tiles is compared tile by
    tile within the task, and hands its tiles on: pairs of tiles are then dealt out to all tasks."""
    spark = rows.sparkSession

    def edges_of(a, b):
        """Forest of the links between the probing rows of one tile and the indexed rows of another (or the same)."""
        # a node may stand in several rows: they are one
        nodes, at = np.unique(np.concatenate([a["node"], b["node"]]), return_inverse=True)
        label = np.arange(len(nodes))
        for one, two, s, t in ((a, b, 0, len(a["node"])), (b, a, len(a["node"]), 0)) if a is not b else ((a, a, 0, 0),):
            probe, index = np.flatnonzero(one["role"] != INDEX), np.flatnonzero(two["role"] != PROBE)
            for x, y in _links((one["fp"][probe], one["more"][probe]), (two["fp"][index], two["more"][index]), tau, wide):
                label = merge(label, at[probe[x] + s], at[index[y] + t])
                if not label.any():                             # all are one already
                    break
        return star(nodes, label)

    def edge_rows(found):
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            k = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 4], names=NAMES)

    def tile_rows(bucket, number, t):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int64()), pa.array([number], pa.int32()),
                                          *(pa.array([np.ascontiguousarray(t[c]).tobytes()], pa.binary()) for c in ("node", "fp", "more", "role"))], names=NAMES)

    def scan(batches):
        own, number, held, size, found = None, 0, [], 0, []

        def close():
            t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            a, b = edges_of(t, t)
            if len(a):
                found.append((a, b))
            return t

        for batch in batches:
            bucket, node, fp, role = (batch.column(c).to_numpy() for c in ("bucket", "node", "fp", "role"))
            raw = batch.column("more").to_pylist()
            more = np.frombuffer(b"".join(raw), dtype=np.uint64).reshape(len(raw), -1) if raw else np.zeros((0, 0), np.uint64)
            cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                if s < e and bucket[s] != own:
                    if size > 1 or number and size:
                        t = close()
                        if number:
                            yield from tile_rows(own, number, t)
                    own, number, held, size = int(bucket[s]), 0, [], 0
                while s < e:
                    if size == TILE:
                        yield from tile_rows(own, number, close())
                        number, held, size = number + 1, [], 0
                    stop = min(e, s + TILE - size)
                    held.append({"node": node[s:stop], "fp": fp[s:stop], "more": more[s:stop], "role": role[s:stop]})
                    size, s = size + stop - s, stop
            yield from edge_rows(found)
            found = []
        if size > 1 or number and size:
            t = close()
            if number:
                yield from tile_rows(own, number, t)
        yield from edge_rows(found)

    parts = partitions(spark)
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(gives_back(scan), FOUND), "links")
    columns = ("tile", "nodes", "fps", "mores", "roles")
    tiles = found.where("tile IS NOT NULL").select("bucket", *columns)
    other = tiles.select("bucket", *(F.col(c).alias(f"{c}2") for c in columns))

    def cross(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                pair = []
                for s in ("", "2"):
                    node = np.frombuffer(x["nodes" + s], np.int64)
                    pair.append({"node": node, "fp": np.frombuffer(x["fps" + s], np.int64), "more": np.frombuffer(x["mores" + s], np.uint64).reshape(len(node), -1),
                                 "role": np.frombuffer(x["roles" + s], np.int8)})
                a, b = edges_of(*pair)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    pairs = (tiles.join(other, "bucket").where("tile < tile2").repartition(parts, "bucket", "tile", "tile2")
             .mapInArrow(gives_back(cross), "a long, b long"))
    return found.where("a IS NOT NULL").select("a", "b").unionAll(pairs)


def _components(own: DataFrame, key: str, tau: int, wide: int | None) -> DataFrame:
    """(key, fp, more, component_id) of a written table (key, fp, more). Equal fingerprints are one node from the start."""
    distinct = written(own.groupBy("fp", "more").agg(F.min(key).alias("low")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    comp = components(near_edges(distinct, tau, wide), node="node", root="root")
    rooted = written(distinct.join(comp, "node", "left").select("fp", "more", "low", F.coalesce("root", "node").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "more", "component_id")
    return own.join(named, ["fp", "more"])


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every document.

    fingerprint: 16 hex digits (see `fingerprint`). Documents link when their fingerprints differ in at most max_bits
    bits; component_id is the smallest key that a chain of links reaches. Null and empty texts have fingerprint zero and
    link as any other; repeated rows each return; a null key stays null and never names a component unless no member has a
    key; an empty table gives no rows. Equal fingerprints are merged before anything is compared, so copies cost one row."""
    own = written(fingerprints(docs, text, key).withColumn("more", F.lit(b"")), "fingerprints")
    return _components(own, key, max_bits, None).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets: banded MinHash finds candidates, the sets decide ---------------------------------------

def minhashes(distinct: np.ndarray) -> np.ndarray:
    """MINHASHES smallest values of the set under as many multiplications."""
    low = np.full(MINHASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(distinct), 1 << 12):
        low = np.minimum(low, (distinct[i:i + (1 << 12), None] * _ODD).min(axis=0))
    return low


def minhash_bits_at(similarity: float, n: int) -> int:
    """Differing bits of n that a pair of this similarity exceeds with a probability below MISS: a MinHash bit differs with
    probability (1 - similarity) / 2."""
    p, tail = (1 - similarity) / 2, 1.0
    for k in range(n + 1):
        tail -= comb(n, k) * p ** k * (1 - p) ** (n - k)
        if tail < MISS:
            return k
    return n


def bands_at(similarity: float) -> int:
    """Bands of ROWS values that a pair of this similarity all misses with a probability below MISS."""
    return min(MINHASHES // ROWS, max(1, math.ceil(math.log(MISS) / math.log(1 - similarity ** ROWS)))) if similarity < 1 else 1


def similar_sets(sets: list[np.ndarray], similarity: float, bits: np.ndarray, limits: tuple[int, int], cut: int = 0) -> np.ndarray:
    """Labels (the first member's position) of the components of the sets (sorted, without repeats) that link where their
    Jaccard similarity is at least `similarity`. Only candidates are looked at: `bits` (two words a set) differ in at most limits[0]
    bits of the first and limits[1] of both. With `cut`, only pairs of the first `cut` sets and the others."""
    label = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    value, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = np.zeros(len(value), dtype=bool)
    for i in range(cut or len(sets) - 1):
        start = max(cut, i + 1)
        near = (sizes[start:] >= similarity * sizes[i] - 1) & (sizes[start:] * similarity - 1 <= sizes[i]) & (label[start:] != label[i])
        j = np.flatnonzero(near) + start
        if len(j):
            j = j[candidates_of(bits[i], bits[j], limits)]
        if not len(j):
            continue
        mine = flat[ends[i] - sizes[i]:ends[i]]
        own[mine] = True
        at = np.append(0, np.cumsum(sizes[j]))
        both = np.append(0, np.cumsum(own[np.concatenate([flat[ends[x] - sizes[x]:ends[x]] for x in j.tolist()])]))
        both = both[at[1:]] - both[at[:-1]]
        own[mine] = False
        j = j[both / np.maximum(1, sizes[i] + sizes[j] - both) >= similarity]
        if len(j):
            label = merge(label, np.full(len(j), i), j)
    return label


def candidates_of(bits: np.ndarray, others: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    apart = np.bitwise_count(others ^ bits)
    return (apart[:, 0] <= limits[0]) & (apart.sum(axis=1, dtype=np.int64) <= limits[1])


def _with_texts(rows: DataFrame, source: DataFrame) -> DataFrame:
    """rows (a written table) with the _text of their node; source: (node, _text) of all rows of the corpus. Few rows travel to the
    texts. Of more, the nodes are first marked in a filter of bounded size, so that few other texts are shuffled."""
    if rows.limit(SMALL + 1).count() <= SMALL:
        return source.join(F.broadcast(rows), "node")
    return source.where(marked(rows.select("node").distinct(), "node")).join(rows, "node")


def _verified(candidates: DataFrame, nodes: DataFrame, source: DataFrame, similarity: float, shingle: int, limits: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that connect the nodes as all pairs do whose shingle sets have the similarity. candidates(node, root): only
    pairs of one root are compared, and of those only candidates by their bits (see similar_sets).

    A root's nodes are dealt to tiles by hash, bounded by nodes and shingles. Some LEADERS of a root with several tiles are in every
    one of them, so that copies of one text become one component whatever their number. Pairs of different components are
    then looked for in the bits, tile by tile, and only sets that stand in such a pair are shipped once more."""
    parts = partitions(nodes.sparkSession)
    members = written(candidates.join(nodes.select("node", "size", "fp", "more"), "node"), "candidates")
    large = written(members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SET_TILE, F.sum("size") / SET_SHINGLES)).cast("int").alias("tiles")).where("tiles > 1"), "large")
    sent = large if large.limit(SMALL + 1).count() > SMALL else F.broadcast(large)
    placed = members.join(sent, "root", "left").withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int"))
    several = placed.where("tiles IS NOT NULL")
    leaders = (several.groupBy("root", "tiles", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS)).alias("k")).agg(F.min(F.struct("node", "fp", "more", "tile")).alias("s"))
               .select("s.node", "root", "s.fp", "s.more", F.explode(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("s.tile"))).alias("tile")))
    places = written(placed.select("node", "root", "fp", "more", "tile").unionAll(leaders.withColumn("tile", F.col("tile").cast("int"))), "places")
    dealt = _with_texts(places, source).repartition(parts, "root", "tile").sortWithinPartitions("root", "tile")

    def groups(batches, keys):
        """(key, columns of its rows) of rows sorted by keys."""
        own, held = None, []
        names = ["node", "fp", "more", "_text"] + (["side"] if "side" in keys else [])
        for b in batches:
            for *key, row in zip(*(b.column(c).to_pylist() for c in keys if c != "side"), zip(*(b.column(c).to_pylist() for c in names))):
                if key != own:
                    if len(held) > 1:
                        yield held
                    own, held = key, []
                held.append(row)
        if len(held) > 1:
            yield held

    def compare(batches, keys, cut):
        for held in groups(batches, keys):
            node = np.array([r[0] for r in held], dtype=np.int64)
            bits = np.array([(r[1], int.from_bytes(r[2], "little", signed=True)) for r in held], dtype=np.int64).view(np.uint64)
            sets = [np.unique(shingles(r[3], shingle)) for r in held]
            a, b = star(node, similar_sets(sets, similarity, bits, limits, sum(r[4] == 0 for r in held) if cut else 0))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    edges = written(dealt.mapInArrow(gives_back(lambda batches: compare(batches, ["root", "tile"], False)), "a long, b long"), "verified")
    if large.isEmpty():
        return edges
    labelled = several.join(components(edges, node="node", root="label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled.select("root", "tile", "node", "label", "size", "fp", "more"), "labelled")
    mixed = labelled.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("root")
    tiles = written(labelled.join(mixed, "root").groupBy("root", "tile").agg(F.collect_list(F.struct("node", "label", "size", "fp", "more")).alias("rows")), "tiles")

    def apart(batches):
        """Nodes of two tiles that stand in a candidate pair of different components."""
        for batch in batches:
            for x in batch.to_pylist():
                left, right = x["rows"], x["rows2"]
                label, size = (np.array([r[c] for r in right], dtype=np.int64) for c in ("label", "size"))
                bits = lambda rs: np.array([(r["fp"], int.from_bytes(r["more"], "little", signed=True)) for r in rs], dtype=np.int64).view(np.uint64)
                mine, theirs = bits(left), bits(right)
                used, hit = [], np.zeros(len(right), dtype=bool)
                for r, own in zip(left, mine):
                    near = (label != r["label"]) & (size >= similarity * r["size"] - 1) & (size * similarity - 1 <= r["size"]) & candidates_of(own, theirs, limits)
                    if near.any():
                        used.append((r, 0))
                        hit |= near
                used += [(right[i], 1) for i in np.flatnonzero(hit).tolist()]
                k = len(used)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["root"]] * k, pa.int64()), pa.array([x["tile"]] * k, pa.int32()), pa.array([x["tile2"]] * k, pa.int32()), pa.array([s for _, s in used], pa.int32()),
                    *(pa.array([r[c] for r, _ in used], t) for c, t in (("node", pa.int64()), ("fp", pa.int64()), ("more", pa.binary())))], names=names)

    names = ["root", "tile", "tile2", "side", "node", "fp", "more"]
    pairs = (tiles.join(tiles.select("root", F.col("tile").alias("tile2"), F.col("rows").alias("rows2")), "root").where("tile < tile2")
             .repartition(parts, "root", "tile", "tile2").mapInArrow(gives_back(apart), "root long, tile int, tile2 int, side int, node long, fp long, more binary"))
    keys = ["root", "tile", "tile2", "side"]
    cross = _with_texts(written(pairs, "apart"), source).repartition(parts, *keys[:3]).sortWithinPartitions(*keys)
    return edges.unionAll(cross.mapInArrow(gives_back(lambda batches: compare(batches, keys, True)), "a long, b long"))


def _similar(rows: DataFrame, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """(_row, key, digest, root) of a written table whose _row numbers the rows: rows with one root are one component."""
    n_bands = bands_at(similarity)
    source = rows.select("_row", key, rows[text].alias("_text"))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("_text"):
                every = shingles(t.as_py(), shingle)
                distinct = np.unique(every)
                low = minhashes(distinct)
                bits = np.packbits((low * _BIT >> np.uint64(63)).astype(np.uint8), bitorder="little").view(np.int64)
                bands = low[:n_bands * ROWS].reshape(n_bands, ROWS)
                own = [int(xxhash.xxh64_intdigest(v.tobytes(), k) & (1 << 63) - 1) for k, v in enumerate(bands)]
                out.append((xxhash.xxh3_128_digest(distinct.tobytes()), len(distinct), int(bits[0]), bits[1:].tobytes(), own, int(np.uint64(simhash(every)).view(np.int64))))
            digest, size, fp, more, own, print_ = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column(key), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(more, pa.binary()),
                                              pa.array(own, pa.list_(pa.int64())), pa.array(print_, pa.int64())], names=["_row", key, "digest", "size", "fp", "more", "bands", "simhash"])

    schema = T.StructType([T.StructField("_row", T.LongType()), rows.schema[key], *(T.StructField(c, t) for c, t in (
        ("digest", T.BinaryType()), ("size", T.LongType()), ("fp", T.LongType()), ("more", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("simhash", T.LongType())))])
    own = written(source.mapInArrow(gives_back(run), schema), "prints")
    # equal sets are one node from the start, named by one of its rows
    nodes = written(own.groupBy("digest").agg(F.min(F.struct("_row", "size", "fp", "more", "bands", "simhash")).alias("s"))
                    .select("digest", F.col("s._row").alias("node"), "s.size", "s.fp", "s.more", "s.bands", "s.simhash"), "distinct")
    buckets = nodes.where("size > 0").select(F.explode("bands").alias("bucket"), "node", "fp", "more", F.lit(BOTH).cast("byte").alias("role"))
    limits = minhash_bits_at(similarity, 64), minhash_bits_at(similarity, MINHASHES)
    near = near_edges(nodes.where("size > 0").select("node", F.col("simhash").alias("fp"), F.lit(b"").alias("more")), MAX_BITS)
    candidates = components(near.unionAll(linked(buckets, *limits)), node="node", root="root")
    edges = _verified(candidates, nodes, source.select(F.col("_row").alias("node"), "_text"), similarity, shingle, limits)
    comp = components(edges, node="node", root="root")
    rooted = written(nodes.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "rooted")
    return written(own.select("_row", key, "digest").join(rooted, "digest"), "similar")


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with _row, a number of each row: the key where it is a whole number that no two rows share, else one of a written table."""
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        ids = docs.agg(F.count("*").alias("n"), F.count(key).alias("with_key")).first()
        if ids.n == ids.with_key and docs.groupBy(key).count().where("count > 1").isEmpty():
            return docs.withColumn("_row", F.col(key).cast("long"))
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) as near_duplicates, by the Jaccard similarity of the sets of word shingles: documents
    link where it is at least `similarity`. fingerprint: 32 hex digits, the digest of the set; a text without a word has the
    empty set. Texts whose SimHash of these shingles differs in at most MAX_BITS bits are candidates, found as in near_duplicates by
    the generalised pigeonhole principle; pairs that SimHash leaves out share a band of MinHash values and differ in few MinHash bits, both set so that a pair at
    `similarity` is missed with a probability below MISS; what is found is decided on the whole sets. Null and empty texts are one
    component; very long texts count whole; docs is read several times and should be a stored table."""
    found = _similar(_numbered(docs.select(key, text), key), similarity, shingle, text, key)
    low = found.groupBy("root").agg(F.min(key).alias("component_id"))
    return found.join(low, "root").select(key, F.lower(F.hex("digest")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without near duplicates (see similar_documents): of each component one row stays, that with the smallest key (rows
    without a key last). Rows are told apart by a number of their own, so rows of one key whose texts don't resemble each
    other all stay. All null and empty texts are alike: one of them stays. An empty table gives no rows. All columns are kept."""
    rows = _numbered(docs, key)
    found = _similar(rows, similarity, shingle, text, key)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("bare"), F.col(key).alias("k"), "_row")).alias("s")).select(F.col("s._row").alias("_row"))
    gone = written(found.select("_row").join(first, "_row", "left_anti"), "gone")
    # only rows that may have to go meet those that have to, which grow with the corpus and are never sent to every task
    may_go = marked(gone, "_row")
    return rows.where(~may_go).unionAll(rows.where(may_go).join(gone.hint("merge"), "_row", "left_anti").select(rows.columns)).drop("_row")
