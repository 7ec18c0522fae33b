"""Near-duplicate embeddings by spherical-cap filters."""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import components, partitions, written
from framelake.llm.simhash import forest

#: Independent product codes, blocks of each, members a filter should have by chance, and filters that a pair at the threshold
#: should share over all codes. With one code, whole clusters can lie where few codeword sums reach; several even that out.
CODES, BLOCKS, MEMBERS, SHARED = 8, 2, 64, 10.0
SEED = 11
#: Vectors of one filter that are compared at once.
TILE = 1024
#: Room for rounding: pairs whose computed cosine is this close to the threshold are computed once more, exactly rounded.
EDGE = 1e-12


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def both_exceed(z: float, rho: float) -> float:
    """Probability that two standard normal values with correlation rho both exceed z."""
    x = np.linspace(z, z + 8, 4001)
    rest = np.array([_tail((z - rho * v) / math.sqrt(1 - rho * rho)) if rho < 1 else 1.0 for v in x])
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * rest
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


def filter_size(n: int, threshold: float) -> tuple[float, int]:
    """(cap height z, codewords per block) for n vectors: the height leaves about MEMBERS vectors in a filter, and there are
    so many filters (CODES times codewords to the power of BLOCKS) that a pair at the threshold shares SHARED on average."""
    share = min(0.05, MEMBERS / max(n, 1))
    low, high = 1.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid) > share else (low, mid)
    z = (low + high) / 2
    return z, max(4, math.ceil((SHARED / CODES / both_exceed(z, threshold)) ** (1 / BLOCKS)))


@lru_cache(4 * CODES)
def product_code(dim: int, words: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, code of each block): the same in every task. Codewords are standard normal, so the sum of a unit vector's
    block products with one codeword a block is standard normal too."""
    rng = np.random.default_rng([SEED, dim, words, number])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    cuts = np.linspace(0, dim, BLOCKS + 1).astype(int)
    return rotation, [rng.normal(size=(b - a, words)) for a, b in zip(cuts, cuts[1:])]


def list_decode(x: np.ndarray, z: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of every filter direction, a codeword of each block of a code, whose products with the vector sum to z
    or more.

    Block by block: a partial choice lives on only while the best codewords of the blocks to come can still lift it to z,
    so only a small part of the product is ever looked at."""
    rows, names = [], []
    for number in range(CODES):
        rotation, code = product_code(x.shape[1], words, number)
        turned = x @ rotation
        cuts = np.cumsum([0, *(len(c) for c in code)])
        products = [turned[:, a:b] @ c for a, b, c in zip(cuts, cuts[1:], code)]
        best = np.array([p.max(axis=1) if p.shape[1] else 0 for p in products])
        row, name, total = np.arange(len(x)), np.full(len(x), number), np.zeros(len(x))
        for k, p in enumerate(products):
            need = z - best[k + 1:].sum(axis=0)
            out = []
            for i in range(0, len(row), 4096):
                r = row[i:i + 4096]
                a, c = np.nonzero(total[i:i + 4096, None] + p[r] >= need[r][:, None])
                out.append((r[a], name[i:i + 4096][a] * words + c, total[i:i + 4096][a] + p[r[a], c]))
            row, name, total = (np.concatenate(v) for v in zip(*out)) if out else (row, name, total)
        rows.append(row)
        names.append(name)
    return np.concatenate(rows), np.concatenate(names)


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _pairs(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs whose cosine in double precision reaches the threshold."""
    c = a @ b.T
    i, j = np.nonzero(c >= threshold - EDGE)
    close = np.abs(c[i, j] - threshold) <= EDGE
    for k in np.flatnonzero(close).tolist():
        x, y = raw_a[i[k]], raw_b[j[k]]
        dot, xx, yy = (math.fsum(p * q for p, q in zip(u, v)) for u, v in ((x, y), (x, x), (y, y)))
        close[k] = dot / math.sqrt(xx * yy) < threshold
    return i[~close], j[~close]


class _Tile:
    """Vectors of one filter: ids, copies, values, and their filter lists one after another with the length of each."""

    def __init__(self, ids, copies, raw, filters, lengths):
        self.ids, self.copies, self.raw, self.filters, self.lengths = ids, copies, raw, filters, lengths
        self.unit = _unit(raw)

    def parts(self):
        return self.ids, self.copies, self.raw, self.filters, self.lengths

    def before(self, own: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of the filters before `own` of some rows."""
        row = np.repeat(np.arange(len(self.ids)), self.lengths)
        keep = (self.filters < own) & np.isin(row, rows)
        return row[keep], self.filters[keep]


def _join(tiles: list) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*tiles))


def _counted_before(own: int, a: _Tile, b: _Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True for the pairs (i, j) that share a filter before `own`: every pair counts in the first of its filters only."""
    (ra, fa), (rb, fb) = a.before(own, i), b.before(own, j)
    common = np.intersect1d(fa, fb)
    out = np.zeros((len(a.ids), len(b.ids)), dtype=bool)
    for k in range(0, len(common), 2048):
        some = common[k:k + 2048]
        x, y = (np.zeros((n, len(some)), dtype=np.float32) for n in out.shape)
        for r, f, m in ((ra, fa, x), (rb, fb, y)):
            at = np.minimum(np.searchsorted(some, f), len(some) - 1)
            hit = some[at] == f
            m[r[hit], at[hit]] = 1
        out |= x @ y.T > 0.5
    return out[i, j]


def _compare(own: int, a: _Tile, b: _Tile | None, threshold: float) -> tuple[np.ndarray, ...]:
    """(ids, links, edges from, edges to) of a tile with itself or with another one."""
    same, b = b is None, b or a
    i, j = _pairs(a.unit, b.unit, a.raw, b.raw, threshold)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    if not len(i):
        return (np.zeros(0, np.int64),) * 4
    keep = ~_counted_before(own, a, b, i, j)
    i, j = i[keep], j[keep]
    links = [(a.ids, np.bincount(i, weights=b.copies[j], minlength=len(a.ids))), (b.ids, np.bincount(j, weights=a.copies[i], minlength=len(b.ids)))]
    nodes = a.ids if same else np.concatenate([a.ids, b.ids])
    f, t = forest(nodes, i, j if same else j + len(a.ids))
    ids, n = _join(links)
    return ids[n > 0], n[n > 0].astype(np.int64), f, t


PARTS = ["ids", "copies", "raw", "filters", "lengths"]
NAMES = ["kind", "a", "b", "filter", "tile", *PARTS]
FOUND = "kind string, a long, b long, filter long, tile int, " + ", ".join(f"{c} binary" for c in PARTS)


def _rows(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), *[pa.binary()] * len(PARTS))]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *empty], names=NAMES)


def _tile_row(own: int, number: int, t: _Tile) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(["tile"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([own], pa.int64()), pa.array([number], pa.int32()),
        *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in t.parts())], names=NAMES)


def _tile_of(row: dict, suffix: str) -> _Tile:
    ids, copies, raw, filters, lengths = (np.frombuffer(row[c + suffix], np.float64 if c == "raw" else np.int64) for c in PARTS)
    return _Tile(ids, copies, raw.reshape(len(ids), -1), filters, lengths)


def similar_vectors(distinct: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links among distinct vectors (id, copies, vector): rows ('links', id, number of other vectors linked) and
    ('edge', id, id), the latter connecting what all links connect with at most one edge per vector and tile.

    Every vector goes to each filter that it exceeds, together with the list of its filters; a pair that shares several is
    counted in the first only. A task reads its filters in sorted runs and compares one tile of TILE vectors at a time;
    pairs of tiles of a larger filter are dealt out to all tasks, so that no filter is one task's work."""
    z, words = filter_size(n, threshold)
    spark = distinct.sparkSession
    parts = partitions(spark)

    def assign(batches):
        for b in batches:
            ids, copies, vectors = b.column("id").to_numpy(), b.column("copies").to_numpy(), b.column("vector")
            sizes = np.array([len(v) for v in vectors], dtype=np.int64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                some = vectors.take(pa.array(at))
                x = _unit(some.flatten().to_numpy().astype(np.float64).reshape(-1, dim))
                for i in range(0, len(at), 512):
                    row, name = list_decode(x[i:i + 512], z, words)
                    order = np.lexsort((name, row))
                    row, name = row[order], name[order]
                    own = name + dim * CODES * words ** BLOCKS            # vectors of other lengths have filters of their own
                    count = np.bincount(row, minlength=len(x[i:i + 512]))
                    offsets = np.append(0, np.cumsum(count))
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[at[i:i + 512]][row]), pa.array(copies[at[i:i + 512]][row]),
                                                      some.slice(i, 512).take(take), lists.take(take)], names=["filter", "id", "copies", "vector", "lists"])

    kind = distinct.schema["vector"].dataType.simpleString()
    dealt = (distinct.select("id", "copies", "vector").mapInArrow(assign, f"filter long, id long, copies long, vector {kind}, lists array<long>")
             .repartition(parts, "filter").sortWithinPartitions("filter", "id"))

    def scan(batches):
        own, number, held, size = None, 0, [], 0            # the filter being read, its tiles so far, its rows not yet in a tile
        ids, counts, edges = [], [], []

        def close():
            """Compares the rows held as one tile; returns it."""
            t = _Tile(*_join(held))
            i, n, f, g = _compare(own, t, None, threshold)
            if len(i):
                ids.append(i), counts.append(n), edges.append((f, g))
            return t

        def flush(least: int):
            if sum(map(len, ids)) >= least:
                i, where = np.unique(np.concatenate(ids), return_inverse=True)
                yield _rows("links", i, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64))
                yield _rows("edge", *_join(edges))
                ids.clear(), counts.clear(), edges.clear()

        def ended():
            if own is not None and (size > 1 or number and size):
                t = close()
                if number:
                    yield _tile_row(own, number, t)

        for b in batches:
            name, id_, copies = (b.column(k).to_numpy() for k in range(3))
            vectors, lists = b.column(3), b.column(4)
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            to, filters = lists.offsets.to_numpy(), lists.values.to_numpy()
            cut = np.flatnonzero(name[1:] != name[:-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(name)]):
                if s == e:
                    continue
                if name[s] != own:
                    yield from ended()
                    own, number, held, size = int(name[s]), 0, [], 0
                while s < e:
                    if size == TILE:
                        yield _tile_row(own, number, close())
                        number, held, size = number + 1, [], 0
                    stop = min(e, s + TILE - size)
                    held.append((id_[s:stop], copies[s:stop], flat[at[s]:at[stop]].reshape(stop - s, -1).astype(np.float64), filters[to[s]:to[stop]], np.diff(to[s:stop + 1]).astype(np.int64)))
                    size, s = size + stop - s, stop
            yield from flush(50_000)
        yield from ended()
        yield from flush(1)

    found = written(dealt.mapInArrow(scan, FOUND), "filtered")
    tiles = found.where("kind = 'tile'").select("filter", "tile", *PARTS)
    other = tiles.select("filter", *(F.col(c).alias(f"{c}2") for c in ("tile", *PARTS)))

    def cross(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, n, f, g = _compare(r["filter"], _tile_of(r, ""), _tile_of(r, "2"), threshold)
                yield _rows("links", ids, n)
                yield _rows("edge", f, g)

    pairs = tiles.join(other, "filter").where("tile < tile2").repartition(parts, "filter", "tile", "tile2").mapInArrow(cross, FOUND)
    return found.where("kind <> 'tile'").select("kind", "a", "b").unionAll(pairs.select("kind", "a", "b"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id (smallest key reached, its own
    included) and kept (key = component_id).

    Linked are pairs that share a filter and whose cosine, in double precision, reaches the threshold; no other pair is.
    Pairs at the threshold share SHARED filters on average, closer ones more. Vectors that are null, empty, zero, hold null
    or non-finite components or whose squares overflow link with nothing; vectors of different lengths neither. Equal vectors are one row from
    the start (their copies link with each other and with all that any of them links with). Repeated rows each return; a
    null key returns null with the links of its vector and is never kept unless no member of its component has a key, when
    component_id is null and kept false; an empty table gives no rows."""
    v = F.col(vector).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (squares > 0) & (squares < float("inf"))
    rows = vectors.select(F.col(key), F.when(F.coalesce(usable, F.lit(False)), F.transform(F.col(vector), lambda x: x + F.lit(0).cast("tinyint"))).alias("vector"))
    groups = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("copies"), F.min(key).alias("low"))
    distinct = written(groups.withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    found = written(similar_vectors(distinct, n, threshold), "found")
    links = found.where("kind = 'links'").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    comp = components(found.where("kind = 'edge'"), node="id", root="root")
    known = (distinct.join(links, "id", "left").join(comp, "id", "left")
             .select("vector", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    known = written(known, "known")
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lows, "root").select("vector", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    alone = rows.where("vector IS NULL").select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    linked = rows.where("vector IS NOT NULL").join(named, "vector").select(key, "n_links", "component_id")
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
