"""Substring deduplication: repeated windows of words, found by super-k-mer partitioning."""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.collocations import bit_filter, frequent_values, marked, passes
from framelake.llm.common import gives_back, partitions, written

#: Words of a window, and of the short sequences of which the least (by hash) is a window's minimiser.
WINDOW, SHORT = 20, 3
#: Bytes of text that are cut into windows together, and of packed strings that a task gathers before it sends them.
BATCH_BYTES, PACK_BYTES = 1 << 20, 16 << 20
#: Windows aimed at for one bucket: what a task holds when it sorts.
BUCKET_WINDOWS = 2_000_000
#: Bytes of strings whose windows are sorted together; groups of one minimiser stay together.
SORT_BYTES = 2 << 20
_PLACE = np.uint64((1 << 20) - 1)          # low bits of a minimiser's key hold its place in the batch
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _spread(minimiser: np.ndarray) -> np.ndarray:
    return _mix(minimiser * _ODD[4])


class Batch:
    """Some documents as one run of words, and their super-k-mers."""

    def __init__(self, texts: list[bytes]):
        words, counts = [], []
        for t in texts:
            own = t.split()                             # bytes: white space is x20 and x09-x0D only
            words += own
            counts.append(len(own))
        self.joined = b" ".join(words)
        self.counts = np.array(counts, dtype=np.int64)
        first = np.cumsum(self.counts) - self.counts    # of each document
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.hash = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) if words else np.zeros(0, np.uint64)
        self.hash = _mix((self.hash + np.uint64(1)) * _ODD[0])
        n = len(words) - WINDOW + 1
        if n <= 0 or not (self.counts >= WINDOW).any():
            self.at = self.windows = self.doc = self.place = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        short = np.zeros(len(words) - SHORT + 1, dtype=np.uint64)
        for j in range(SHORT):
            short += self.hash[j:len(short) + j] * _ODD[j]
        key = (_mix(short) & ~_PLACE) | np.arange(len(short), dtype=np.uint64)
        # least key of WINDOW - SHORT + 1 neighbours: least of 2, 4, 8 ... of them, then of two runs that cover all
        span, width = WINDOW - SHORT + 1, 1
        while 2 * width <= span:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        if width < span:
            key = np.minimum(key[:n], key[span - width:span - width + n])
        key = key[:n]
        doc = np.repeat(np.arange(len(counts)), self.counts)[:n]
        valid = np.arange(n) + WINDOW <= (first + self.counts)[doc]
        # a super-k-mer: windows of one document in a row whose minimiser is the same occurrence
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        self.at = np.flatnonzero(begin)
        stop = np.append(self.at[1:], n)
        total = np.append(0, np.cumsum(valid))
        self.windows = total[stop] - total[self.at]
        self.minimiser = key[self.at] & ~_PLACE
        self.doc = doc[self.at]
        self.place = self.at - first[self.doc]

    def split(self, hot: np.ndarray) -> None:
        """Super-k-mers of hot minimisers become single windows that are dealt out by the hash of the window itself."""
        if not len(hot) or not len(self.at):
            return
        is_hot = np.isin(self.minimiser, hot)
        if not is_hot.any():
            return
        n = np.where(is_hot, self.windows, 1)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        self.at, self.place, self.doc = self.at[row] + step, self.place[row] + step, self.doc[row]
        self.windows, self.minimiser = np.where(is_hot[row], 1, self.windows[row]), self.minimiser[row]
        alone = np.flatnonzero(is_hot[row])
        value = np.zeros(len(alone), dtype=np.uint64)
        for j in range(WINDOW):
            value = _mix(value * _ODD[1] + self.hash[self.at[alone] + j])
        self.minimiser[alone] = value & ~_PLACE

    def keep(self, known: np.ndarray) -> None:
        """Only super-k-mers whose minimiser heads several."""
        at = np.flatnonzero(passes(known, _spread(self.minimiser)))
        self.at, self.windows, self.minimiser, self.doc, self.place = (x[at] for x in (self.at, self.windows, self.minimiser, self.doc, self.place))

    def strings(self) -> list[bytes]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[self.at].tolist(), self.ends[self.at + self.windows + WINDOW - 2].tolist())]


def _batches(batches, text: str):
    """(record batch, rows from, rows to, texts) of about BATCH_BYTES each."""
    for b in batches:
        group, size, since = [], 0, 0
        column = b.column(text).cast(pa.binary())
        for i, v in enumerate(column):
            t = v.as_py() or b""
            if group and size + len(t) > BATCH_BYTES:
                yield b, since, i, group
                group, size, since = [], 0, i
            group.append(t)
            size += len(t)
        if group:
            yield b, since, b.num_rows, group


def _long(group: list[bytes]):
    """A batch's place bits count a million words. A longer text is cut into stretches that overlap by a window less one word,
    so that every window lies in exactly one; yields (texts, document of each, first word of each)."""
    if sum(map(len, group)) <= 2 * BATCH_BYTES:
        yield group, list(range(len(group))), [0] * len(group)
        return
    for i, t in enumerate(group):
        words = t.split()
        step = 500_000
        for k in range(0, max(1, len(words) - WINDOW + 1), step):
            yield [b" ".join(words[k:k + step + WINDOW - 1])], [i], [k]


def hot_minimisers(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(minimisers that head more than one in 2 P of all super-k-mers, number of windows), P the shuffle partitions.

    Every task counts all of its own and reports those above one in 4 P; such counts are summed by Spark and those still
    above one in 4 P of the total are hot. None above one in 2 P is missed, and there are at most 4 P of them."""
    parts = partitions(docs.sparkSession)

    def count(batches):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        total = windows = held = 0
        for _, _, _, group in _batches(batches, "_text"):
            for texts, _, _ in _long(group):
                b = Batch(texts)
                found.append(np.unique(b.minimiser, return_counts=True))
                total, windows, held = total + len(b.at), windows + int(b.windows.sum()), held + len(found[-1][0])
            if held > 4_000_000:
                found = [_summed(found)]
                held = len(found[0][0])
        if total:
            value, n = _summed(found)
            keep = n * 4 * parts >= total
            value, n = np.append(value[keep].view(np.int64), [0, 0]), np.append(n[keep], [total, windows])
            kind = np.append(np.zeros(keep.sum(), np.int8), [1, 2]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value), pa.array(n)], names=["kind", "value", "n"])

    sums = docs.select(docs[text].alias("_text")).mapInArrow(gives_back(count), "kind byte, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    sums = written(sums, "minimisers")
    totals = {r.kind: r.n for r in sums.where("kind > 0").collect()}
    rows = sums.where((F.col("kind") == 0) & (F.col("n") * 4 * parts >= totals.get(1, 0))).select("value").collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.int64).view(np.uint64), totals.get(2, 0)


def repeated_minimisers(source: DataFrame, buckets: int) -> DataFrame:
    """(fp): of every minimiser that heads two or more super-k-mers. A window that stands in two places has one minimiser in both, and
    they lie in two super-k-mers; so what a single minimiser heads can't hold a repeat and need not travel."""
    def values(batches):
        for _, _, _, group in _batches(batches, "_text"):
            for texts, _, _ in _long(group):
                yield _spread(Batch(texts).minimiser)
    return written(frequent_values(source.select("_text"), values, 2, buckets), "repeated")


def _summed(found):
    value, where = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    return value, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)


class Packs:
    """Super-k-mers on their way to their buckets: each distinct string once, with its earliest place among those gathered. At the
    later ones all its windows are repeats whatever other tasks hold, so these leave as stretches of their documents, and no
    string, however common, brings a bucket more than one place a pack."""

    def __init__(self, buckets: int, parts: int):
        self.buckets, self.parts, self.size = buckets, parts, 0
        self.index: dict[bytes, int] = {}
        self.mark: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: Batch, doc: np.ndarray, row: np.ndarray, since: np.ndarray) -> None:
        index = self.index
        before = len(index)
        which = np.fromiter((index.setdefault(s, len(index)) for s in batch.strings()), dtype=np.int64, count=len(batch.at))
        # strings seen for the first time, in order: their minimisers
        _, first = np.unique(which, return_index=True)
        self.mark.append(batch.minimiser[first[which[first] >= before]])
        place = batch.place + since[batch.doc]
        self.rows.append((which, doc[batch.doc], row[batch.doc], place, place + batch.windows + WINDOW - 1))
        self.size += int(batch.ends[batch.at + batch.windows + WINDOW - 2].sum() - batch.starts[batch.at].sum()) if len(batch.at) else 0

    def flush(self):
        """(bucket, part, pack) rows: strings of a bucket (part -1), or stretches of the documents of a part."""
        if not self.index:
            return
        strings, mark = list(self.index), np.concatenate(self.mark)
        which, doc, row, place, stop = (np.concatenate(x) for x in zip(*self.rows))
        self.index, self.mark, self.rows, self.size = {}, [], [], 0
        order = np.lexsort((place, row, doc, which))
        which, doc, row, place, stop = which[order], doc[order], row[order], place[order], stop[order]
        first, later = _earliest(which, doc, row, place)
        part, packs = _dealt(doc[later], row[later], place[later], stop[later], self.parts)
        yield pa.RecordBatch.from_arrays([pa.array(part % self.buckets), pa.array(part), pa.array(packs, pa.binary())], names=["bucket", "part", "pack"])
        doc, row, place = doc[first], row[first], place[first]          # one of each string, in order
        bucket = (_mix(mark * _ODD[2]) >> np.uint64(11)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        used, at = np.unique(bucket[order], return_index=True)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        packs = []
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            own = order[s:e]
            body = b"\n".join([strings[k] for k in own.tolist()])
            packs.append(squeeze(b"".join([struct.pack("<qq", e - s, len(body)), body, (mark[own] >> np.uint64(32)).astype("<u4").tobytes(),
                                           doc[own].astype("<i8").tobytes(), row[own].astype("<i8").tobytes(), place[own].astype("<i4").tobytes()])))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), -1, np.int32)), pa.array(packs, pa.binary())],
                                         names=["bucket", "part", "pack"])


def _earliest(which: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in order of string and place: (the first of each string as a mask, positions of the others). The very same place
    again (a row read twice) is neither."""
    first = np.append(True, which[1:] != which[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(which)), 0))
    return first, np.flatnonzero(~first & ((doc != doc[lead]) | (row != row[lead]) | (place != place[lead])))


def _united(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches in order of (doc, row, first); of one document those that overlap or touch are one."""
    order = np.lexsort((first, row, doc))
    doc, row, first, stop = doc[order], row[order], first[order], stop[order]
    if not len(doc):
        return doc, row, first, stop
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
    # the furthest end so far in the document: counted on by document, so that earlier documents lie below
    owner, span = np.cumsum(new) - 1, int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + owner * span) - owner * span
    at = np.flatnonzero(new | np.append(True, first[1:] > reach[:-1]))
    return doc[at], row[at], first[at], reach[np.append(at[1:], len(doc)) - 1]


def _dealt(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """(part, packed stretches of its documents), each part once."""
    found = np.stack([x.astype(np.int64) for x in _united(doc, row, first, stop)])
    part = (_mix(_mix(found[0].view(np.uint64) * _ODD[3]) + found[1].view(np.uint64)) >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, part = found[:, order], part[order]
    used, at = np.unique(part, return_index=True)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return used.astype(np.int32), [squeeze(np.ascontiguousarray(found[:, i:j]).tobytes()) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(part)])]


def _unpack(raw: bytes):
    n, size = struct.unpack_from("<qq", raw)
    at = 16 + size
    return (raw[16:at].split(b"\n"), np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, "<i8", n, at + 4 * n),
            np.frombuffer(raw, "<i8", n, at + 12 * n), np.frombuffer(raw, "<i4", n, at + 20 * n))


def repeated_in_bucket(packs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, row, start, end) in words of every stretch of a bucket's windows that also start earlier.

    Super-k-mers are sorted by minimiser. Of equal strings the earliest occurrence stays and all windows of the others are
    repeats. Where a minimiser has several different strings, their windows are sorted and equal ones compared byte by byte."""
    index: dict[bytes, int] = {}
    marks, parts = [], []
    for p in packs:
        strings, mark, doc, row, place = _unpack(p)
        new = np.fromiter((index.setdefault(s, len(index)) for s in strings), dtype=np.int64, count=len(strings))
        marks.append((new, mark))
        parts.append((new, doc, row, place.astype(np.int64)))
    which, doc, row, place = (np.concatenate(x) for x in zip(*parts))
    strings = list(index)
    del index
    mark = np.zeros(len(strings), dtype=np.uint32)
    for new, m in marks:
        mark[new] = m
    order = np.lexsort((place, row, doc, which))
    which, doc, row, place = which[order], doc[order], row[order], place[order]
    first, later = _earliest(which, doc, row, place)             # every window of a later occurrence is a repeat
    n_words = np.fromiter((s.count(b" ") + 1 for s in strings), dtype=np.int64, count=len(strings))
    out = [(doc[later], row[later], place[later], place[later] + n_words[which[later]])]
    doc, row, place = doc[first], row[first], place[first]          # of the earliest occurrence of each string
    by_mark = np.argsort(mark, kind="stable")
    m = mark[by_mark]
    start = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    size = np.diff(np.append(start, len(m)))
    group, held = [], 0
    for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        own = by_mark[s:s + n]
        group.append(own)
        held += sum(len(strings[i]) for i in own.tolist())
        if held > SORT_BYTES:
            out.append(_repeated_windows(np.concatenate(group), strings, n_words, doc, row, place))
            group, held = [], 0
    if group:
        out.append(_repeated_windows(np.concatenate(group), strings, n_words, doc, row, place))
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeated_windows(own: np.ndarray, strings: list[bytes], n_words: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    joined = b" ".join([strings[i] for i in own.tolist()])
    words = joined.split(b" ")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    h = _mix((np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1)) * _ODD[0])
    windows = n_words[own] - WINDOW + 1
    string = np.repeat(np.arange(len(own)), windows)
    step = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(n_words[own]) - n_words[own])[string] + step      # first word of each window
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(WINDOW):
        value = _mix(value * _ODD[1] + h[at + j])
    d, r, p = doc[own][string], row[own][string], place[own][string] + step
    order = np.lexsort((p, r, d, value))
    v = value[order]
    same = np.append(False, v[1:] == v[:-1])
    run = np.flatnonzero(same & ~np.append(same[1:], False))         # last window of each run of equal hashes
    hit = []
    a, b = starts[at], ends[at + WINDOW - 1]
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
    for e in run.tolist():
        members = order[begin[e]:e + 1].tolist()
        seen: dict[bytes, tuple] = {}                                # equal hashes, yet the words decide
        for i in members:
            where = (d[i], r[i], p[i])
            if seen.setdefault(joined[a[i]:b[i]], where) != where:
                hit.append(i)
    hit = np.array(hit, dtype=np.int64)
    d, r, p = d[hit], r[hit], p[hit]
    # windows in a row become one stretch
    order = np.lexsort((p, r, d))
    d, r, p = d[order], r[order], p[order]
    new = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] - p[:-1] > 1)) if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d))[:len(first)] - 1
    return d[first], r[first], p[first], p[last] + WINDOW


def repeated_stretches(docs: DataFrame, text: str = "text", key: str = "_doc", row: str = "_row") -> DataFrame:
    """(_doc, _row, gone): for each document with any the stretches of words, apart and in order, that windows cover which
    also start earlier, by (_doc, _row, word). Stretches leave a bucket packed by the part their documents belong to, and
    are merged there."""
    hot, windows = hot_minimisers(docs, text)
    parts = partitions(docs.sparkSession)
    buckets = max(parts, -(-windows // BUCKET_WINDOWS))
    source = docs.select(key, row, docs[text].alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated_minimisers(source, buckets)))

    def pack(batches):
        packs = Packs(buckets, parts)
        for b, i, j, group in _batches(batches, "_text"):
            doc, rows = (b.column(c).slice(i, j - i).to_numpy() for c in (0, 1))
            for texts, which, since in _long(group):
                batch = Batch(texts)
                batch.keep(known.value)
                batch.split(hot)
                packs.add(batch, doc[which], rows[which], np.array(since, dtype=np.int64))
                if packs.size > PACK_BYTES:
                    yield from packs.flush()
        yield from packs.flush()

    def find(batches):
        unpack, held = zstandard.ZstdDecompressor().decompress, []
        for b in batches:
            known_part = b.column("part").to_numpy() >= 0
            if known_part.any():                                        # stretches only pass through
                yield b.select(["part", "pack"]).filter(pa.array(known_part))
            held += [unpack(p) for p in b.column("pack").filter(pa.array(~known_part)).to_pylist()]
        if held:
            part, packs = _dealt(*repeated_in_bucket(held), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packs, pa.binary())], names=["part", "pack"])

    def merge(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held = [np.frombuffer(unpack(p), np.int64).reshape(4, -1) for b in batches for p in b.column("pack").to_pylist()]
        if not held:
            return
        doc, row_, first, stop = _united(*np.concatenate(held, axis=1))
        lead = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row_[1:] != row_[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(lead, len(doc))
        for i in range(0, len(lead), 10_000):
            j = min(i + 10_000, len(lead))
            gone = pa.StructArray.from_arrays([pa.array(first[ends[i]:ends[j]]), pa.array(stop[ends[i]:ends[j]])], names=["first", "stop"])
            yield pa.RecordBatch.from_arrays([pa.array(doc[lead[i:j]]), pa.array(row_[lead[i:j]]), pa.ListArray.from_arrays(pa.array(ends[i:j + 1] - ends[i], pa.int32()), gone)],
                                             names=["_doc", "_row", "gone"])

    return (source.mapInArrow(gives_back(pack), "bucket int, part int, pack binary").repartitionById(buckets, F.col("bucket"))
            .mapInArrow(gives_back(find), "part int, pack binary").repartitionById(parts, F.col("part")).select("pack")
            .mapInArrow(gives_back(merge), "_doc long, _row long, gone array<struct<first:bigint,stop:bigint>>"))


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with `text` reduced to its kept words, joined by one space, and n_words and n_removed added.

    Words are what stands between the bytes x20 and x09-x0D, unchanged. A word goes if a window of WINDOW words covers it
    whose words also start earlier: in a document with a smaller key, or earlier in the same one; windows are judged on the
    input. A null text has no words and becomes empty, as an empty one. Rows without a key come after all others; rows
    that share a key (or have none) count as separate documents in the order in which they are stored. All columns stay;
    columns named n_words and n_removed are replaced. An empty table gives no rows.

    Texts are read four times (hot minimisers found, all minimisers counted, windows packed, words removed). Super-k-mers of
    repeated minimisers are shuffled packed, and by key only the texts that may lose words."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    ids = docs.agg(F.count("*").alias("n"), F.count(key).alias("with_key")).first()
    unique = ids.n == ids.with_key and docs.select(key).groupBy(key).count().where("count > 1").isEmpty()
    if unique:
        keyed = docs.select(*kept, F.col(key).cast("long").alias("_doc"), F.lit(0).cast("long").alias("_row"))
    else:
        keyed = written(docs.select(*kept, F.coalesce(F.col(key).cast("long"), F.lit(2 ** 63 - 1)).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    found = written(repeated_stretches(keyed, text).withColumnRenamed("gone", "_gone"), "stretches")
    # only documents that may lose words meet what they lose; that grows with the corpus and is never sent to every task
    hit = marked(found, "_doc", "_row")
    joined = (keyed.where(~hit).select(*kept, F.lit(None).cast(found.schema["_gone"].dataType).alias("_gone"))
              .unionAll(keyed.where(hit).join(found.hint("merge"), ["_doc", "_row"], "left").select(*kept, "_gone")))
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in joined.select(*kept).schema.fields),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for b in batches:
            texts, n_words, n_removed = [], [], []
            for t, gone in zip(b.column(text).cast(pa.binary()), b.column("_gone")):
                words = (t.as_py() or b"").split()
                n = len(words)
                removed = 0
                if gone.is_valid:
                    kept_words, at = [], 0
                    for s, e in zip(gone.values.field("first").to_pylist(), gone.values.field("stop").to_pylist()):
                        kept_words += words[at:s]
                        at = e
                    words = kept_words + words[at:]
                    removed = n - len(words)
                texts.append(b" ".join(words))
                n_words.append(n)
                n_removed.append(removed)
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept, "n_words", "n_removed"])

    return joined.mapInArrow(gives_back(cut), schema)
