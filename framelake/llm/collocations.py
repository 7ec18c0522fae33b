"""Phrase collocations: Rabin-Karp fingerprints of all word sequences, counted by shuffle, verified on the text."""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import gives_back, partitions, written

#: Words of the longest phrase.
LONGEST = 5
#: Bytes of text that are fingerprinted together, and fingerprints and phrases that a task gathers before it sends them.
BATCH_BYTES, HELD, PHRASES = 2 << 20, 4_000_000, 400_000
#: Bytes of text aimed at for one bucket of fingerprints; parts of the shuffle beyond which buckets share one.
BUCKET_BYTES, PARTS = 8 << 20, 20_000
#: Bits of the filter of frequent fingerprints: 16 for each, within these bounds. A full filter lets more pass, never less.
FILTER_BITS = (1 << 16, 1 << 28)
CHUNK = 1 << 19
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_BASE = 0x9E3779B97F4A7C15
_AHEAD = re.compile(rb"(?:[^ \n]*[ \n]+){0,%d}[^ \n]*" % LONGEST)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        own = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(1 << max(16, n.bit_length()), x, dtype=np.uint64)
            p[0] = 1
            own.append(np.multiply.accumulate(p))
        _POWERS[:] = own
    return _POWERS


def polynomial(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rabin-Karp fingerprints of the runs values[start:stop], from prefix sums of one polynomial over all of them."""
    up, down = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * down[:len(values)], out=prefix[1:])
    return (prefix[stop] - prefix[start]) * up[stop]


class Words:
    """The words of some texts, their pieces, and fingerprints of the sequences that start among the first `own` bytes."""

    def __init__(self, text: bytes, own: int, text_ends: np.ndarray, seeds: np.ndarray):
        """text: translated, texts apart by newlines; seeds: of the language of each text."""
        self.text = text
        a = np.frombuffer(text, np.uint8)
        newline = a == 10
        gap = newline | (a == 32)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.cumsum(newline)[self.starts] if len(a) else np.zeros(0, np.int64)
        self.owner = np.searchsorted(text_ends, self.starts, side="right")
        self.seed = seeds[np.minimum(self.owner, len(seeds) - 1)] if len(seeds) else np.zeros(len(self.starts), np.uint64)
        self.n_own = int(np.searchsorted(self.starts, own))
        self.hash = _mix(polynomial(a + np.uint64(1), self.starts, self.ends))

    def sequences(self, k: int, beyond: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every sequence of k words within a piece; `beyond`: of the words seen ahead, too."""
        n = len(self.starts) - k + 1
        n = n if beyond else min(n, self.n_own)
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1:k - 1 + n])
        return at, _mix(polynomial(self.hash, at, at + k) + self.seed[at] + np.uint64(k))

    def ids(self) -> np.ndarray:
        """A number per word, equal for equal words: words of one hash are compared with the first of them byte by byte."""
        _, first, which = np.unique(self.hash, return_index=True, return_inverse=True)
        leader = first[which]
        size = self.ends - self.starts
        same = (size == size[leader]).all()
        if same and len(size):
            a = np.frombuffer(self.text, np.uint8)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = (a[at + np.repeat(self.starts, size)] == a[at + np.repeat(self.starts[leader], size)]).all()
        if not same:
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(self.text[a:b], len(known)) for a, b in zip(self.starts.tolist(), self.ends.tolist())])
        return which

    def phrase(self, at: int, k: int) -> bytes:
        raw = self.text[self.starts[at]:self.ends[at + k - 1]]
        return raw if b"  " not in raw else b" ".join(raw.split())


def texts_of(batches):
    """(Words, languages, language of each text) of about BATCH_BYTES each. Longer texts are cut between words: a stretch sees
    LONGEST words beyond its end, and only sequences that start in it count."""
    def cut(group, codes, langs):
        text = b"\n".join(group).translate(_TABLE)
        ends = np.cumsum([len(t) + 1 for t in group])
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], dtype=np.uint64)[codes]
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > 2 * BATCH_BYTES:
                stop = _AHEAD.match(text, at + BATCH_BYTES).end()
            part = text[at:_AHEAD.match(text, stop).end()]
            yield Words(part, stop - at, ends - at, seeds), langs, codes
            at = stop

    for b in batches:
        group, codes, size = [], [], 0
        names = b.column("_lang").to_pylist()
        langs = sorted(set(names))
        code = {x: i for i, x in enumerate(langs)}
        for lang, value in zip(names, b.column("_text").cast(pa.binary())):
            t = value.as_py() or b""
            if group and size + len(t) > BATCH_BYTES:
                yield from cut(group, np.array(codes), langs)
                group, codes, size = [], [], 0
            group.append(t), codes.append(code[lang])
            size += len(t)
        if group:
            yield from cut(group, np.array(codes), langs)


# --- counting fingerprints ---------------------------------------------------------------------------------------------

class Counts:
    """Fingerprints (their upper 48 bits) and how often they occurred, at most `cap` counted of each."""

    def __init__(self, cap: int):
        self.cap, self.parts, self.held = cap, [], 0

    def add(self, fps: np.ndarray) -> None:
        self.parts.append((fps >> np.uint64(16), None))
        self.held += len(fps)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        raw = [v for v, n in self.parts if n is None]
        done = [p for p in self.parts if p[1] is not None]
        if raw:
            v, n = np.unique(np.concatenate(raw), return_counts=True)
            done.append((v, n))
        v, n = summed(done) if len(done) > 1 else done[0] if done else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [(v, np.minimum(n, self.cap))], len(v)
        return self.parts[0]


def summed(parts):
    v, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return v[new], np.add.reduceat(n, new) if len(v) else n


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low bytes of all numbers, then the next ones: sorted numbers share their high bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return out.view("<u8").ravel()


def frequent_values(docs: DataFrame, values, threshold: int, buckets: int) -> DataFrame:
    """(fp): numbers of 64 bits that values(batches), arrays of them, holds `threshold` times or more, cut to their upper 48 bits:
    others may slip in but none is missing. Tasks send what they counted packed by bucket; a bucket is summed as it is read."""
    parts = min(buckets, PARTS)

    def count(batches):
        counts = Counts(threshold)
        for v in values(batches):
            counts.add(v)
            if counts.held > HELD:
                counts.merged()
                if counts.held > HELD // 2:
                    yield from send(counts)
        yield from send(counts)

    def send(counts):
        v, n = counts.merged()
        counts.parts, counts.held = [], 0
        bucket = (v >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)          # rises with the value
        used, at = np.unique(bucket, return_index=True)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        packs = [squeeze(len(v[i:j]).to_bytes(8, "little") + _planes(v[i:j], 6) + _planes(n[i:j], 4)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(v)])]
        for i in range(0, len(used), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(used[i:i + 1000].astype(np.int64)), pa.array(packs[i:i + 1000], pa.binary())], names=["bucket", "pack"])

    def find(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        own, held, size = None, [], 0

        def close():
            v, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(v[n >= threshold].astype(np.int64))], names=["fp"])

        for b in batches:
            for bucket, pack in zip(b.column("bucket").to_pylist(), b.column("pack")):
                if bucket != own:
                    if held:
                        yield close()
                    own, held, size = bucket, [], 0
                raw = unpack(pack.as_py())
                n = int.from_bytes(raw[:8], "little")
                held.append((_numbers(raw[8:], n, 6), _numbers(raw[8 + 6 * n:], n, 4).astype(np.int64)))
                size += n
                if size > HELD:                                     # many tasks sent the same ones
                    held = [summed(held)]
                    size = len(held[0][0]) // 2
        if held:
            yield close()

    packed = docs.mapInArrow(gives_back(count), "bucket long, pack binary").repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int"))
    return packed.sortWithinPartitions("bucket").mapInArrow(gives_back(find), "fp long")


def frequent(docs: DataFrame, sizes: tuple[int, ...], threshold: int, buckets: int, known=None) -> DataFrame:
    """(fp): fingerprints of sequences of these sizes that occur `threshold` times or more (see frequent_values). With `known`, a
    broadcast filter of the frequent pairs, only sequences whose pairs pass count."""
    def values(batches):
        for words, _, _ in texts_of(batches):
            runs = known_pairs(words, known.value) if known is not None else None
            for k in sizes:
                at, fp = words.sequences(k)
                yield fp if runs is None else fp[runs[at + k - 1] - runs[at] == k - 1]
    return frequent_values(docs, values, threshold, buckets)


def bit_filter(fps: DataFrame) -> np.ndarray:
    """A bit for each fingerprint of a written table, as bytes: 16 bits a fingerprint within FILTER_BITS, so at most 32 MB reach the
    driver, whatever the table holds. Tasks set the bits of their share."""
    n = fps.count()
    bits = min(max(1 << (16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def build(batches):
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("fp").to_numpy() & (bits - 1)
            for c in np.unique(at // CHUNK).tolist():
                chunk = chunks.setdefault(c, np.zeros(CHUNK // 8, np.uint8))
                own = at[at // CHUNK == c] % CHUNK
                np.bitwise_or.at(chunk, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(max(bits, CHUNK) // 8, np.uint8)
    spread = fps.repartition(min(partitions(fps.sparkSession), -(-bits // CHUNK)), F.floor((F.col("fp") % bits) / CHUNK))
    for r in spread.mapInArrow(gives_back(build), "chunk int, bits binary").collect():
        out[r.chunk * CHUNK // 8:(r.chunk + 1) * CHUNK // 8] |= np.frombuffer(r.bits, np.uint8)
    return out[:bits // 8]


def passes(known: np.ndarray, fps: np.ndarray) -> np.ndarray:
    at = (fps >> np.uint64(16)) & np.uint64(8 * len(known) - 1)
    return (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marked(keys: DataFrame, *columns: str):
    """A condition on rows with the same columns as keys: true where they stand in keys, and for few others (see bit_filter). Rows for
    which it is false need not meet keys in a join, so their other columns are not shuffled."""
    hashed = F.shiftrightunsigned(F.xxhash64(*columns), 16)
    known = keys.sparkSession.sparkContext.broadcast(bit_filter(written(keys.select(hashed.alias("fp")), "keys")))

    @F.pandas_udf("boolean")
    def wanted(fp: pd.Series) -> pd.Series:
        return pd.Series(passes(known.value, fp.to_numpy().astype(np.uint64) << np.uint64(16)))

    return wanted(hashed)


def known_pairs(words: Words, known: np.ndarray) -> np.ndarray:
    """How many of the words before each one begin a pair that passes."""
    at, fp = words.sequences(2, beyond=True)
    begins = np.zeros(len(words.starts) + 1, dtype=np.int64)
    begins[at + 1] = passes(known, fp)
    return np.cumsum(begins)


# --- phrases -----------------------------------------------------------------------------------------------------------

def verified_counts(words: Words, k: int, at: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of one occurrence, number of occurrences) of each distinct sequence among those at `at`. Occurrences of one
    fingerprint point to the first of them and are compared with it word by word; if any differs, the words themselves are counted."""
    _, first, which, n = np.unique(fps, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first][which]
    if all((ids[at + j] == ids[lead + j]).all() for j in range(k)) and (words.seed[at] == words.seed[lead]).all():
        return at[first], n
    _, first, n = np.unique(np.stack([words.seed[at].astype(np.int64), *(ids[at + j] for j in range(k))], axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], n


def phrase_counts(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(lang, phrase, n) summed per task: phrases of up to LONGEST words whose fingerprint passes the filter, by their text; with a
    null phrase the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        found: dict[str, dict[bytes | None, int]] = {}

        def send():
            rows = [(lang, p, n) for lang, own in found.items() for p, n in own.items()]
            found.clear()
            for i in range(0, len(rows), 50_000):
                lang, phrase, n = zip(*rows[i:i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        for words, langs, codes in texts_of(batches):
            keep, ids, runs = shared.value, words.ids(), known_pairs(words, shared.value)
            owner = np.minimum(words.owner, len(codes) - 1)
            for c, n in zip(*np.unique(codes[owner[:words.n_own]], return_counts=True)):
                own = found.setdefault(langs[c], {})
                own[None] = own.get(None, 0) + int(n)
            for k in range(1, LONGEST + 1):
                at, fp = words.sequences(k)
                ok = passes(keep, fp)
                if k > 1:
                    ok &= runs[at + k - 1] - runs[at] == k - 1
                first, n = verified_counts(words, k, at[ok], fp[ok], ids)
                for i, c, x in zip(first.tolist(), codes[owner[first]].tolist(), n.tolist()):
                    own, p = found[langs[c]], words.phrase(i, k)
                    own[p] = own.get(p, 0) + x
            if sum(map(len, found.values())) > PHRASES:
                yield from send()
        yield from send()

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, threshold: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, k, a) of all phrases of 1 to LONGEST words with a >= threshold occurrences, and (lang, n).

    Texts are read three times. First the fingerprints of words and pairs are counted; then those of longer sequences all
    of whose pairs are frequent; then the phrases that pass are counted by their text, so that no collision can count."""
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("_lang"), docs[text].alias("_text"))
    size = source.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    short = written(frequent(source, (1, 2), threshold, buckets), "frequent")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(short))
    longer = written(frequent(source, tuple(range(3, LONGEST + 1)), threshold, buckets, shared), "frequent")
    both = written(short.unionAll(longer), "frequent")
    counts = written(phrase_counts(source, bit_filter(both)).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= threshold)), "phrases")
    phrases = counts.where("phrase IS NOT NULL").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "a")
    return phrases, counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, threshold: int = 100, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases of 2 to LONGEST words, best score first.

    Texts are lower-cased (A-Z) and split at marks and line ends into pieces, pieces at spaces and tabs into words; a phrase lies
    within a piece. a: its occurrences (at least threshold), n: all words of the language, l and r: occurrences of the two
    parts at the cut with the lowest score floor(1000 a n / (l r)); ties go to the earliest cut. A phrase that stands inside a
    longer frequent one with as many occurrences is left out. All numbers are exact.

    A null language is `und`, a null text empty; texts of any length count whole; repeated rows count as often as they occur; an
    empty table gives no rows; columns other than text and lang are not read."""
    phrases, totals = frequent_phrases(docs, threshold, text, lang)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    words = F.split("phrase", " ")
    longer = phrases.where("k > 1").withColumn("w", words)
    cuts = (longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right")))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = (cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
              .withColumn("score", F.expr("cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*"))
    at = F.explode(F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(w, i, n), ' '))))"))
    inside = longer.where("k > 2").select("lang", at.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= first)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", exact("score").cast("long").alias("score")))
