"""Best-fit packing of token sequences."""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import gives_back, written
from framelake.llm.tokens import PieceEncoder, load_json

#: Pieces that one task ranks at most (on average); the number of ranking groups follows the table.
RANKED_TOGETHER = 500_000
#: Word pieces that a task keeps where workers do not keep theirs.
TASK_PIECES = 100_000


@lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(load_json(path))            # a worker's tasks share what it has learned


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id", keep_pieces: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids, end_id last, cut so that only the first piece may be
    shorter than the capacity. A null text has the end id alone. keep_pieces: workers keep the word pieces they have learned
    for later tasks, which saves time; without it a task keeps TASK_PIECES, freed at its end, which leaves the memory to other stages."""
    source = docs.select(key, docs[text].alias("_text"))
    schema = T.StructType([source.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = _encoder(tokenizer) if keep_pieces else PieceEncoder(load_json(tokenizer), TASK_PIECES)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(enc.encode_column(batch.column("_text"))):
                ids = bytes(own) + last
                at, n = 0, len(ids) // 4
                cut = n % capacity or capacity
                k = 0
                while at < n:
                    part = ids[4 * at:4 * cut]
                    rows.append(i), piece.append(k), start.append(at), length.append(cut - at), crc.append(zlib.crc32(part))
                    at, cut, k = cut, cut + capacity, k + 1
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return source.mapInArrow(run if keep_pieces else gives_back(run), schema)


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go, worked out on counts alone: rows (length, first rank, first bin, bins, pieces
    of this length in each bin, offset of the first of them). At most a few times `capacity` rows, whatever the counts.

    Large-item matching: lengths above a third of the capacity are taken from the longest down; each takes the longest
    partner above a third that still fits, so a bin holds two of them at most. Smaller lengths follow from the longest
    down, each into the smallest gap that takes it; new bins open when no gap does."""
    left = {s: c for s, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)               # ranks given out
    rows, gaps, bins = [], {}, 0                # gaps: room left -> [(first bin, bins)]

    def put(size, first_bin, n, each, offset):
        rows.append((size, used[size], first_bin, n, each, offset))
        used[size] += n * each
        left[size] -= n * each

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((s for s in large if s <= capacity - a and left[s] > (s == a)), 0)
            n = min(left[a], left[b]) if b and b != a else left[a] // 2 if b else left[a]
            put(a, bins, n, 1, 0)
            if b:
                put(b, bins, n, 1, a)
            gaps.setdefault(capacity - a - b, []).append((bins, n))
            bins += n
    for s in sorted((s for s in left if left[s]), reverse=True):
        for room in sorted(g for g in gaps if g >= s):
            fit, spans = room // s, gaps.pop(room)
            while spans and left[s]:
                first, n = spans.pop()
                full = min(n, left[s] // fit)
                if full:
                    put(s, first, full, fit, capacity - room)
                    gaps.setdefault(room - fit * s, []).append((first, full))
                if full < n:
                    rest = left[s]
                    if 0 < rest < fit:
                        put(s, first + full, 1, rest, capacity - room)
                        gaps.setdefault(room - rest * s, []).append((first + full, 1))
                        full += 1
                    if full < n:
                        spans.append((first + full, n - full))
            if spans:
                gaps.setdefault(room, []).extend(spans)
            if not left[s]:
                break
        if left[s]:
            fit = capacity // s
            full, rest = divmod(left[s], fit)
            if full:
                put(s, bins, full, fit, 0)
                gaps.setdefault(capacity - fit * s, []).append((bins, full))
                bins += full
            if rest:
                put(s, bins, 1, rest, 0)
                gaps.setdefault(capacity - rest * s, []).append((bins, 1))
                bins += 1
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def assign_bins(pieces: DataFrame, capacity: int, key: str = "doc_id", size: str = "length") -> DataFrame:
    """pieces with sequence_id and offset added. Sizes must lie in 1..capacity.

    Only a count per size (at most `capacity` rows) reaches the driver, and only the plan made of it travels to the tasks.
    Every piece finds its place from its rank among the pieces of its size. Ranks are given within (size, salt) groups and
    moved by the counts of the salts before, so a size that most pieces have is not one task. Repeated rows are ranked one
    by one and all stay; pieces must be a stored table, since it is read twice."""
    # the salt is a hash of key and piece, so equal rows of a table read again fall into the same group
    total = pieces.count()
    salts = max(1, -(-total // RANKED_TOGETHER)) * 8
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy(size, "_salt").agg(F.count("*").alias("_n"))
    by_size = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("_n")).collect()}
    plan = plan_bins(by_size, capacity)
    before = counts.select(size, "_salt", (F.sum("_n").over(Window.partitionBy(size).orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = (salted.withColumn("_r", F.row_number().over(Window.partitionBy(size, "_salt").orderBy(key, "piece")) - 1)
              .join(before, [size, "_salt"]).withColumn("_r", F.col("_r") + F.col("_before")))
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    base = 1 + int(max(by_size.values(), default=0))
    if capacity * base >= 2 ** 62:
        raise ValueError("too many pieces for 64-bit places")
    places = plan[:, 0] * base + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        p = plan[np.searchsorted(places, length * base + rank, side="right") - 1]
        k = rank - p[:, 1]
        return pd.DataFrame({"sequence_id": p[:, 2] + k // p[:, 4], "offset": p[:, 5] + k % p[:, 4] * length})

    return ranked.withColumn("_p", place(F.col(size), F.col("_r"))).select(*pieces.columns, "_p.*")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id", keep_pieces: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; see token_pieces, plan_bins and assign_bins.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece with the end id
    alone; texts of any length are encoded whole; a null key stays null; repeated rows are packed as often as they occur;
    an empty table gives no rows; columns other than key and text are not read. Texts are tokenised once: the pieces are
    written to the shared folder (five numbers each) before they are counted."""
    return assign_bins(written(token_pieces(docs, tokenizer, capacity, end_id, text, key, keep_pieces), "pieces"), capacity, key)
