"""Sum-of-squares online packing of token sequences."""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelake.llm.tokens import PieceEncoder, load_json

#: Partly filled windows that a task holds (their ids, up to 4 bytes a token); rows gathered before they leave a task.
OPEN_WINDOWS, ROWS = 4096, 20_000


@lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(load_json(path))            # a worker's tasks share what it has learned


class Window:
    __slots__ = ("id", "pieces")

    def __init__(self, id: int):
        self.id, self.pieces = id, []               # pieces: (document, start, ids)


class SquaresPacker:
    """Places items one by one; an item joins the fill level after which the sum of squared counts of partly filled
    windows is least (of equal ones the fullest). Levels that need no padding (powers of two) don't count in the sum.

    The level array holds a count and the windows of each level, so a decision costs one pass over `capacity` numbers,
    however many windows are open. At most `limit` windows are open: beyond that an item is first cut to complete the fullest."""

    def __init__(self, capacity: int, first_id: int = 0, limit: int = OPEN_WINDOWS):
        self.capacity, self.next, self.limit, self.n_open = capacity, first_id, limit, 0
        level = np.arange(capacity + 1)
        self.padded = (level & (level - 1)) != 0
        self.padded[capacity] = False
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.enter = self.padded.astype(np.int64)                           # change of the sum by one more window of a level
        self.leave = np.full(capacity + 1, np.iinfo(np.int64).max // 4)     # and by one less; too dear where there is none
        self.leave[0] = 0
        self.levels: list[list[Window]] = [[] for _ in range(capacity + 1)]
        self.done: list[Window] = []

    def _open(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def _count(self, h: int, change: int) -> None:
        self.count[h] += change
        self.n_open += change
        n = int(self.count[h])
        self.enter[h] = 2 * n + 1 if self.padded[h] else 0
        self.leave[h] = np.iinfo(np.int64).max // 4 if n == 0 else 1 - 2 * n if self.padded[h] else 0

    def level_for(self, size: int) -> int:
        change = self.enter[size:] + self.leave[:self.capacity - size + 1]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _put(self, h: int, doc, start: int, ids: bytes) -> None:
        if h:
            w = self.levels[h].pop()
            self._count(h, -1)
        else:
            w = self._open()
        w.pieces.append((doc, start, ids))
        h += len(ids) // 4
        if h == self.capacity:
            self.done.append(w)
        else:
            self.levels[h].append(w)
            self._count(h, 1)

    def add(self, doc, ids: bytes) -> None:
        """A document: whole windows first, then what is left by the rule."""
        at, n = 0, len(ids) // 4
        while n - at >= self.capacity:
            self._put(0, doc, at, ids[4 * at:4 * (at + self.capacity)])
            at += self.capacity
        while at < n and self.n_open >= self.limit:
            h = int(np.flatnonzero(self.count)[-1])
            k = min(self.capacity - h, n - at)
            self._put(h, doc, at, ids[4 * at:4 * (at + k)])
            at += k
        if at < n:
            self._put(self.level_for(n - at), doc, at, ids[4 * at:])

    def close(self) -> None:
        """Windows still open at a level that needs padding are laid end to end and cut anew: into whole windows, and the
        rest into powers of two."""
        loose = []
        for h in range(1, self.capacity):
            for w in self.levels[h]:
                if self.padded[h]:
                    loose += w.pieces
                else:
                    self.done.append(w)
            self.levels[h] = []
        left = sum(len(ids) // 4 for _, _, ids in loose)
        room, w = 0, None
        for doc, start, ids in loose:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                    w = self._open()
                    self.done.append(w)
                k = min(room, n - at)
                w.pieces.append((doc, start + at, ids[4 * at:4 * (at + k)]))
                at, room = at + k, room - k


def pack_online(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, each task online over the documents that it reads.

    Returns (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece. Sequences are full or hold a
    power of two of tokens, so none is padded; sequence_id carries the number of the task. A document is cut at whole
    windows, where too many windows are open and at the end of a task. Nothing is shuffled and nothing is gathered: a task
    holds at most open_windows partly filled windows.

    Null and empty texts are one piece with the end id alone; texts of any length are encoded whole; a null key stays null;
    repeated rows are packed as often as they occur; an empty table gives no rows; columns other than key and text are not
    read."""
    source = docs.select(key, docs[text].alias("_text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([source.schema[key], *(T.StructField(c, T.LongType()) for c in names)])
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = _encoder(tokenizer)
        packer = SquaresPacker(capacity, TaskContext.get().partitionId() << 36, open_windows)
        kind = None

        def rows():
            out = []
            for w in packer.done:
                at = 0
                for (doc, tokens), start, ids in w.pieces:
                    n = len(ids) // 4
                    out.append((doc, start, n, zlib.crc32(ids), tokens, w.id, at))
                    at += n
            packer.done = []
            cols = list(zip(*out)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[key, *names])

        for batch in batches:
            kind = batch.column(key).type
            for doc, own in zip(batch.column(key).to_pylist(), enc.encode_column(batch.column("_text"))):
                ids = bytes(own) + last
                packer.add((doc, len(ids) // 4), ids)
                if len(packer.done) > ROWS:
                    yield rows()
        if kind is not None:
            packer.close()
            yield rows()

    return source.mapInArrow(run, schema)
