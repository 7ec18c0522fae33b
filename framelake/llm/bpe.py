"""Byte-level BPE encoding and decoding of documents."""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelake.llm.tokens import PieceEncoder, byte_chars, load_ranks

FIELDS = {
    "ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


@lru_cache(2)
def _loaded(path: str, pattern: str):
    tok = load_ranks(path, pattern)
    return PieceEncoder(tok), ByteTable(tok.get_vocab())


class ByteTable:
    """Bytes of each id: the vocabulary's characters mapped back to the bytes they stand for."""

    def __init__(self, vocab: dict[str, int]):
        byte = {c: b for b, c in enumerate(byte_chars())}
        words = [b""] * (max(vocab.values(), default=-1) + 1)
        for w, i in vocab.items():
            words[i] = bytes(byte[c] for c in w)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.words = words

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. A character whose bytes lie in several tokens is whole again here; text(ids) reads them."""
        return b"".join(map(self.words.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """Decoded text; bytes that form no character (a sequence cut within one) become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character span of each token in the text: byte ends by summed token sizes, mapped to characters by counting the
        bytes that begin one. Tokens that share a split character all cover it."""
        ends = np.cumsum(self.size[ids])
        begins = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
        chars = np.concatenate([[0], np.cumsum(begins)])
        at = ends - self.size[ids]
        inside = np.zeros(len(ids), dtype=np.int64)
        ok = at < len(raw)
        inside[ok] = ~begins[at[ok]]
        return (chars[at] - inside).astype(np.int32), chars[ends].astype(np.int32)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, outputs=("ids",), text: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row per document: the kept columns and the named outputs (see FIELDS) of its whole text.

    ids are those of a rank file's rule (each match of the pattern apart, no special tokens), by the tokenizers library;
    starts and ends are character offsets; decoded is the bytes that the ids stand for; the digests are lower-case hex
    SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded bytes. A null text counts as empty: no ids.
    Rows are independent of each other: nothing is shuffled, repeated rows stay, other columns are not read."""
    outputs, keep = list(outputs), list(keep)
    source = docs.select(*keep, docs[text].alias("_text"))
    schema = T.StructType([*source.select(*keep).schema.fields, *(T.StructField(n, FIELDS[n]) for n in outputs)])

    def run(batches):
        enc, table = _loaded(ranks, pattern)
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in outputs}
            for value in batch.column("_text"):
                t = value.as_py() or ""
                b = enc.encode(t)
                ids = np.frombuffer(b, dtype="<u4")
                if "starts" in cols or "ends" in cols:
                    s, e = table.offsets(t.encode(), ids)
                decoded = table.decode(ids) if "decoded" in cols or "decoded_sha256" in cols else b""
                for n in outputs:
                    cols[n].append(
                        len(ids) if n == "n_tokens" else hashlib.sha256(b).hexdigest() if n == "ids_sha256"
                        else hashlib.sha256(decoded).hexdigest() if n == "decoded_sha256" else decoded if n == "decoded"
                        else ids.astype(np.int32) if n == "ids" else s if n == "starts" else e)
            types = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "decoded": pa.binary(),
                     "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(cols[n], types[n]) for n in outputs)], names=[*keep, *outputs])

    return source.mapInArrow(run, schema)
