"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import gives_back, lowest_hashed

#: Bound of what is learned from: documents per label, each with all its passages.
SAMPLE_DOCS = 2500
#: Words of a passage.
PASSAGE = 80
THRESHOLD = 0.7
_CLASSES = 9
#: Byte classes: 0 space, 1 a-z, 2 A-Z, 3 digit, 4 full stop, comma and the like, 5 '!' and '?', 6 other ASCII signs, 7 bytes over 127, 8 control
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[:128] = 6
_CLASS[:32] = 8
_CLASS[[32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_CLASS[[ord("!"), ord("?")]] = 5
WIDTH = _CLASSES * _CLASSES + 6


def encode_passages(text: str | None) -> np.ndarray:
    """One row per passage of PASSAGE words of the whole text (one row without a word): shares of the pairs of neighbouring
    byte classes, which show case, signs and their spacing, and shares of repeated and distinct words, word lengths."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    n = -(-len(words) // PASSAGE)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    block = PASSAGE * 256
    for at in range(0, len(words), block):                      # long texts in blocks of whole passages
        some = words[at:at + block]
        k0, k = at // PASSAGE, -(-len(some) // PASSAGE)
        sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        chars = _CLASS[np.frombuffer(b" ".join(some) + b" ", dtype=np.uint8)]
        passage = np.repeat(np.arange(len(some)) // PASSAGE, sizes + 1)
        pairs = np.bincount(passage[:-1] * 81 + chars[:-1] * 9 + chars[1:], minlength=81 * k)[:81 * k].reshape(k, 81)
        out[k0:k0 + k, :81] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
        which = np.arange(len(some)) // PASSAGE
        count = np.bincount(which, minlength=k)
        same = np.fromiter((a == b for a, b in zip(some, some[1:])), dtype=bool, count=len(some) - 1)
        repeat = np.bincount(which[1:], weights=same, minlength=k)
        distinct = np.array([len(set(some[i:i + PASSAGE])) for i in range(0, len(some), PASSAGE)])
        mean = np.bincount(which, weights=sizes, minlength=k) / count
        out[k0:k0 + k, 81:] = np.stack([repeat / count, distinct / count, mean / 10, np.log1p(count) / 5,
                                        np.bincount(which, weights=sizes == 1, minlength=k) / count,
                                        np.bincount(which, weights=sizes > 20, minlength=k) / count], axis=1)
    return out


class AttentionModel:
    """Passage x -> h = tanh(x W + b); attention a = softmax over passages of (tanh(h V) * sigmoid(h U)) w; document score =
    sigmoid((sum of a h) c + d). Trained by Adam on cross-entropy. Without documents of both labels nothing is learned: every
    score is then 0.5."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(max(s[0], 1)) if len(s) else 0, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.learned = False

    def _forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -50, 50)))

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 7) -> "AttentionModel":
        if len(set(np.asarray(labels).tolist())) < 2:
            return self
        self.learned = True
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0, dtype=float), every.std(axis=0, dtype=float) + 0.02
        del every
        bags = [((b - self.mean) / self.scale).clip(-5, 5).astype(np.float32) for b in bags]
        share = labels.mean()
        weight = np.where(labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                pick = order[i:i + batch]
                x, y, wt = np.concatenate([bags[j] for j in pick]), labels[pick], weight[pick]
                sizes = np.array([len(bags[j]) for j in pick])
                starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pick)), sizes)
                g = self._gradient(x, y, wt, starts, owner)
                step += 1
                for k in self.p:
                    grad = g[k] + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradient(self, x, y, weight, starts, owner) -> dict:
        p = self.p
        h, t, s, a, z, score = self._forward(x, starts, owner)
        out = weight * (score - y) / len(y)
        dz = out[:, None] * p["c"]
        da = (dz[owner] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dt, ds = de[:, None] * p["w"] * s * (1 - t ** 2), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ out, "d": out.sum()}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """A score from 0 to 1 of each document."""
        if not bags or not self.learned:
            return np.full(len(bags), 0.5)
        sizes = np.array([len(b) for b in bags])
        x = ((np.concatenate(bags) - self.mean) / self.scale).clip(-5, 5)
        return self._forward(x, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes))[-1]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> AttentionModel:
    """Learns from a bounded sample of labelled rows: for each label 0 and 1 the SAMPLE_DOCS keys with the lowest hash, of
    each every passage of the whole text. Passages are encoded by Spark; only their numbers reach the driver. Rows without
    a key or label are left out; of a key labelled twice the lower label counts. If a label has no document, `learned` of
    the result is False."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("_y"))
    chosen = lowest_hashed(one, "_y", key, SAMPLE_DOCS, 2)
    rows = docs.select(key, docs[text].alias("_text")).join(F.broadcast(chosen), key)   # at most 2 * SAMPLE_DOCS rows

    def run(batches):
        for b in batches:
            bags = []
            for v in b.column("_text"):
                bags.append(encode_passages(v.as_py()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_y"), pa.array(bags, pa.binary())], names=[key, "_y", "bag"])

    schema = T.StructType([rows.schema[key], rows.schema["_y"], T.StructField("bag", T.BinaryType())])
    found = sorted(rows.select(key, "_y", "_text").mapInArrow(gives_back(run), schema).collect(), key=lambda r: (r[0], bytes(r[2])))
    return AttentionModel().fit([np.frombuffer(r[2], "<f4").reshape(-1, WIDTH) for r in found], np.array([r[1] for r in found], dtype=float))


def score_quality(docs: DataFrame, model: AttentionModel, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted (1 from THRESHOLD on) of every document, from its whole text alone. Null and
    empty texts have one empty passage and are scored as such; repeated rows each return; an empty table gives none. Very
    long texts are encoded in blocks of passages. A kept column named score or predicted gives way to the operator's own.
    A model that learned nothing scores 0.5."""
    keep = [k for k in keep if k not in ("score", "predicted")]
    source = docs.select(*keep, docs[text].alias("_text"))

    def run(batches):
        for b in batches:
            scores, bags, size = [], [], 0
            for v in b.column("_text"):
                bags.append(encode_passages(v.as_py()))
                size += len(bags[-1])
                if size > 4000:
                    scores.append(model.score(bags))
                    bags, size = [], 0
            score = np.concatenate([*scores, model.score(bags)])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return source.mapInArrow(gives_back(run), T.StructType([*source.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
