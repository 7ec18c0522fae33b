"""Language identification by cross-parsing entropy."""
from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import gives_back

#: The bounds of what is learned from: different texts per language, symbols per language (every chosen text gives an equal
#: share of them), and the length of the stretches, spread over the whole text, that make up a share.
SAMPLE_TEXTS, SAMPLE_SYMBOLS, PIECE = 400, 40_000, 50
#: Languages whose automata are in memory at once.
SHARD = 64
#: A text is parsed in stretches of this many symbols side by side; a phrase ends where a stretch ends.
STRETCH = 256
#: Stretches parsed together in one step, over all languages.
LANES = 1 << 14
UNKNOWN, SPACE, PAD = 0, 1, 2           # symbol classes (unknown: letters that nothing learned has); letters follow
NONE = "und"


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Suffix automaton of a symbol sequence: of each state (0 is the root) the next one by symbol. Negative symbols end a
    text: no match crosses them."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        if c < 0:
            last = 0
            continue
        q = goto[last].get(c)
        if q is not None and length[q] == length[last] + 1:     # after a text's end: the state is there already
            last = q
            continue
        cur, p = len(goto), last
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
                if length[cur] == length[clone] and not goto[cur]:
                    cur = clone                                  # the new text's prefix is the clone itself
        last = cur
    return goto


def packed(goto: list[dict[int, int]], n_classes: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The automaton as a double array, its root, and the root's next state by class (the root itself where it has none). A state
    is the place from which its symbols count: slot state + symbol is (state, next state) if the state has that symbol. No
    two states have one place. So memory is in proportion to the symbols learned, however many classes there are."""
    n = sum(map(len, goto))
    taken, used = bytearray(2 * n + n_classes + len(goto) + 1), set()
    place = [0] * len(goto)
    low, leaf, single = 0, 0, False
    for q in sorted(range(len(goto)), key=lambda q: -len(goto[q])):
        out = sorted(goto[q])
        if not out:
            while leaf in used:
                leaf += 1
            at = leaf
        else:
            if len(out) == 1 and not single:
                low, single = 0, True
            f = taken.find(0, max(low, out[0]))
            tries = 0
            while True:
                at = f - out[0]
                if at + n_classes >= len(taken):
                    taken.extend(bytes(len(taken)))
                if at not in used and not any(taken[at + c] for c in out):
                    break
                tries += 1
                f = taken.find(0, f + 1)
            for c in out:
                taken[at + c] = 1
            if tries > 16:
                low = f                                         # dense before: its holes are left to states of one symbol
        used.add(at)
        place[q] = at
    slots = np.full((max(place) + n_classes, 2), -1, dtype=np.int32)
    for q, out in enumerate(goto):
        for c, r in out.items():
            slots[place[q] + c] = place[q], place[r]
    first = np.full(n_classes, place[0], dtype=np.int32)
    for c, r in goto[0].items():
        first[c] = place[r]
    return slots, place[0], first


class LanguageModel:
    """Letter classes and one automaton per language; `bits` is what a phrase of a language costs (a place in its text).
    Automata are built for a shard of languages at a time."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(k for k, v in samples.items() if any(c.isalpha() for t in v for c in t))
        self.samples = {k: samples[k] for k in self.languages}
        seen = Counter(c.lower()[:1] for k in self.languages for t in samples[k] for c in t if c.isalpha())
        self.letters = sorted(seen, key=lambda c: (-seen[c], c))
        self.bits, self._shards = [], None
        codes = _codes(tuple(self.letters))
        for k in self.languages:
            self.bits.append(float(np.log2(max(2, sum(len(to_symbols(t, codes)) for t in samples[k])))))

    def shards(self):
        """The automata of SHARD languages after another."""
        codes = _codes(tuple(self.letters))
        for i in range(0, len(self.languages), SHARD):
            yield Automata([np.concatenate([s for t in self.samples[k] for s in (to_symbols(t, codes), np.array([-1]))]) for k in self.languages[i:i + SHARD]], 3 + len(self.letters))

    def empty(self) -> "LanguageModel":
        """All but what is learned, to go with shards."""
        out = LanguageModel({})
        out.languages, out.letters, out.bits = self.languages, self.letters, self.bits
        return out

    def classify(self, texts: list[str], shards=None) -> tuple[list[str], list[float]]:
        """The language that needs the fewest bits of phrases (equal: first by name) and 1 - best / (best + second)."""
        names, scores = [NONE] * len(texts), [0.0] * len(texts)
        if not self.languages or not texts:
            return names, scores
        codes = _codes(tuple(self.letters))
        symbols = [to_symbols(t, codes) for t in texts]
        # stretches of all texts
        owner, rows = [], []
        for i, s in enumerate(symbols):
            for k in range(0, len(s), STRETCH):
                owner.append(i)
                rows.append(s[k:k + STRETCH])
        phrases, done = np.zeros((len(texts), len(self.languages))), 0
        for shard in shards if shards is not None else self._held():
            per_step = max(1, LANES // len(shard.roots))
            mine = phrases[:, done:done + len(shard.roots)]
            done += len(shard.roots)
            for k in range(0, len(rows), per_step):
                part = rows[k:k + per_step]
                block = np.full((max(map(len, part)), len(part)), PAD, dtype=np.int32)
                for j, r in enumerate(part):
                    block[:len(r), j] = r
                np.add.at(mine, owner[k:k + per_step], shard.count(block))
        cost = phrases * self.bits
        for i in range(len(texts)):
            if (symbols[i] != SPACE).any():
                order = np.argsort(cost[i], kind="stable")
                names[i] = self.languages[order[0]]
                best, second = cost[i, order[0]], cost[i, order[1]] if len(order) > 1 else np.inf
                scores[i] = 1.0 if np.isinf(second) else float(second / (best + second)) if best + second else 0.5
        return names, scores

    def _held(self):
        """The shards, kept if there is only one."""
        if len(self.languages) > SHARD:
            return self.shards()
        if self._shards is None:
            self._shards = list(self.shards())
        return self._shards

    def _count(self, block: np.ndarray) -> np.ndarray:
        """Phrases of each column (a stretch) in each language."""
        return np.concatenate([s.count(block) for s in self._held()], axis=1)


class Automata:
    """The automata of some languages in one double array."""

    def __init__(self, texts: list[np.ndarray], n_classes: int):
        parts = [packed(automaton(t), n_classes) for t in texts]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
        self.slots = np.concatenate([np.where(p[0] >= 0, p[0] + b, -1) for p, b in zip(parts, base)]).astype(np.int32)
        self.roots = np.array([p[1] + b for p, b in zip(parts, base)], dtype=np.int64)
        self.first = np.stack([p[2] + b for p, b in zip(parts, base)]).astype(np.int64)

    def count(self, block: np.ndarray) -> np.ndarray:
        """Phrases of each column (a stretch) in each language."""
        state = np.repeat(self.roots[:, None], block.shape[1], axis=1)
        count = np.ones(state.shape, dtype=np.int32)            # the phrase that is open at the end
        slots = self.slots.view(np.int64).ravel()               # (state, next) at once; little-endian
        for row in block:
            slot = slots[state + row]
            miss = (slot & 0xFFFFFFFF) != state
            state = np.where(miss, self.first[:, row], slot >> 32)
            count += miss & (row != PAD)
        return count.T


@lru_cache(4)
def _codes(letters: tuple[str, ...]) -> np.ndarray:
    """Class of every code point: a letter's own, UNKNOWN for other letters, SPACE for all else."""
    own = {c: i + 3 for i, c in enumerate(letters)}
    out = np.full(0x110000, SPACE, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = own.get(c.lower()[:1], UNKNOWN)
    return out


def to_symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """Classes of the text's letters, lower-cased; whatever stands between letters is one space."""
    s = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    return s[keep]


def in_fold(key: str = "doc_id"):
    """True for the rows that must not be learned from: crc32 of the key's text leaves 2 when divided by 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _spread(text: str, share: str):
    """The text as an array of pieces: whole if it has at most `share` characters, or else share / PIECE pieces (at least one),
    each from the middle of one of as many equal parts of the text."""
    t, n = F.col(text), F.greatest(F.lit(1), F.floor(F.col(share) / PIECE).cast("int"))
    start = lambda i: F.floor((i + 0.5) * F.length(t) / n - PIECE / 2).cast("int")
    return F.when(F.length(t) <= F.greatest(F.col(share), F.lit(PIECE)), F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, start(i) + 1, F.lit(PIECE))))


def sample_languages(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, _k, _t): of each language (non-null) the SAMPLE_TEXTS different texts with the lowest hash, numbered in its order,
    each as pieces (see _spread) of an equal share of SAMPLE_SYMBOLS. Copies are one text. Different texts are counted
    first, so that all but about twice the sample are dropped where they are read."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    counts = rows.groupBy(lang).agg(F.approx_count_distinct("_h").alias("_all"))
    low = F.lit(-2.0 ** 63) + F.lit(2.0 ** 65) * SAMPLE_TEXTS / F.col("_all")
    some = rows.select(lang, "_h").join(F.broadcast(counts), lang).where(F.col("_h").cast("double") <= low).select(lang, "_h").distinct()
    chosen = some.withColumn("_k", F.row_number().over(Window.partitionBy(lang).orderBy("_h"))).where(F.col("_k") <= SAMPLE_TEXTS)
    chosen = chosen.withColumn("_share", F.floor(SAMPLE_SYMBOLS / F.count("*").over(Window.partitionBy(lang))).cast("int"))
    found = rows.join(F.broadcast(chosen), [lang, "_h"])
    return found.groupBy(lang, "_k").agg(F.min(_spread("_text", "_share")).alias("_t"))


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Learns every language (non-null) from a bounded sample of each (see sample_languages), all of it, in the order of the
    texts' hashes. Only that sample reaches the driver."""
    samples: dict[str, list[str]] = {}
    for name, _, pieces in sorted(map(tuple, sample_languages(docs, lang, text).collect())):
        samples.setdefault(name, []).extend(pieces)
    return LanguageModel(samples)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every document, from its whole text alone.

    lang_pred is a learned language, or 'und' with score 0 where the text is null or has no letter, or nothing was learned.
    score is the second-best language's share of the cost of the best two: 0.5 for a tie, near 1 for a sure guess. Rows are
    independent: nothing is shuffled, repeated rows each return, an empty table gives none. The automata (at most SAMPLE_SYMBOLS
    * 2 states a language) travel with the tasks, SHARD languages in a broadcast; of several, one at a time is in memory. A
    very long text is parsed in stretches. A kept column named lang_pred or score gives way to the operator's own."""
    keep = [k for k in keep if k not in ("lang_pred", "score")]
    source = docs.select(*keep, docs[text].alias("_text"))
    context = docs.sparkSession.sparkContext
    sent, parts = context.broadcast(model.empty()), [context.broadcast(s) for s in model.shards()]

    def run(batches):
        m = sent.value
        one = [parts[0].value] if len(parts) == 1 else None

        def shards():
            return one if one else (p.load_from_path(p._path) for p in parts)      # `value` would keep them all

        for b in batches:
            names, scores, group, size = [], [], [], 0
            for v in b.column("_text"):
                t = v.as_py() or ""
                group.append(t)
                size += len(t)
                if size > 1 << 20:
                    n, s = m.classify(group, shards())
                    names, scores, group, size = names + n, scores + s, [], 0
            n, s = m.classify(group, shards())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names + n, pa.string()), pa.array(scores + s, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(gives_back(run), T.StructType([*source.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
