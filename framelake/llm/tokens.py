"""Token ids by the tokenizers library, text by text, for operators that run inside Arrow batches."""
from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut into pieces together.
TOGETHER_BYTES = 16 << 20
#: Word pieces that a worker keeps with their ids. For single texts (some 200 bytes each) in two halves: when the younger one is full it
#: becomes the older one, and pieces met again move over. For columns (some 40 bytes each) those of the last texts stay when they are
#: too many. Memory is bounded, results do not change.
CACHE_PIECES = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_json(path: str):
    """A tokenizer from a tokenizers JSON file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_ranks(path: str, pattern: str):
    """A byte-level BPE tokenizer from a rank file. A pair may merge when its bytes are a token, and merges in the order
    of that token's rank, which is the rule of rank files; a match that is itself a token is taken whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, chars = read_ranks(path), byte_chars()
    spelled = {t: "".join(chars[x] for x in t) for t in ranks}
    merges = [(spelled[t[:i]], spelled[t[i:]]) for t in sorted(ranks, key=ranks.get)
              for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def _body(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(where each value of a large string or binary array without nulls starts and the last one ends, all bytes)."""
    _, offsets, body = array.buffers()
    if not len(array):
        return np.zeros(1, np.int64), memoryview(b"")
    return np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset), memoryview(body or b"")


def _ends(array: pa.Array, n: int) -> list[np.ndarray]:
    """The first byte of each string and its last n, the last one first; 0 where there is none."""
    at, body = _body(array)
    body = np.append(np.frombuffer(body, np.uint8), np.uint8(0))
    return [np.where(at[:-1] < at[1:], body[at[:-1]], 0), *(np.where(at[1:] - at[:-1] >= k, body[np.maximum(at[1:] - k, 0)], 0) for k in range(1, n + 1))]


def _white(pieces: pa.Array) -> np.ndarray:
    """Which are empty, begin or end with white space. Only where the bytes leave it open is the string itself looked at."""
    first, last, second, third = _ends(pieces, 3)
    lead = np.array([0xE1, 0xE2, 0xE3], np.uint8)                   # of three bytes; of two it is 0xC2
    out = (first <= 32) | (last <= 32) | (first == 0xC2) | (second == 0xC2) | np.isin(first, lead) | np.isin(third, lead)
    at = np.flatnonzero(out)
    out[at] = [not p or p[0].isspace() or p[-1].isspace() for p in pieces.take(pa.array(at)).to_pylist()]
    return out


def _marked(pieces: pa.Array) -> np.ndarray:
    """Which end with a mark after a Latin letter: such a mark is a match of its own."""
    _, last, second, third = _ends(pieces, 3)
    plain = ((second | 32) >= 97) & ((second | 32) <= 122)
    accented = (third == 0xC3) & (second >= 0x80) & (second != 0x97) & (second != 0xB7)     # U+00C0 to U+00FF without signs
    return np.isin(last, np.frombuffer(b".,;:!?", np.uint8)) & (plain | accented)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A single space between two characters that are not white space always starts a new match of the byte-level
    pattern, so texts are cut there and each distinct piece is encoded once; ids of the text are the ids of its pieces.
    Texts with other white space around a space are cut only where that holds. A very long text thus never becomes one
    large encoding unless it has no such space. most: pieces of columns that are kept (CACHE_PIECES unless given)."""

    def __init__(self, tokenizer, most: int | None = None):
        self.tok, self.most = tokenizer, most
        self.first: dict[str, bytes] = {}           # pieces at the start of a text
        self.rest: dict[str, bytes] = {}            # pieces after a space
        self.older: dict[str, bytes] = {}           # those of the half that was filled before
        self.known = pa.array([], pa.large_string()), pa.array([], pa.large_binary())       # of encode_column: pieces after a space, ids
        self.marks = {m: self._alone(m) for m in ".,;:!?"}
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values(), default=-1) + 1, dtype=np.int64)
        for word, i in vocab.items():
            self.size[i] = len(word)                # one character stands for one byte

    def _alone(self, piece: str) -> bytes:
        return np.asarray(self.tok.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]):
        """Ids of pieces after a space: many are encoded as one text and told apart by the bytes that ids stand for."""
        groups = [pieces[i:i + 256] for i in range(0, len(pieces), 256)]
        for g, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in g])
            cuts = (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1) * 4
            raw, at = ids.tobytes(), 0
            for p, cut in zip(g, cuts.tolist()):
                self.rest[p] = raw[at:cut]
                at = cut

    def _find(self, need: set[str]):
        """Ids of pieces not in the younger half: from the older one, from the same piece without its last mark (a mark after an
        ASCII letter is a match of its own), or learned."""
        rest, older, new, marked = self.rest, self.older, set(), []
        for p in need:
            ids = older.get(p)
            if ids is not None:
                rest[p] = ids
            elif p[-1] in self.marks and p[-2:-1].isascii() and p[-2:-1].isalpha():
                marked.append(p)
                if p[:-1] in older:
                    rest[p[:-1]] = older[p[:-1]]
                elif p[:-1] not in rest:
                    new.add(p[:-1])
            else:
                new.add(p)
        self._learn(list(new))
        for p in marked:
            rest[p] = rest[p[:-1]] + self.marks[p[-1]]

    def _ids(self, parts: list[str]) -> bytes | None:
        """None: some piece begins or ends with white space, so that the cuts are not safe. Such pieces are never kept."""
        head, tail = parts[0], parts[1:]
        found = list(map(self.rest.get, tail))
        if None in found:
            need = {p for p, ids in zip(tail, found) if ids is None}
            if any(not p or p[0].isspace() or p[-1].isspace() for p in need):
                return None
            if len(self.rest) + len(need) > CACHE_PIECES // 2:
                self.rest, self.older = {}, self.rest
                need = set(tail)
            self._find(need)
            found = map(self.rest.__getitem__, tail)
        if head not in self.first:
            if not head or head[-1].isspace():
                return None
            if len(self.first) > CACHE_PIECES // 20:
                self.first.clear()
            self.first[head] = self._alone(head)
        return self.first[head] + b"".join(found)

    def encode_column(self, texts: pa.Array):
        """The ids of each text of a column as encode gives them (null: empty), as buffers. TOGETHER_BYTES of texts are cut at once:
        Arrow finds their distinct pieces, of which only those not known yet are encoded, and puts the ids together."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES, side="right")))
            yield from self._encode_some(texts.slice(at, stop - at))
            at = stop

    def _encode_some(self, texts: pa.Array):
        pieces = pc.split_pattern(texts, " ")
        first = np.asarray(pieces.offsets, dtype=np.int64)
        first, words = first - first[0], pieces.flatten()           # first piece of each text, and where the last text ends
        after_space = np.ones(len(words), dtype=bool)
        after_space[first[:-1]] = False
        tails = words.filter(pa.array(after_space)).dictionary_encode()
        ids, odd = self._ids_after_space(tails.dictionary)
        heads = self._ids_at_start(words.take(pa.array(first[:-1])).to_pylist())
        which = np.empty(len(words), dtype=np.int64)
        which[after_space] = tails.indices.to_numpy()
        which[first[:-1]] = len(ids) + np.arange(len(heads))
        # texts whose cuts are not safe are encoded by themselves: their first piece stands for all, the others for nothing
        odd = np.concatenate([odd, [x is None for x in heads]])
        for i in np.unique(np.searchsorted(first, np.flatnonzero(odd[which]), side="right") - 1).tolist():
            which[first[i] + 1:first[i + 1]] = len(odd)
            heads[i] = self.encode(texts[i].as_py())
        ids = pa.concat_arrays([ids, pa.array([*heads, b""], pa.large_binary())]).take(pa.array(which))
        offsets, body = _body(ids)
        body, at = memoryview(body), offsets[first].tolist()
        for a, b in zip(at, at[1:]):
            yield body[a:b]

    def _ids_at_start(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces at the start of a text; None where one is empty or ends with white space."""
        if len(self.first) > CACHE_PIECES // 20:
            self.first.clear()
        new = list({p for p in pieces if p and p not in self.first and not p[-1].isspace()})
        for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self.first[p] = np.asarray(e.ids, dtype="<u4").tobytes()
        return list(map(self.first.get, pieces))

    def _ids_after_space(self, pieces: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """(ids of each different piece after a space, mask of those that begin or end with white space, which have none)."""
        odd, marked = _white(pieces), _marked(pieces)
        stems = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        stems = pc.if_else(pa.array(odd), "", stems).dictionary_encode()
        known, found = self.known
        new = stems.dictionary.filter(pc.and_(pc.invert(pc.is_in(stems.dictionary, known)), pc.not_equal(stems.dictionary, "")))
        new_ids = self._learned(new)
        known, found = pa.concat_arrays([known, new]), pa.concat_arrays([found, new_ids])
        ids = pc.fill_null(found.take(pc.index_in(stems.dictionary, known)), b"")
        self.known = (known, found) if len(known) <= (CACHE_PIECES if self.most is None else self.most) else (stems.dictionary, ids)
        last = pc.if_else(pa.array(marked & ~odd), pc.utf8_slice_codeunits(pieces, -1), "").dictionary_encode()
        marks = pa.array([self.marks.get(m, b"") for m in last.dictionary.to_pylist()], pa.large_binary())
        return pc.binary_join_element_wise(ids.take(stems.indices), marks.take(last.indices), pa.scalar(b"", pa.large_binary())), odd

    def _learned(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of pieces after a space: many are encoded as one text and told apart by the bytes that ids stand for."""
        nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        at, text = _body(pc.binary_join_element_wise(nothing, pieces, space))
        bounds = [*range(0, len(pieces), 1024), len(pieces)] if len(pieces) else [0]
        groups = [str(text[at[i]:at[j]], "utf-8") for i, j in zip(bounds, bounds[1:])]
        body, cuts, n = [], [np.zeros(1, np.int64)], 0
        for i, j, e in zip(bounds, bounds[1:], self.tok.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            cuts.append(n + (np.searchsorted(np.cumsum(self.size[ids]), at[i + 1:j + 1] - at[i]) + 1) * 4)
            body.append(ids.tobytes())
            n += len(body[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.concatenate(cuts)), pa.py_buffer(b"".join(body))])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        ids = self._ids(text.split(" "))
        if ids is not None:
            return ids
        # cut only between characters that are not white space; what stands before and after is encoded with its neighbour
        parts = _CUT.split(text)
        if len(parts) < 3:
            return self._alone(text)
        inner = self._ids(["a", *parts[1:-1]])           # any first piece will do: its ids are taken off again
        return self._alone(parts[0]) + inner[len(self.first["a"]):] + self._alone(" " + parts[-1])
