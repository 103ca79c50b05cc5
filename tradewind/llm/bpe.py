"""Byte-level BPE: speculate and verify.

Each different word is cut by greedy longest match. The cut is what merging by
rank gives if each of its tokens merges to itself and each adjacent pair is
compatible, that is, merging the pair's bytes gives the pair. All adjacent
pairs are looked up at once in a sorted table of pairs judged so far; only words
with a failing token or pair are merged exactly, in n log n steps.

Texts are cut where a blank follows something else, which is a word's
beginning wherever it occurs; a process cuts and merges each different chunk between two
such places once and gathers the ids of all others by number.

Defined cases: a null text is an empty one, which has no tokens; rows with null
or repeated ids are encoded row by row. Strings of the vocabulary's added tokens
become those tokens, as the tokenizers library has it. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.text import Texts, slices, texts, tidied

#: Words of byte-level BPE, as the vocabulary's pre-tokenizer defines them (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Different chunks, and different words, kept between batches of a task.
REMEMBERED = 300_000
#: Most bytes of a word that is merged by looking through all its pairs; and more than any rank.
SHORT = 48
NEVER = 1 << 62
_codes = np.arange(256)
_BLANK = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
#: Bytes after which a blank begins a chunk: printing ASCII, and ends of characters beyond it.
_SOLID = (_codes > 32) & (_codes != 127)


def _chunks(t: Texts) -> np.ndarray:
    """First bytes of chunks. Characters beyond ASCII that are white space end in one of
    the pairs of bytes left out here."""
    data = t.data
    begins = np.zeros(len(data) + 1, bool)
    begins[t.offsets] = True
    if len(data) > 1:
        turn = _BLANK[data[1:]] & _SOLID[data[:-1]]
        two, one = np.append(np.uint8(0), data[:-2]), data[:-1]
        odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        odd |= ((two == 0x9A) & (one == 0x80)) | ((two == 0x81) & (one == 0x9F))
        odd |= (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) & (one >= 0x80)
        begins[1:-1] |= turn & ~odd
    return np.flatnonzero(begins[:-1])


def _byte_of() -> dict[str, int]:
    """The byte each character of a vocabulary entry stands for: itself if it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known:
    """Ids of keys met so far."""

    def __init__(self) -> None:
        self.place: dict = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, keys: list, flat: np.ndarray, length: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.start), len(self.start) + len(keys)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])

    def at(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))

    def ids(self, at: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.start[at], self.length[at])


class Vocabulary:
    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        byte = _byte_of()
        read = lambda token: bytes(byte[c] for c in token)
        self.id = {read(token): i for token, i in parsed["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        merges = (m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"])
        self.rank = {(read(a), read(b)): i for i, (a, b) in enumerate(merges)}
        size = max([*self.id.values(), *self.special.values()]) + 1
        # The same by number: rank of two ids, and what they merge to by rank.
        self.base, self.byte = size, {t[0]: i for t, i in self.id.items() if len(t) == 1}
        self.number = {self.id[a] * size + self.id[b]: r for (a, b), r in self.rank.items() if a in self.id and b in self.id}
        self.made = {r: self.id.get(a + b) for (a, b), r in self.rank.items()}
        self.bytes = [b""] * size
        for token, i in self.id.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Lengths of tokens by their first bytes, those by one and two bytes for what has no longer match.
        lengths: dict[bytes, set[int]] = {}
        for token in self.id:
            for n in range(1, min(len(token), 4) + 1):
                if n == 4 or n == len(token):
                    lengths.setdefault(token[:n], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.solid = np.zeros(size, np.int8)  # 1: merges to itself, -1: doesn't, 0: not judged yet
        self.pairs = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)
        self.chunks, self.words = Known(), Known()

    def merged(self, word: bytes) -> list[int]:
        """The word's tokens by definition: merge the pair of least rank, the first of equal ones, until none is left."""
        if len(word) <= SHORT:
            return self._merged_short(word)
        part = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if part[i] else len(part)
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, b""
            after[i] = k = after[j]
            if k < len(part):
                before[k] = i
                if (r := self.rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(queue, (r, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (r := self.rank.get((part[h], part[i]))) is not None:
                heapq.heappush(queue, (r, h, part[h], part[i]))
        return [self.id[p] for p in part if p]

    def _merged_short(self, word: bytes) -> list[int]:
        """The same without a queue: looking through the ranks of a short word costs less."""
        ids = [self.byte[b] for b in word]
        get, base, made = self.number.get, self.base, self.made
        ranks = [get(a * base + b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i] = here = made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(here * base + ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + here, NEVER)
        return ids

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.id.get(word)) is not None:
            return [whole]
        out, at, size = [], 0, len(word)
        while at < size:
            token = None
            for first in (4, 3, 2, 1):
                for n in self.lengths.get(word[at : at + first], ()) if at + first <= size else ():
                    if (token := self.id.get(word[at : at + n])) is not None and at + n <= size:
                        break
                    token = None
                if token is not None:
                    break
            out.append(token)
            at += n
        return out

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has."""
        proposals = [self.proposed(w) for w in words]
        length = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(length.sum()))
        owner = np.repeat(np.arange(len(words)), length)
        for token in np.unique(flat[self.solid[flat] == 0]).tolist():
            self.solid[token] = 1 if self.merged(self.bytes[token]) == [token] else -1
        failed = np.zeros(len(words), bool)
        failed[owner[self.solid[flat] < 0]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key = flat[inner] << 32 | flat[inner + 1]
        self._judge(np.setdiff1d(key, self.pairs))
        failed[owner[inner[~self.good[np.searchsorted(self.pairs, key)]]]] = True if len(key) else False
        for i in np.flatnonzero(failed).tolist():
            proposals[i] = self.merged(words[i])
        if failed.any():
            length = np.fromiter(map(len, proposals), np.int64, len(words))
            flat = np.fromiter((i for p in proposals for i in p), np.int64, int(length.sum()))
        return flat.astype(np.uint32), length

    def _judge(self, new: np.ndarray) -> None:
        if len(new):
            pairs = [(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()]
            good = np.array([self.merged(self.bytes[a] + self.bytes[b]) == [a, b] for a, b in pairs])
            self.pairs = np.concatenate([self.pairs, new])
            order = np.argsort(self.pairs)
            self.pairs, self.good = self.pairs[order], np.concatenate([self.good, good])[order]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        new = list({w for w in words if w not in self.words.place})
        if new:
            self.words.add(new, *self.cut([w.encode() for w in new]))
        at = self.words.at(words)
        return self.words.ids(at), self.words.length[at]

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks that weren't met before."""
        words = [WORD.findall(c.decode()) for c in chunks]
        many = np.fromiter(map(len, words), np.int64, len(words))
        flat, length = self._ids([w for found in words for w in found])
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(many))]
        self.chunks.add(chunks, flat, np.diff(ends))

    def _marked(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens."""
        out = []
        for i, part in enumerate(self.split.split(text)):
            if i % 2:
                out.append(np.array([self.special[part]], np.uint32))
            else:
                out.append(self._ids(WORD.findall(part))[0])
        return np.concatenate(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.chunks.place) > REMEMBERED:
            self.chunks = Known()
        if len(self.words.place) > REMEMBERED:
            self.words = Known()
        t = texts(column)
        n = len(column)
        first = _chunks(t)
        offsets = np.append(first, len(t.data)).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(t.data)])
        coded = chunks.dictionary_encode()
        found = coded.dictionary.to_pylist()
        if new := [c for c in found if c not in self.chunks.place]:
            self._learn(new)
        at = self.chunks.at(found)[np.asarray(coded.indices, np.int64)]
        owner = np.searchsorted(t.offsets, first, side="right") - 1
        length = self.chunks.length[at]
        whole = t.data.tobytes() if self.split else b""
        marked = {}
        if any(s.encode() in whole for s in self.special):
            cuts = [whole[a:b].decode() for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
            marked = {i: self._marked(x) for i, x in enumerate(cuts) if self.split.search(x)}
            length = np.where(np.isin(owner, list(marked)), 0, length)
        ids = _gathered(self.chunks.flat, self.chunks.start[at], length)
        size = np.bincount(owner, length, minlength=n).astype(np.int64)
        if marked:
            ends = np.append(0, np.cumsum(size))
            ids = np.concatenate([marked[i] if i in marked else ids[ends[i] : ends[i + 1]] for i in range(n)])
            size[list(marked)] = [len(x) for x in marked.values()]
        return ids, size


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start, one after the other."""
    cut = np.cumsum(length) - length
    return flat[np.repeat(start - cut, length) + np.arange(int(length.sum()))]


class Decoder:
    """The bytes of each id, nothing else."""

    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        byte = _byte_of()
        known = {i: bytes(byte[c] for c in token) for token, i in parsed["model"]["vocab"].items()}
        known |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        each = [known.get(i, b"") for i in range(max(known) + 1)]
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.table, self.start = np.frombuffer(b"".join(each), np.uint8), np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, length: np.ndarray) -> list[str]:
        """The texts of rows of ids; bytes that aren't UTF-8 become U+FFFD."""
        size = self.size[ids]
        data = _gathered(self.table, self.start[ids], size).tobytes()
        ends = np.append(0, np.cumsum(size))[np.cumsum(length)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_loaded: dict[tuple[type, int], Vocabulary | Decoder] = {}


def _made(kind: type, definition: str) -> Vocabulary | Decoder:
    """Made once per process."""
    key = (kind, hash(definition))
    if key not in _loaded:
        _loaded[key] = kind(definition)
    return _loaded[key]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, and ids (little-endian unsigned 32-bit integers)
    of each row. path: of the vocabulary, read by the driver."""
    with open(path, encoding="utf-8") as source:
        definition = source.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _made(Vocabulary, definition)
        for piece in slices(batches, "text"):
            ids, length = vocabulary.encode(piece.column("text"))
            data = ids.astype("<u4").tobytes()
            cut = [0, *(4 * np.cumsum(length)).tolist()]
            column = pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.record_batch({**{c: piece.column(c) for c in ("doc_id", *keep)}, "ids": column})

    rows = docs.select(F.col("doc_id").cast("long"), *keep, "text")
    return rows.mapInArrow(tidied(run), T.StructType([*rows.drop("text").schema.fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, ids and text of each row of encode()'s result; null ids have no text."""
    with open(path, encoding="utf-8") as source:
        definition = source.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _made(Decoder, definition)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                piece = batch.slice(first, 1000)
                data = [x or b"" for x in piece.column("ids").to_pylist()]
                length = np.fromiter(map(len, data), np.int64, len(data)) // 4
                text = decoder.decode(np.frombuffer(b"".join(data), "<u4"), length)
                ids = piece.column("ids")
                column = pa.array(text, pa.string(), mask=np.asarray(ids.is_null()))
                yield pa.record_batch({**{c: piece.column(c) for c in ("doc_id", *keep)}, "ids": ids, "text": column})

    rows = encoded.select("doc_id", *keep, "ids")
    return rows.mapInArrow(tidied(run), T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
