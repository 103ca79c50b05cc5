"""Words of Arrow string columns as numpy arrays: spans, owners, hashes, windows.

Texts are handled as UTF-8 bytes. A null text counts as an empty one. Batches are
cut into slices of a few megabytes, so memory follows the slice or the longest
single text, never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_codes = np.arange(256)
#: Bytes of words without white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
ALNUM = (
    ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
)
LOWER = _codes.astype(np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def texts(column: pa.Array) -> Texts:
    """Bytes and offsets of a string column; the first offset is 0."""
    column = pa.concat_arrays([column.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most this many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(task: Task) -> Task:
    """The task, after which its worker gives unused memory back: Spark keeps idle
    workers, and allocators keep what a large slice once took."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def words(t: Texts, keep: np.ndarray) -> Words:
    """Maximal runs of bytes of a class; no run crosses two texts."""
    if not len(t.data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = keep[t.data]
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(start)
    owner = np.repeat(np.arange(len(t.offsets) - 1), np.diff(np.searchsorted(start, t.offsets)))
    return Words(start, np.flatnonzero(end) + 1, owner)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        made = np.full(max(n, SLICE_BYTES + 1), _STEP if kind == "up" else _BACK, np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if n <= SLICE_BYTES + 1:  # a table for one huge text isn't kept
            _powers[kind] = have
    return have[:n]


def hashes(data: np.ndarray, w: Words, fold: bool) -> np.ndarray:
    """64-bit hashes of words; fold: A-Z count as a-z."""
    n = len(data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _power("up", n), out=sums[1:])
    raw = (sums[w.end] - sums[w.start]) * _power("down", n + 1)[w.start]
    return mixed(raw ^ (w.end - w.start).astype(np.uint64))


_NEAR = 64


def _placed(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64) + np.uint64(1)) * _STEP)


_PLACED = _placed(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def spread_hashes(data: np.ndarray, w: Words, fold: bool) -> np.ndarray:
    """64-bit hashes of words: the sum of a random-looking number per byte and place.
    Unlike those of `hashes`, no two words collide by their structure."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    length = w.end - w.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum()))
    place = at - np.repeat(first, length)
    byte = data[np.repeat(w.start, length) + place]
    if fold:
        byte = LOWER[byte]
    far = np.flatnonzero(place >= _NEAR)
    value = _PLACED[np.minimum(place, _NEAR - 1) * 256 + byte]
    value[far] = _placed(byte[far], place[far])
    return mixed(np.add.reduceat(value, first) ^ (length.astype(np.uint64) * _STEP))


_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def eight_hashes(data: np.ndarray, w: Words, fold: bool) -> np.ndarray:
    """64-bit hashes of words, read eight bytes at a time; longer words than _NEAR bytes are hashed
    as in `spread_hashes`. No two words of up to eight bytes and the same length collide."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    length = w.end - w.start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if fold else data
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    value = mixed(eight[w.start] & _PART[np.minimum(length, 8)])
    more = np.flatnonzero((length > 8) & (length <= _NEAR))
    for i in range(8, _NEAR, 8):
        more = more[length[more] > i]
        part = eight[w.start[more] + i] & _PART[np.minimum(length[more] - i, 8)]
        value[more] = mixed(value[more] * _STEP + part)
    value = mixed(value ^ (length.astype(np.uint64) * _STEP))
    far = np.flatnonzero(length > _NEAR)
    value[far] = spread_hashes(data, Words(w.start[far], w.end[far], w.owner[far]), fold)
    return value


def windows(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of k words in one text."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
    out = np.zeros(len(first), np.uint64)
    for i in range(k):
        out = mixed(out * _STEP + h[first + i] + np.uint64(i + 1))
    return out, first
