"""Words, word hashes and hashed shingles of whole texts, computed for an Arrow batch at once with numpy.

Words are the runs without blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z in lower case.
Null and empty texts have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd, so that it has an inverse modulo 2**64
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SLICE = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without a copy of the bytes; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """All words of a batch: number among the distinct words by word; `first[i]:first[i + 1]` are the words of row i."""

    codes: np.ndarray
    distinct: pa.Array
    first: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        """64-bit hash by word."""
        hashes = hash_strings(self.distinct)
        return hashes if len(hashes) == len(self.codes) and (self.codes[:-1] < self.codes[1:]).all() else hashes[self.codes]


def batch_words(raw: np.ndarray, offsets: np.ndarray, fold: bool = True, coded: bool = True) -> Words:
    """Words of rows given as bytes, in lower case unless `fold` is false: the white space is dropped, and what is left is dictionary-encoded
    in one pass. Unless `coded`, each word counts as distinct, which is faster where their hashes are all that is wanted."""
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(SPACE[raw], out=inside[:-1])
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begin[at] = inside[at]  # a word begins where its row does
    starts = np.flatnonzero(begin)
    end = inside[:-1].copy()
    end[:-1] &= ~inside[1:-1]
    at = at[at > 0]
    end[at - 1] = inside[at - 1]
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(end) + 1 - starts))).astype(np.int32)
    packed = raw[inside[:-1]]
    packed = LOWER[packed] if fold else packed
    array = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    first = np.searchsorted(starts, offsets)
    if not coded:
        return Words(np.arange(len(starts)), array, first)
    encoded = array.dictionary_encode()
    return Words(encoded.indices.to_numpy(), encoded.dictionary, first)


def hash_strings(array: pa.Array) -> np.ndarray:
    """A polynomial of random byte values modulo 2**64 for each string, mixed with its length; by prefix sums over slices."""
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out = np.empty(len(array), np.uint64)
    i = 0
    while i < len(array):
        a = ends[i]
        j = max(int(np.searchsorted(ends, a + _SLICE, "right")) - 1, i + 1)
        b = ends[j]
        up, down = _tables(int(b - a) + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
        s, e = ends[i:j] - a, ends[i + 1 : j + 1] - a
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD)
        i = j
    return out


_CACHED: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _SLICE + 1:
        return _powers(_STEP, n), _powers(_BACK, n)
    if not _CACHED:
        _CACHED.extend((_powers(_STEP, _SLICE + 1), _powers(_BACK, _SLICE + 1)))
    return _CACHED[0], _CACHED[1]


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` items, in order; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix64(out * _GOLD + hashes[i : i + n])
    return out


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Per row the distinct hashes of its runs of `width` words, ascending; fewer words make one run, no words none."""
    hashes = words.hashes
    runs = run_hashes(hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(run_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
