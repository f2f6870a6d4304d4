"""Token ids of whole texts with the public tokenizers; the vocabulary file is a parameter.

Byte-level and word-end BPE never merge across the start of a run of white space, so a text is cut there, and each distinct cut
is given to the library once: a batch is dictionary-encoded, new entries are encoded, and the ids are gathered. Texts with
other than ASCII white space, where a run may hold several kinds, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import threading
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .store import release
from .words import SPACE, hash_strings, utf8

#: Bytes of text that are cut and looked up together.
TOGETHER = 4_000_000
#: Distinct cuts that a worker remembers from task to task, some 50 bytes each, and their bytes; beyond either they are forgotten.
REMEMBERED, REMEMBERED_BYTES = 2_000_000, 32_000_000
#: Cuts whose ids are gathered at once.
GATHERED = 1 << 16
#: White space beyond ASCII.
OTHER_SPACE = "[\u0085   -     　]"


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # the names of special tokens are ordinary text here
    t.no_truncation()
    t.no_padding()
    return t


def encode_whole(path: str, texts: list[str]) -> list[list[int]]:
    """By the library alone; a few at a time, since it keeps some 100 bytes for each token."""
    out: list[list[int]] = []
    for i in range(0, len(texts), 512):
        out += [e.ids for e in tokenizer(path).encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
    return out


def encode_flat(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As encode_whole, but the ids of all texts in one array, and their number by text."""
    flat, count = [np.empty(0, np.uint32)], [np.empty(0, np.int32)]
    for i in range(0, len(texts), 512):
        got = encode_whole(path, texts[i : i + 512])
        count.append(np.fromiter(map(len, got), np.int32, len(got)))
        flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
    return np.concatenate(flat), np.concatenate(count)


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All cuts of a batch as one string array over the same bytes, and the first cut of each row."""
    space = SPACE[raw]
    edge = np.zeros(len(raw), bool)
    if len(raw):
        edge[1:] = space[1:] & ~space[:-1]
        edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts, len(raw)).astype(np.int32)
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw))
    return array, np.searchsorted(starts, offsets)


_ENCODERS: dict[str, Encoder] = {}
_IDLE: list[threading.Timer] = []


def encoder(path: str) -> Encoder:
    """This worker's encoder: its memory of cuts lasts for later tasks."""
    _stay()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _stay() -> None:
    while _IDLE:
        _IDLE.pop().cancel()


def forget() -> None:
    """Drops what this worker remembers: stages that need memory of their own call it, since workers are used again."""
    if _ENCODERS:
        _ENCODERS.clear()
        tokenizer.cache_clear()
        release()


def forget_idle(seconds: float = 2.0) -> None:
    """Drops it unless a task comes soon: a worker that later stages don't use would hold it on and on."""
    _stay()
    _IDLE.append(threading.Timer(seconds, forget))
    _IDLE[0].daemon = True
    _IDLE[0].start()


class Encoder:
    """Encodes string columns and remembers the ids of distinct cuts: strings and ids lie in arrays, found by hash and compared in full."""

    def __init__(self, path: str):
        self.path = path
        self._reset()

    def _reset(self) -> None:
        self.hash, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)  # ascending hashes, and whose they are
        self.words = pa.array([], pa.string())
        self.flat, self.first, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _known(self, distinct: pa.Array, h: np.ndarray) -> np.ndarray:
        """Numbers of strings whose ascending hashes are given, -1 for those not remembered."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        number = self.number[at]
        same = self.hash[at] == h
        number[~same] = -1
        held = np.flatnonzero(same)
        equal = pc.equal(self.words.take(pa.array(number[held])), distinct.take(pa.array(held)))
        number[held[~equal.to_numpy(zero_copy_only=False)]] = -1  # another string of the same hash
        return number

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        h = hash_strings(distinct)
        order = np.argsort(h)
        h, distinct = h[order], distinct.take(pa.array(order))
        number = self._known(distinct, h)
        new = np.flatnonzero(number < 0)
        if len(self.count) + len(new) > REMEMBERED or self.words.nbytes - 4 * len(self.words) + distinct.nbytes > REMEMBERED_BYTES:
            self._reset()
            number, new = np.full(len(h), -1, np.int32), np.arange(len(h))
        if len(new):
            words = distinct.take(pa.array(new))
            flat, count = encode_flat(self.path, words.to_pylist())
            number[new] = np.arange(len(self.count), len(self.count) + len(new))
            at = np.searchsorted(self.hash, h[new])
            self.hash, self.number = np.insert(self.hash, at, h[new]), np.insert(self.number, at, number[new])
            self.words = pa.concat_arrays([self.words, words])
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(count, dtype=np.int64) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, flat))
        out = np.empty(len(h), np.int32)
        out[order] = number
        return out

    def _rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row."""
        raw, offsets = utf8(column)
        cuts, row = cut(raw, offsets)
        coded = cuts.dictionary_encode()
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        del raw, cuts, coded
        known, first, size = self.flat, self.first, self.count  # another column may make the encoder forget
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(row, row[i] + GATHERED, "right")) - 1)
            some = which[row[i] : row[j]]
            count = size[some]
            ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
            ids = known[np.arange(ends[-1]) + np.repeat(first[some] - ends[:-1], count)]
            at = ends[row[i : j + 1] - row[i]].tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield ids[a:b]
            i = j

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text as uint32; null is the empty text."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TOGETHER, "right")))
            part = column.slice(a, b - a)
            odd = pc.fill_null(pc.match_substring_regex(part, OTHER_SPACE), False).to_numpy(zero_copy_only=False)
            whole = dict(zip(np.flatnonzero(odd).tolist(), encode_whole(self.path, part.filter(pa.array(odd)).to_pylist()), strict=True)) if odd.any() else {}
            for i, ids in enumerate(self._rows(part)):
                yield np.array(whole[i], np.uint32) if i in whole else ids
            a = b
