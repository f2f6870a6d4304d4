"""SentencePiece encoding and decoding: segmentations sampled by forward filtering and backward sampling, seeded by row.

The pieces come from a public model file. A text gets a blank in front, blanks become U+2581, and it is cut before each run of blanks;
no piece goes beyond a cut, so the lattice of a text is the chain of its cuts' lattices. Within a cut, an edge joins two characters'
borders if a piece of the model spells what lies between; a character that no piece spells is an edge of its UTF-8 bytes'
pieces. A piece of rank r has weight (r + OFFSET) ** -SHARPNESS, a byte the smallest. The forward pass sums the weights of all
paths to each border, the backward pass draws edges from the end, each with its share of that sum, so a segmentation comes
out with probability proportional to the product of its weights. Draws depend on the seed, the row's key and the place of
the cut alone: the same row gives the same ids in any batch, task or run.

A batch's distinct cuts are built together: lattices by hashes of all substrings up to the longest piece, all draws in step.

Defined results: null and empty texts are the blank in front alone; a blank in a text and U+2581 are told apart, the latter
being encoded as bytes; decoding gives back every text exactly; a null key counts as 0; rows with the same key and text get the same ids;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import mix64, utf8

OFFSET, SHARPNESS = 10.0, 1.0
TOGETHER = 4_000_000
_G, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(63, _P))))
BLANK, LITERAL = 0x2581, 0x1FFFFF


class Index:
    """Places of hashes in a sorted array: their first PREFIX bits say where to begin, and few steps are left."""

    PREFIX = np.uint64(18)

    def __init__(self, table: np.ndarray):
        self.shift = np.uint64(64) - self.PREFIX
        cells = (table >> self.shift).astype(np.int64)
        begin = np.searchsorted(cells, np.arange((1 << int(self.PREFIX)) + 1))
        self.begin, self.most = begin[:-1].astype(np.int32), int(np.diff(begin).max())
        # Past the end stand copies of the last entry's complement, which no search beyond the table takes for its own.
        self.table = np.concatenate((table, np.full(self.most, ~table[-1], np.uint64)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes that are in the table, by number, and their places."""
        at = self.begin[h >> self.shift]
        hit = self.table[at] == h
        for _ in range(self.most - 1):
            left = np.flatnonzero(~hit)
            if not len(left):
                break
            at[left] += self.table[at[left]] < h[left]
            hit[left] = self.table[at[left]] == h[left]
        found = np.flatnonzero(hit)
        return found, at[found]


class Model:
    """Pieces by length and hash, and each piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        by: dict[int, dict[str, int]] = {}
        spelled = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
                continue
            spelled.append(piece.replace("▁", " ").encode())
            # A blank run may begin a piece, but never follow other characters, so cuts before blanks are safe.
            if "▁" not in piece.lstrip("▁"):
                for k in range(1, len(piece)):
                    by.setdefault(k, {}).setdefault(piece[:k], -1)
                by.setdefault(len(piece), {})[piece] = i
        #: By length, the hashes of all beginnings of pieces, and the piece's id and weight, or -1 where it is only a beginning.
        self.tables = {}
        for length, found in by.items():
            h = np.array([int(_hash(np.array([ord(c) for c in x], np.uint64))) for x in found], np.uint64)
            ids = np.array(list(found.values()), np.int64)
            order = np.argsort(h)
            rank = np.maximum(ids[order] - int(self.byte_ids.max()), 0)
            self.tables[length] = (Index(h[order]), ids[order], -SHARPNESS * np.log(rank + OFFSET))
        self.byte_weight = -SHARPNESS * np.log(n + OFFSET)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(s) for s in spelled])
        self.first = np.cumsum(self.length) - self.length


@cache
def model(path: str) -> Model:
    return Model(path)


def _hash(cp: np.ndarray) -> np.uint64:
    return (mix64(cp * _G) * _POWERS[: len(cp)]).sum(dtype=np.uint64)


def _width(cp: int) -> int:
    return 3 if cp == LITERAL else 1 if cp < 0x80 else 2 if cp < 0x800 else 3 if cp < 0x10000 else 4


class Lattices:
    """All lattices of some distinct cuts, given as code points. Node k of a cut is its border after k characters; `cum` has, by
    node, the ascending shares of the edges that end there, from the edge `begin` says."""

    def __init__(self, m: Model, cp: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        n, unit = len(cp), np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - offsets[:-1][unit]
        left = size[unit] - place
        t = mix64(cp.astype(np.uint64) * _G)
        h = t.copy()
        ends, lengths, ids, weights = [], [], [], []
        alive = np.arange(n)
        for length in range(1, len(m.tables) + 1):
            at = alive[left[alive] >= length]
            if not len(at):
                break
            if length > 1:
                h[at] += t[at + length - 1] * _POWERS[length - 1]
            index, own, w = m.tables[length]
            hit, i = index.find(h[at])
            alive = at[hit]
            whole = own[i] >= 0
            i, at = i[whole], alive[whole]
            if length == 1:
                odd = np.ones(n, bool)
                odd[at] = False
                odd = np.flatnonzero(odd)
                ends.append(odd + 1)
                lengths.append(np.ones(len(odd), np.int64))
                ids.append(-1 - cp[odd].astype(np.int64))
                weights.append(m.byte_weight * np.array([_width(int(c)) for c in cp[odd]], float))
            ends.append(at + length)
            lengths.append(np.full(len(at), length))
            ids.append(own[i])
            weights.append(w[i])
        end, length, self.ids, weight = map(np.concatenate, (ends, lengths, ids, weights)) if ends else (np.empty(0, np.int64),) * 4
        # Nodes are numbered by the end's place; the start of a cut is no node, and its sum is 1. Edges come by length.
        order = np.argsort(end, kind="stable")
        end, length, self.ids, weight = end[order], length[order], self.ids[order], weight[order]
        step = place[end - 1] + 1
        self.length = length
        alpha = np.zeros(n + 1)  # of the node that ends with character i - 1
        score = np.empty(len(end))
        most = int(size.max()) if len(size) else 0
        by_step = np.argsort(step.astype(np.uint16) if most < 1 << 16 else step, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(step, minlength=most + 1)[1:]))) if len(end) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e = by_step[a:b]
            if not len(e):
                continue
            to, size_e = end[e], length[e]
            before = alpha[to - size_e]
            before[size_e == step[e[0]]] = 0.0
            own = before + weight[e]
            score[e] = own
            group = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            top = np.maximum.reduceat(own, group)
            sums = np.add.reduceat(np.exp(own - np.repeat(top, np.diff(np.append(group, len(e))))), group)
            alpha[to[group]] = top + np.log(sums)
        share = np.exp(score - alpha[end])
        new = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1]))) if len(end) else np.empty(0, np.int64)
        run = np.cumsum(share)
        base = np.repeat(run[new] - share[new], np.diff(np.append(new, len(end)))) if len(end) else run
        last = np.append(new[1:], len(end)) - 1 if len(end) else new
        cum = np.minimum(run - base, 1.0)
        cum[last] = 1.0
        self.cum = cum
        self.begin = np.zeros(n + 1, np.int64)
        self.begin[end[new]] = new
        self.last = offsets[1:]  # the end node of each cut
        self.start = offsets[:-1]

    def draw(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences of cuts, with a seed each: all edges' ids in order, and how many each has."""
        node, start = self.last[which].copy(), self.start[which]
        active = np.flatnonzero(node > start)
        steps, count = [], np.zeros(len(which), np.int64)
        k = 0
        while len(active):
            u = (mix64(seeds[active] + np.uint64((k + 1) * int(_G) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            # A node's last share is 1, which u never reaches.
            e = self.begin[node[active]]
            on = np.flatnonzero(self.cum[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.cum[e[on]] <= u[on]]
            steps.append((active, self.ids[e]))
            node[active] -= self.length[e]
            count[active] += 1
            active = active[node[active] > start[active]]
            k += 1
        ends = np.cumsum(count)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for k, (at, ids) in enumerate(steps):
            out[ends[at] - 1 - k] = ids
        return out, count


def encode(path: str, column: pa.Array, keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all rows, one after the other, and where each row begins."""
    m = model(path)
    column = pc.binary_join_element_wise("", pc.fill_null(column, ""), " ")
    raw, offsets = utf8(column)
    blank = raw == 0x20
    edge = blank.copy()
    edge[1:] &= ~blank[:-1]
    edge[offsets[:-1]] = True
    starts = np.flatnonzero(edge)
    bounds = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
    distinct, which = coded.dictionary, coded.indices.to_numpy()
    text = "".join(distinct.to_pylist())
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    cp[cp == BLANK] = LITERAL
    cp[cp == 0x20] = BLANK
    sizes = pc.utf8_length(distinct).to_numpy()
    lattices = Lattices(m, cp, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.arange(len(starts)) - first[row]
    own = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * int(_P) % 2**64))
    edges, count = lattices.draw(which, mix64(own[row] + (place + 1).astype(np.uint64) * _P))
    at = np.concatenate(([0], np.cumsum(count)))[first]
    # Characters without a piece become their bytes' pieces.
    odd = np.flatnonzero(edges < 0)
    if len(odd):
        chars = [chr(BLANK if c == LITERAL else c).encode() for c in (-1 - edges[odd]).tolist()]
        width = np.ones(len(edges), np.int64)
        width[odd] = [len(c) for c in chars]
        to = np.concatenate(([0], np.cumsum(width)))
        out = np.empty(to[-1], np.int64)
        out[to[:-1]] = edges
        spots = np.concatenate([np.arange(to[o], to[o] + len(c)) for o, c in zip(odd.tolist(), chars, strict=True)])
        out[spots] = m.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        return out.astype(np.uint32), to[at]
    return edges.astype(np.uint32), at


def decode(path: str, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all rows, with the blank in front, and where each row begins."""
    m = model(path)
    n = m.length[ids]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(ends[-1]) + np.repeat(m.first[ids] - ends[:-1], n)
    return m.spelled[at].tobytes(), ends[first]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TOGETHER, "right")))
        yield batch.slice(a, b - a)
        a = b


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(part.column(0), 0).to_numpy().astype(np.int64)


def sample_encode(docs: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                ids, first = encode(path, part.column(1), _keys(part), seed)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column(0), lists], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy().astype(np.int64)
            body, at = decode(path, ids, first - first[0])
            yield pa.record_batch([batch.column(0), pa.array([body[a + 1 : b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """Digests of each row's sampled ids and of the text decoded from them, and whether it is the row's own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                ids, first = encode(path, part.column(1), _keys(part), seed)
                body, at = decode(path, ids, first)
                raw, offsets = utf8(part.column(1))
                raw = raw.tobytes()
                packed = ids.astype("<u4").tobytes()
                crc, sha, same = [], [], []
                for i in range(part.num_rows):
                    crc.append(zlib.crc32(packed[4 * first[i] : 4 * first[i + 1]]))
                    back = body[at[i] + 1 : at[i + 1]]
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == raw[offsets[i] : offsets[i + 1]])
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
