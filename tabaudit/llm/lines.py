"""Line dedup: fuzzy copies of lines, of which one occurrence stays.

A line is what stands between line feeds. It is normalised byte by byte: A-Z to lower case, digits to 0, ASCII punctuation to
blanks, white space collapsed. Lines that are equal then are one node, known by a 64-bit hash. Linked are nodes whose edit
similarity, 1 - Levenshtein / longer length, is SIMILARITY or more, as far as the sketches below make them meet.

  1. one pass over the texts gives occurrences, each line's sketch and its block keys. A sketch is the SimHash of its words (64 bits)
     and MINS minimal hashes of neighbouring words; a block key joins two of them. Lines of few words have a sketch and keys of runs
     of GRAM bytes instead, so that changed letters count too; between LEAST and FEW words they have both;
  2. records (key, node, sketch, length) travel packed, by shards of the keys. Lines that meet under a key are candidates if their
     lengths allow the similarity and their SimHashes differ in at most DISTANCE bits, which is less the fewer of the minimal hashes are
     equal; a pair that meets under several keys counts under the first alone. Of each run of a key, the connected groups of candidates go on.
     Keys with more than LONG nodes in an overfull shard are left to bounded tasks by pairs of blocks;
  3. only such lines are read as text. In a group, every pair of candidates that isn't connected yet is held against bounds that no
     similar pair breaks (counts of letters and of pairs of letters), and then against a Levenshtein distance, of many pairs at once;
  4. occurrences travel by shards of their lines, where each line's first is found. Of each connected group of similar lines the first
     occurrence by (doc_id, line number) stays, the others go.

Why the blocks are minimal hashes and not bits of the SimHash: two lines of similarity 0.8 differ in some 20 % of its bits, so
sound pigeonhole blocks would be of some five bits, and every thirtieth line of a corpus would share one.

Defined results: null stays null, and an empty text stays empty; lines without letters, digits or other signs than ASCII
punctuation are never removed; of equal lines in one document the first stays; of lines that begin groups alike (ties) the smaller
(doc_id, line number) stays; a document all of whose lines go becomes the empty text; rows with the same doc_id are one document to
this operator and lose the same lines; rows with a null doc_id stay as they are; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distance import batches as like_sized
from .distance import lettered, within_limits_of
from .groups import blocks, connected_components, runs, solve
from .store import partitions, save, small_side, trimmed, work_dir
from .tokens import forget
from .words import LOWER, Words, batch_words, mix64, utf8

SIMILARITY, MINS = 0.8, 14
#: Lines of so many words have keys of words, those below FEW have keys of runs of bytes; between the two they have both.
LEAST, FEW, GRAM = 16, 22, 5
#: By the number of equal minimal hashes, the bits in which the SimHashes of candidates may differ, of words and of runs of bytes.
DISTANCE = np.array([[-1, -1, -1, -1, 14, 17, *[20] * 9], [-1, -1, -1, -1, 20, 23, *[26] * 9]])
#: Numbers of the minimal hashes that make a key, of neighbouring words and then of runs of bytes; keys are known by their place here.
KEYS = [[(i, (i + 1) % 14) for i in range(14)]] * 2
_PARTS = [np.array(numbers) for numbers in KEYS]
#: Bytes of text that are sketched together; bytes of records that a shard is meant for, and at which it is overfull; nodes of a long run;
#: bytes of a shard's occurrences at which those of a line become one.
TOGETHER, SHARD, OVERFULL, LONG, PLACES = 4_000_000, 64_000_000, 160_000_000, 4096, 16_000_000
#: Lines of a candidate group that one task holds.
BLOCK = 8192
#: Bytes of candidates' rows that are verified together, pairs whose distances wait for others, length of a line that goes alone, and the fewest pairs that
#: are worth a batch.
VERIFIED, DUE, LONG_LINE, FEWEST = 12_000_000, 8192, 4096, 4
#: Characters of candidate pairs whose bounds are computed together; an eighth as many characters of lines are counted together.
BOUNDED = 400_000
#: Lines of which it is kept what is counted.
COUNTED = 32768
#: The bound from below, by the limit, up to which a way to align a pair's words is looked for before its distance is due.
ALIGNED = 0.5
#: Rows of lines that are broadcast to the texts; beyond it the texts are shuffled to them, as they have to be at scale.
FEW_ROWS = 20_000
#: Words that two lines skip at a difference, the fewest first.
AHEAD = sorted(((a, b) for a in range(6) for b in range(6) if a or b), key=lambda x: (max(x), sum(x)))
RECORD = np.dtype([("key", "<u4"), ("node", "<u8"), ("sim", "<u8"), ("mins", "u1", (14,)), ("n", "<u2"), ("k", "u1")])
PLACE = np.dtype([("line", "<u8"), ("doc", "<i8"), ("no", "<i4"), ("repeats", "u1")])

FOLD = LOWER.copy()
FOLD[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20
FOLD[0x30:0x3A] = 0x30
_FOLD = FOLD.tobytes()
_G, _STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def normalised(line: str) -> str:
    return b" ".join(line.encode().translate(_FOLD).split()).decode()


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line offsets of a batch, line feeds being part of the line they end, and the row of each line."""
    feeds = np.flatnonzero(raw == 0x0A) + 1
    # A row has a line at its start, and one after each of its line feeds.
    row = np.concatenate((np.searchsorted(offsets[1:], feeds, "left"), np.arange(len(offsets) - 1)))
    at = np.concatenate((feeds, offsets[:-1]))
    order = np.lexsort((at, row))
    return np.append(at[order], offsets[-1]), row[order]


def line_hashes(w: Words, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A polynomial of the words' hashes of each row by prefix sums, mixed with their number."""
    n = max(len(hashes), 1)
    up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(_STEP)))))
    back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(_STEP, -1, 1 << 64))))))
    total = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    a, b = w.first[:-1][rows], w.first[1:][rows]
    return mix64((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of rows of hashes; `first` says where each row's begin. Ones are counted in bytes, eight at once, over up to 255
    hashes, and those counts are added."""
    out = np.empty(len(first) - 1, np.uint64)
    for i, j in _pieces(first, 1 << 15):
        start = first[i:j] - first[i]
        size = np.diff(first[i : j + 1])
        n = -(-size // 255)
        upto = np.cumsum(n)
        cut = np.repeat(start, n) + 255 * (np.arange(upto[-1]) - np.repeat(upto - n, n))
        ones = np.unpackbits(np.ascontiguousarray(hashes[first[i] : first[j]]).view(np.uint8)).view(np.uint64).reshape(-1, 8)
        count = np.add.reduceat(ones, cut, axis=0).view(np.uint8)
        total = np.add.reduceat(count, upto - n, axis=0, dtype=np.int32) if len(cut) > len(n) else count.astype(np.int32)
        out[i:j] = np.packbits(2 * total > size[:, None], axis=1).view(np.uint64).reshape(-1)
    return out


def taken(r: np.ndarray, at: np.ndarray) -> np.ndarray:
    """r[at] of records, copied whole; numpy copies them field by field."""
    return np.ascontiguousarray(r).view(f"V{r.dtype.itemsize}").take(at).view(r.dtype)


def _pieces(first: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` items, or one row."""
    i, n = 0, len(first) - 1
    while i < n:
        j = max(int(np.searchsorted(first, first[i] + size, "right")) - 1, i + 1)
        yield i, j
        i = j


def minima(hashes: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minimal hashes by row, each of its own multiplicative permutation of hashes that are well mixed already; no row is empty."""
    out = np.empty((n, len(first) - 1), np.uint64)
    salt = mix64((np.arange(2 * n, dtype=np.uint64) + np.uint64(1000 * seed + 1)) * _G)
    for i, j in _pieces(first, 1 << 15):
        h, start = hashes[first[i] : first[j]], first[i:j] - first[i]
        for k in range(n):
            out[k, i:j] = np.minimum.reduceat((h ^ salt[2 * k]) * (salt[2 * k + 1] | np.uint64(1)), start)
    return out


def joined(tables: list[np.ndarray], keys: list[tuple[int, ...]], seed: int) -> np.ndarray:
    """Keys by row, each of one row of every table."""
    out = np.empty((tables[0].shape[1], len(keys)), np.uint64)
    for k, parts in enumerate(keys):
        key = np.full(len(out), 1000 * seed + k, np.uint64)
        for t, i in zip(tables, parts, strict=True):
            key = mix64(key * _G + t[i])
        out[:, k] = key
    return out


def gram_hashes(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM bytes of some rows' words, joined by blanks between two edges and filled up to such a run; and where
    each row's begin."""
    size = np.diff(w.first)[rows]
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(w.first[:-1][rows] - first[:-1], size)
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), w.distinct.take(pa.array(w.codes[at])))
    joined = pc.binary_join_element_wise(b"\x01", pc.binary_join(lists, b" "), b"\x02" * (GRAM - 2), b"")
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(joined).to_numpy()))).astype(np.int64)
    raw = np.frombuffer(b"".join(joined.to_pylist()), np.uint8).astype(np.uint64)
    if not len(raw):
        return raw, ends
    n = len(raw) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h << np.uint64(8) | raw[i : i + n]
    keep = np.ones(n, bool)
    for i in range(1, GRAM):
        keep[ends[1:-1] - i] = False  # runs over the end of a row
    return mix64(h[keep] * _G), ends - (GRAM - 1) * np.arange(len(ends))


def sketches(w: Words, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of words, and of runs of bytes where there are few words: the rows (by number among those given, none of which is without
    words), their SimHashes and their minimal hashes."""
    words = np.diff(w.first)[rows]
    many, few = np.flatnonzero(words >= LEAST), np.flatnonzero(words < FEW)
    size = words[many]
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(w.first[:-1][rows[many]] - first[:-1], size)
    h = hashes[at]
    # The last word of a line has no right neighbour; its place repeats the pair before it.
    pairs = mix64(h * _G + np.append(h[1:], np.uint64(0))[: len(h)])
    pairs[first[1:] - 1] = pairs[first[1:] - 2]
    grams, begin = gram_hashes(w, rows[few]) if len(few) else (h[:0], first[:1])
    return [(many, simhash(h, first), minima(pairs, first, MINS, 1)), (few, simhash(grams, begin), minima(grams, begin, MINS, 2))]


def records(w: Words, hashes: np.ndarray, rows: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of some rows, whose nodes and lengths are given, and their whole keys."""
    keys, out = [], []
    for kind, (own, sim, mins) in enumerate(sketches(w, hashes, rows)):
        numbers = KEYS[kind]
        r = np.empty((len(own), len(numbers)), RECORD)
        keys.append(joined([mins] * len(numbers[0]), numbers, 1 + kind).reshape(-1))
        r["node"], r["sim"], r["n"] = node[own, None], sim[:, None], n[own, None]
        r["mins"] = (mins.T >> np.uint64(20)).astype(np.uint8)[:, None, :]
        r["k"] = np.arange(len(numbers)) + len(KEYS[0]) * kind
        out.append(r.reshape(-1))
    return np.concatenate(keys), np.concatenate(out)


def within(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - Levenshtein / longer length is at least `similarity`."""
    allowed = _allowed(a, b, similarity)
    if abs(len(a) - len(b)) > allowed:
        return False
    if surely(a, b, allowed):
        return True
    # What the letters' counts can't match bounds the distance from below.
    if _unmatched(a, b) > allowed:
        return False
    a, b = differing(a, b)
    return len(a) <= allowed or (bool(b) and levenshtein(a, b, allowed) <= allowed)


def _allowed(a: str, b: str, similarity: float = SIMILARITY) -> int:
    return int(max(len(a), len(b)) * (1 - similarity) + 1e-9)


def _all_allowed(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """_allowed() by lengths."""
    return (np.maximum(m, n) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def surely(a: str, b: str, allowed: int) -> bool:
    """Whether a bound of the distance from above is within `allowed`; near copies mostly end here."""
    # Word by word replacement is one, and one way to align the words, where some are dropped or added, is another.
    p, q = a.split(" "), b.split(" ")
    if len(p) == len(q) and sum(max(len(x), len(y)) for x, y in zip(p, q, strict=True) if x != y) <= allowed:
        return True
    return aligned(p, q, allowed) <= allowed


def differing(a: str, b: str) -> tuple[str, str]:
    """The longer and the shorter text without what both begin and end with."""
    if len(a) < len(b):
        a, b = b, a
    i, j = 0, len(b)
    while i < j:
        k = (i + j + 1) // 2
        i, j = (k, j) if a.startswith(b[i:k], i) else (i, k - 1)
    a, b = a[i:], b[i:]
    i, j = 0, len(b)
    while i < j:
        k = (i + j + 1) // 2
        i, j = (k, j) if a.endswith(b[len(b) - k : len(b) - i], 0, len(a) - i) else (i, k - 1)
    return a[: len(a) - i], b[: len(b) - i]


def aligned(p: list[str], q: list[str], enough: int) -> int:
    """The cost of one way from the words p to the words q, which bounds the distance from above: at a difference, the nearest place
    where both go on alike is looked for. Some number above `enough` as soon as the cost is."""
    i, j, m, n, cost = 0, 0, len(p), len(q), 0
    p, q = [*p, *[None] * 5], [*q, *[0] * 5]  # what lies past the ends is like nothing
    while i < m and j < n:
        if p[i] == q[j]:
            i, j = i + 1, j + 1
            continue
        best = (1, 1)
        for a, b in AHEAD:
            if p[i + a] == q[j + b] and (i + a + 1 >= m or j + b + 1 >= n or p[i + a + 1] == q[j + b + 1]):
                best = a, b
                break
        a, b = best
        cost += max(sum(map(len, p[i : i + a])) + a, sum(map(len, q[j : j + b])) + b) - (a > 0 and b > 0)
        if cost > enough:
            return cost
        i, j = i + a, j + b
    return cost + max(sum(map(len, p[i:m])) + m - i, sum(map(len, q[j:n])) + n - j)


def _unmatched(a: str, b: str) -> int:
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def _bits(x: int, n: int) -> np.ndarray:
    """The lowest n bits, from the lowest up."""
    return np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").astype(np.int32)


def levenshtein(a: str, b: str, enough: int | None = None) -> int:
    """Bit-parallel distance (Myers, 1999; Hyyro, 2003), with the longer word's bits in one integer; some number above `enough`
    as soon as the distance must be."""
    if len(a) < len(b):
        a, b = b, a
    m = len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    enough = m if enough is None else enough
    look = left_over = len(b)
    for ch in b:
        left_over -= 1
        eq = where.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right = down | ~(xh | up) & full
        left = up & xh
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | ~(xv | right) & full, right & xv
        if score - left_over > enough:
            return score - left_over
        if look - left_over >= 96 and enough < m:
            look = left_over
            # The whole column, each with what the rest of both texts differs in length, bounds the distance from below.
            column = len(b) - left_over + np.cumsum(_bits(up, m) - _bits(down, m))
            least = min(int((column + np.abs(np.arange(m - 1, -1, -1) - left_over)).min()), len(b) - left_over + abs(m - left_over))
            if least > enough:
                return least
    return score


def _sketch(shards: int):
    """Packed records by shard of the key, and packed occurrences by shard of the line."""

    def dealt(rows: np.ndarray, shard: np.ndarray, keys: bool) -> pa.RecordBatch:
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        rows, shard = taken(rows, order), shard[order]
        edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        ends = np.append(edges, len(shard)).astype(np.int32) * rows.itemsize
        bodies = pa.BinaryArray.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(ends), pa.py_buffer(rows.view(np.uint8))])
        return pa.record_batch([pa.array(shard[edges].astype(np.int32)), pa.array(np.full(len(edges), keys)), bodies], names=["shard", "keys", "body"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in sliced(batches, TOGETHER):
            raw, offsets = utf8(part.column(1))
            bounds, row = line_bounds(raw, offsets)
            w = batch_words(FOLD[raw], bounds, fold=False, coded=False)
            hashes = w.hashes
            keep = np.flatnonzero(np.diff(w.first))
            if not len(keep):
                continue
            line = line_hashes(w, hashes, keep)
            places = np.zeros(len(keep), PLACE)
            places["line"], places["no"] = line, (np.arange(len(row)) - np.searchsorted(row, row))[keep]
            places["doc"] = part.column(0).to_numpy()[row[keep]]
            # The first of a slice's equal lines has the keys; lengths are those in characters, with one blank between words.
            once = np.sort(np.unique(line, return_index=True)[1])
            chars = np.concatenate(([0], np.cumsum(pc.utf8_length(w.distinct.cast(pa.string())).to_numpy())))
            a, b = w.first[:-1][keep[once]], w.first[1:][keep[once]]
            keys, own = records(w, hashes, keep[once], line[once], np.minimum(chars[b] - chars[a] + b - a - 1, 65535))
            own["key"] = keys & np.uint64(0xFFFFFFFF)
            yield dealt(own, (keys >> np.uint64(32)) % np.uint64(shards), True)
            yield dealt(places, line % np.uint64(shards), False)

    return task


def sliced(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of about `size` bytes of text, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b


def _columns(r: np.ndarray) -> dict[str, np.ndarray]:
    """What candidates() reads, each in one piece."""
    return {c: np.ascontiguousarray(r[c]) for c in ("node", "sim", "mins", "n")}


def candidates(r: np.ndarray | Mapping[str, np.ndarray], i: np.ndarray, j: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Whether records that meet under key k are of different lines, near by SimHash, length and minimal hashes, and share no key
    before it."""
    k = np.broadcast_to(k, i.shape)
    ok = np.zeros(len(i), bool)
    # Most are told apart by their SimHashes.
    d = np.bitwise_count(r["sim"][i] ^ r["sim"][j])
    at = np.flatnonzero(d <= np.where(k >= len(KEYS[0]), *DISTANCE[::-1, -1].astype(np.uint8)))
    i, j, k, d = i[at], j[at], k[at], d[at]
    late = (k >= len(KEYS[0])).astype(np.int64)
    a, b = r["n"][i].astype(np.int64), r["n"][j].astype(np.int64)
    good = np.flatnonzero((r["node"][i] != r["node"][j]) & (np.abs(a - b) <= np.maximum(a, b) * (1 - SIMILARITY) + 1e-6))
    at, i, j, k, d, late = (x[good] for x in (at, i, j, k, d, late))
    mins = np.ascontiguousarray(r["mins"])
    same = mins.take(i, axis=0) == mins.take(j, axis=0)
    good = d <= DISTANCE[late, same.sum(axis=1)]
    at, same, k, late = at[good], same[good], k[good], late[good]
    for kind, parts in enumerate(_PARTS):
        mine = late == kind
        if mine.any():
            shared = same[mine][:, parts].all(axis=2)
            ok[at[mine]] = shared.argmax(axis=1) + len(KEYS[0]) * kind >= k[mine]
    return ok


def _spread(r: Mapping[str, np.ndarray], n: int, k: int) -> np.ndarray:
    """Labels of the connected groups of a run of n records: some records at once are held against all later ones, or in a long run
    each reached record against those not yet reached."""
    label, left = np.arange(n), np.arange(n)
    if n <= LONG:
        step = max(1, (1 << 15) // n)
        for a in range(0, n - 1, step):
            i, j = np.nonzero(np.arange(a, min(a + step, n - 1))[:, None] < np.arange(n))
            apart = label[i + a] != label[j]
            i, j = i[apart] + a, j[apart]
            near = candidates(r, i, j, k)
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
        return label
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = candidates(r, np.full(len(left), queue.pop()), left, k)
            if near.any():
                label[left[near]] = root
                queue += left[near].tolist()
                left = left[~near]
    return label


def candidate_groups(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members (group, node, key's place and group's size) of the connected groups of each key's run; short runs are compared all at once,
    by distance in the order."""
    if len(r) < 1 << 24:
        # Most keys have one record; it takes a sort of keys alone, with places below them, to leave those out.
        x = np.sort((r["key"].astype(np.uint64) << np.uint64(8) | r["k"]) << np.uint64(24) | np.arange(len(r), dtype=np.uint64))
        again = (x[1:] >> np.uint64(24)) == (x[:-1] >> np.uint64(24))
        met = np.zeros(len(r), bool)
        met[1:] = again
        met[:-1] |= again
        r = taken(r, (x[met] & np.uint64((1 << 24) - 1)).astype(np.int64))
    r = taken(r, np.lexsort((r["node"], r["k"], r["key"])))
    new = np.ones(len(r), bool)
    other = (r["key"][1:] != r["key"][:-1]) | (r["k"][1:] != r["k"][:-1])
    new[1:] = other | (r["node"][1:] != r["node"][:-1])
    r = taken(r, np.flatnonzero(new))
    starts = np.flatnonzero(np.concatenate(([True], (r["key"][1:] != r["key"][:-1]) | (r["k"][1:] != r["k"][:-1])))[: len(r)])
    size = np.diff(np.append(starts, len(r)))
    label, c = np.arange(len(r)), _columns(r)
    end = np.repeat(starts + size, size)
    short = np.repeat((size > 1) & (size <= 64), size)
    pairs, at, d = [np.empty((0, 2), np.int64)], np.flatnonzero(short), 1
    while len(at := at[end[at] - at > d]):
        hit = at[candidates(c, at, at + d, r["k"][at])]
        pairs.append(np.stack((hit, hit + d), axis=1))
        d += 1
    found = np.concatenate(pairs)
    while len(found):
        least = np.minimum(label[found[:, 0]], label[found[:, 1]])
        new = label.copy()
        np.minimum.at(new, found[:, 0], least)
        np.minimum.at(new, found[:, 1], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for a, n in zip(starts[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        label[a : a + n] = a + _spread({name: x[a : a + n] for name, x in c.items()}, n, int(r["k"][a]))
    members = np.bincount(label, minlength=len(r))
    some = np.flatnonzero(members[label] > 1)
    root = label[some]
    group = mix64(mix64(r["key"][root].astype(np.uint64) * _G + r["k"][root]) + r["node"][root])
    return group, r["node"][some], r["k"][some], members[root]


def _bodies(r: np.ndarray) -> pa.BinaryArray:
    """Each record's bytes."""
    ends = np.arange(len(r) + 1, dtype=np.int32) * r.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(r).view(np.uint8))])


def _rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, size: np.ndarray | None = None, body: np.ndarray | None = None) -> pa.RecordBatch:
    bodies = pa.nulls(len(a), pa.binary()) if body is None else _bodies(body)
    sizes = pa.nulls(len(a), pa.int32()) if size is None else pa.array(size.astype(np.int32))
    long = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), *long, pa.array(n.astype(np.int32)), sizes, bodies], names=["kind", "a", "b", "n", "size", "body"])


OCCURRENCE, MEMBER, DEFERRED, FIRST = 0, 1, 2, 3


def first_places(p: np.ndarray) -> np.ndarray:
    """Of each line the first place, and whether there are more."""
    p = taken(p, np.lexsort((p["no"], p["doc"], p["line"])))
    at = np.flatnonzero(np.concatenate(([True], p["line"][1:] != p["line"][:-1]))[: len(p)])
    out = taken(p, at)
    if len(out):
        out["repeats"] = np.maximum.reduceat(p["repeats"], at) | (np.diff(np.append(at, len(p))) > 1)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (line, doc_id, line number) as they come, each line's first one (and whether it repeats) and the members (group, node,
    key's place) of each shard at the end, and records of keys (node, key, its place, record) that are left to later tasks, since an
    overfull shard mustn't be held."""
    places: dict[int, list[np.ndarray]] = {}
    more: dict[int, int] = {}
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    hot: dict[int, np.ndarray] = {}

    def deferred(shard: int, r: np.ndarray) -> pa.RecordBatch:
        return _rows(DEFERRED, r["node"], r["key"].astype(np.uint64) | np.uint64(shard) << np.uint64(32), r["k"], body=r)

    for batch in batches:
        for shard, keys, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not keys:
                p = np.frombuffer(body, PLACE)
                yield _rows(OCCURRENCE, p["line"], p["doc"], p["no"])
                places.setdefault(shard, []).append(p)
                more[shard] = more.get(shard, 0) + p.nbytes
                # A frequent line's occurrences become one before there are many; the next look is after as much again.
                if more[shard] > PLACES:
                    places[shard] = [first_places(np.concatenate(places[shard]))]
                    more[shard] = -places[shard][0].nbytes
                continue
            r = np.frombuffer(body, RECORD)
            if shard in hot and (late := np.isin(r["key"], hot[shard])).any():
                yield deferred(shard, r[late])
                r = r[~late]
            held.setdefault(shard, []).append(r)
            size[shard] = size.get(shard, 0) + r.nbytes
            if size[shard] > OVERFULL:
                r = np.concatenate(held[shard])
                key, n = np.unique(r["key"], return_counts=True)
                hot[shard] = np.union1d(hot.get(shard, key[:0]), key[n > LONG])
                late = np.isin(r["key"], hot[shard])
                yield deferred(shard, r[late])
                held[shard] = [r[~late].copy()]
                size[shard] = held[shard][0].nbytes // 2  # the next look is after as much again
    for shard in list(places):
        p = first_places(np.concatenate(places.pop(shard)))
        yield _rows(FIRST, p["line"], p["doc"], p["no"], p["repeats"])
    for shard in list(held):
        group, node, k, size_of = candidate_groups(np.concatenate(held.pop(shard)))
        if len(group):
            yield _rows(MEMBER, group, node, k, size_of)


def _late_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, "task"):
        r = np.frombuffer(b"".join(table.column("body").to_pylist()), RECORD)
        group, node, k, size_of = candidate_groups(r)
        if len(group):
            task = mix64(table.column("task").to_numpy()[:1].view(np.uint64))
            yield _rows(MEMBER, mix64(group + task), node, k, size_of)


def _counts(text: list[str]) -> np.ndarray:
    """Counts of the pairs of letters, by class, and then of the letters, by text; none is empty."""
    size = np.fromiter(map(len, text), np.int64, len(text))
    x = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(text)), size)
    out = np.empty((len(text), 768), np.int32)
    of_pair = (x[1:] * np.uint32(31) + x[:-1]) * np.uint32(0x9E3779B1) >> np.uint32(7) & np.uint32(511)
    within_row = np.ones(len(of_pair), bool)
    within_row[np.cumsum(size)[:-1] - 1] = False
    out[:, :512] = np.bincount((row[:-1] * 512 + of_pair)[within_row], minlength=512 * len(text)).reshape(-1, 512)
    out[:, 512:] = np.bincount(row * 256 + (x & np.uint32(255)), minlength=256 * len(text)).reshape(-1, 256)
    return out


def _apart(text: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds of the distances from below: an edit changes two pairs of letters of either text at most, and one letter."""
    rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    text = [text[x] for x in rows.tolist()]
    return _bounds(_counts(text), np.fromiter(map(len, text), np.int64, len(text)), at[: len(i)], at[len(i) :], np.arange(len(text)))


def _bounds(counts: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The bounds of _apart() by lines' lengths and counts, which stand at a place and may be cut off at some number; of pairs of letters
    a line has one less than of letters."""
    out = np.empty(len(i))
    for a in range(0, len(i), 64):
        x, y = i[a : a + 64], j[a : a + 64]
        d = np.abs(counts.take(place[x], axis=0) - counts.take(place[y], axis=0))
        # What one text has more and what the other has more differ by the lengths.
        more = np.abs(length[x] - length[y])
        pairs, letters = ((half.sum(axis=1, dtype=np.int32) + more) / 2 for half in (d[:, :512], d[:, 512:]))
        out[a : a + 64] = np.maximum(pairs / 2, letters)
    return out


class _Lines:
    """Lines of some tasks, a run of rows each: which are connected, by pairs whose similarity is sure and pairs whose distance is due."""

    def __init__(self, text: list[str], first: np.ndarray):
        self.text, self.label, self.out, self.due, self.n_due = text, np.arange(len(text)), [], [], 0
        self.length = np.fromiter(map(len, text), np.int64, len(text))
        self.start = np.cumsum(self.length) - self.length
        self.counts, self.counted, self.place = np.empty((0, 768), np.int16), 0, np.full(len(text), -1)
        self.codes, _, self.letters_in_use = lettered(*[np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)] * 2)
        w = batch_words(*utf8(pa.array(text, pa.string())), fold=False, coded=False)
        self.word, self.begin, self.letters = w.hashes, w.first, pc.utf8_length(w.distinct.cast(pa.string())).to_numpy()
        self.upto = np.concatenate(([0], np.cumsum(self.letters + 1)))  # each word with a blank
        size = np.diff(first)
        self.lo, self.hi = np.repeat(first[:-1], size).tolist(), np.repeat(first[1:], size).tolist()

    def join(self, i: int, j: int) -> None:
        own = self.label[self.lo[i] : self.hi[i]]
        own[own == self.label[j]] = self.label[i]
        self.out.append((i, j))

    def surely(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether a bound of the distance from above is within the limit: word by word replacement, or that of all words between
        those that both begin and those that both end with."""
        return self.compared(i, j, limit)[0]

    def compared(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """surely(), and how many characters the words have that both begin and that both end with."""
        a, m, b, n = self.begin[i], np.diff(self.begin)[i], self.begin[j], np.diff(self.begin)[j]
        both = np.minimum(m, n)
        at = np.cumsum(both) - both
        k = np.arange(both.sum()) - np.repeat(at, both)
        x, y = np.repeat(a, both) + k, np.repeat(b, both) + k
        other = self.word[x] != self.word[y]
        one_by_one = np.add.reduceat(np.maximum(self.letters[x], self.letters[y]) * other, at)
        far = int(both.max())
        head = np.minimum(np.minimum.reduceat(np.where(other, k, far), at), both)
        x, y = np.repeat(a + m - 1, both) - k, np.repeat(b + n - 1, both) - k
        tail = np.minimum(np.minimum.reduceat(np.where(self.word[x] != self.word[y], k, far), at), both - head)
        left, right = (self.upto[z + size - tail] - self.upto[z + head] for z, size in ((a, m), (b, n)))
        between = np.maximum(left, right) - ((left > 0) & (right > 0))
        # Each of these words comes with its blank, of which the shorter line may have one less.
        short = np.minimum(self.length[i], self.length[j])
        begins = np.minimum(self.upto[a + head] - self.upto[a], short)
        ends = np.minimum(self.upto[a + m] - self.upto[a + m - tail], short - begins)
        return ((m == n) & (one_by_one <= limit)) | (between <= limit), begins, ends

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """_apart(); what is counted of a line is kept, for so many lines at least."""
        rows = np.unique(np.concatenate((i, j)))
        new = rows[self.place[rows] < 0]
        if self.counted + len(new) > COUNTED:
            self.place[:], self.counted, new = -1, 0, rows
        upto = self.counted + len(new)
        if upto > len(self.counts):
            self.counts = np.concatenate((self.counts[: self.counted], np.empty((max(len(new), min(COUNTED, 2 * upto) - self.counted), 768), np.int16)))
        for lo, hi in _pieces(np.concatenate(([0], np.cumsum(self.length[new]))), BOUNDED // 8):
            self.counts[self.counted + lo : self.counted + hi] = np.minimum(_counts([self.text[x] for x in new[lo:hi].tolist()]), 32767)
        self.place[new] = np.arange(self.counted, upto)
        self.counted = upto
        return _bounds(self.counts, self.length, i, j, self.place)

    def part(self, i: int, begins: int, ends: int) -> str:
        return self.text[i][begins : self.length[i] - ends]

    def consider(self, i: np.ndarray, j: np.ndarray) -> None:
        """Candidate pairs of rows, in this order; what they are held against first is computed for some pairs at once."""
        m, n = self.length[i], self.length[j]
        allowed = _all_allowed(m, n)
        fit = np.abs(m - n) <= allowed
        i, j, allowed = i[fit], j[fit], allowed[fit]
        for lo, hi in _pieces(np.concatenate(([0], np.cumsum((m + n)[fit]))), BOUNDED):
            x, y, limit = i[lo:hi], j[lo:hi], allowed[lo:hi]
            open_ = self.label[x] != self.label[y]
            x, y, limit = x[open_], y[open_], limit[open_]
            if not len(x):
                continue
            sure, begins, ends = self.compared(x, y, limit)
            for a, b in zip(x[sure].tolist(), y[sure].tolist(), strict=True):
                if self.label[a] != self.label[b]:
                    self.join(a, b)
            open_ = self.label[x] != self.label[y]
            x, y, limit, begins, ends = (z[open_] for z in (x, y, limit, begins, ends))
            if not len(x):
                continue
            bound = self.apart(x, y)
            due = bound <= limit
            # Only lines whose letters are much alike are worth a look for the words that were dropped or added.
            for z in np.flatnonzero(bound <= ALIGNED * limit).tolist():
                a, b, most = int(x[z]), int(y[z]), int(limit[z])
                if self.label[a] != self.label[b]:
                    p, q = (self.part(r, begins[z], ends[z]).split(" ") for r in (a, b))
                    if aligned(p, q, most) <= most:
                        self.join(a, b)
            due &= self.label[x] != self.label[y]
            self.due.append(np.stack((x, y, begins, ends))[:, due])
            self.n_due += int(due.sum())
            if self.n_due > DUE:
                self.settle()

    def settle(self) -> None:
        """Distances of what is due, many at once; first two pairs of any two connected groups, as the others may not be needed."""
        due, most = np.concatenate([np.empty((4, 0), np.int64), *self.due], axis=1), 2
        self.due, self.n_due = [], 0
        while due.shape[1]:
            x, y = self.label[due[0]], self.label[due[1]]
            due, x, y = due[:, x != y], x[x != y], y[x != y]
            order = np.lexsort((np.maximum(x, y), np.minimum(x, y)))
            due, x, y = due[:, order], np.minimum(x, y)[order], np.maximum(x, y)[order]
            new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)])
            now = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x)))) < most
            taken = due[:, now]
            for a, b in taken[:2, self.near(*taken)].T.tolist():
                if self.label[a] != self.label[b]:
                    self.join(a, b)
            due, most = due[:, ~now], 4 * most

    def near(self, i: np.ndarray, j: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """within() without its bounds, of pairs of which both begin and both end with so many equal characters."""
        swap = self.length[i] < self.length[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        limit = _all_allowed(self.length[i], self.length[j])
        m, n = self.length[i] - begins - ends, self.length[j] - begins - ends
        out = m <= limit
        left = np.flatnonzero(~out & (n > 0) & (m - n <= limit))
        batches = [[x] for x in np.flatnonzero(m[left] > LONG_LINE).tolist()]
        some = np.flatnonzero(m[left] <= LONG_LINE)
        batches += [some[x].tolist() for x in like_sized(m[left][some].tolist())]
        for batch in batches:
            at = left[batch]
            if len(at) < FEWEST:
                for z in at.tolist():
                    a, b = differing(self.part(i[z], begins[z], ends[z]), self.part(j[z], begins[z], ends[z]))
                    out[z] = len(a) <= limit[z] or (bool(b) and levenshtein(a, b, int(limit[z])) <= limit[z])
                continue
            long, short = (self.codes[np.repeat(self.start[r[at]] + begins[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())] for r, size in ((i, m), (j, n)))
            letters = self.letters_in_use
            if self.codes.itemsize > 1:
                long, short, letters = lettered(long, short)
            out[at] = within_limits_of(long, m[at], short, n[at], limit[at], letters)
        return out


def _similar_lines(table: pa.Table) -> list[tuple[int, int]]:
    """Spanning links of the tasks of a table, whose rows stand together."""
    text, task, n = table.column("text").to_pylist(), table.column("task").to_numpy(), table.num_rows
    c = _columns(np.frombuffer(b"".join(table.column("body").to_pylist()), RECORD))
    k = table.column("k").to_numpy().astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [n]))
    own = _Lines(text, first)
    # Short runs are compared all at once, by distance in the order.
    size = np.diff(first)
    end = np.repeat(first[1:], size)
    at, d, pairs = np.flatnonzero(np.repeat(size <= 64, size)), 1, [np.empty((2, 0), np.int64)]
    while len(at := at[end[at] - at > d]):
        hit = at[candidates(c, at, at + d, k[at])]
        pairs.append(np.stack((hit, hit + d)))
        d += 1
    i, j = np.concatenate(pairs, axis=1)
    order = np.lexsort((j, i))
    own.consider(i[order], j[order])
    for lo, m in zip(first[:-1][size > 64].tolist(), size[size > 64].tolist(), strict=True):
        # Rows of the run are held against all later ones, some at once.
        step = max(1, 1 << 14 >> m.bit_length())
        for a in range(0, m - 1, step):
            i, j = np.nonzero(np.arange(a, min(a + step, m - 1))[:, None] < np.arange(m))
            i, j = i + lo + a, j + lo
            apart = own.label[i] != own.label[j]
            i, j = i[apart], j[apart]
            near = candidates(c, i, j, k[lo])
            own.consider(i[near], j[near])
    own.settle()
    return own.out


def _packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a document as one row, of which a document has as many as lines at most; for a broadcast join if they are few."""
    out = df.groupBy("doc_id").agg(F.collect_set(F.struct(*columns)).alias("_lines"))
    return F.broadcast(out) if df.count() <= FEW_ROWS else out.hint("merge")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted lines with their text and sketch."""
    for batch in batches:
        lists = batch.column(1)
        wanted = lists.flatten()
        line_no, line, group, k, size = (wanted.field(wanted.type.get_field_index(c)).to_numpy() for c in ("line_no", "line", "set", "k", "size"))
        if not len(line):
            continue
        # A line that stands in some groups is read and sketched once.
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        once, which = np.unique(row << 32 | line_no, return_inverse=True)
        text, last, own = [], -1, []
        for r, no in zip((once >> 32).tolist(), (once & 0xFFFFFFFF).tolist(), strict=True):
            if r != last:
                own, last = batch.column(0)[r].as_py().split("\n"), r
            text.append(normalised(own[no]) if no < len(own) else "")
        text = pa.array(text, pa.string())
        w = batch_words(*utf8(text), fold=False, coded=False)
        hashes = w.hashes
        # Another row with the same doc_id may have another line there, or none.
        some = np.diff(w.first) > 0
        there = np.flatnonzero(some[which] & (line_hashes(w, hashes, np.arange(len(once)))[which].view(np.int64) == line))
        if not len(there):
            continue
        which, line, group, k, size = (x[there] for x in (which, line, group, k, size))
        text = text.take(pa.array(which))
        own = np.zeros(len(there), RECORD)
        own["node"], own["n"] = line.view(np.uint64), np.minimum(pc.utf8_length(text).to_numpy(), 65535)
        rows = np.flatnonzero(some)
        late, at = k >= len(KEYS[0]), np.searchsorted(rows, which)
        for mine, (have, sim, mins) in zip((~late, late), sketches(w, hashes, rows), strict=True):
            place = np.searchsorted(have, at[mine])
            own["sim"][mine], own["mins"][mine] = sim[place], (mins.T >> np.uint64(20)).astype(np.uint8).take(place, axis=0)
        yield pa.record_batch([pa.array(line), pa.array(group), pa.array(k), pa.array(size), text, _bodies(own)], names=["node", "set", "k", "size", "text", "body"])


MET = "kind int, a long, b long, n int, size int, body binary"


def dropped_lines(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, line_no) of the occurrences that go."""
    spark = docs.sparkSession
    n = partitions(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(n, -(-2 * size // SHARD))
    packed = plain.mapInArrow(trimmed(_sketch(shards)), "shard int, keys boolean, body binary").repartitionById(shards, F.col("shard"))
    met = save(packed.mapInArrow(trimmed(_meet), MET), folder, "met")
    place = F.struct("doc_id", "line_no")
    rows = met.where(F.col("kind") == OCCURRENCE).select(F.col("a").alias("line"), F.col("b").alias("doc_id"), F.col("n").alias("line_no"))
    late = met.where(F.col("kind") == DEFERRED).select(F.col("a").alias("node"), F.col("b").alias("key"), "body")
    members = met.where(F.col("kind") == MEMBER)
    if not late.isEmpty():
        tasks = blocks(late.distinct(), "key", "node", LONG).repartition(n, "task").sortWithinPartitions("task")
        members = members.unionByName(tasks.select("task", "body").mapInArrow(trimmed(_late_groups), MET))
    members = save(members.select(F.col("b").alias("line"), F.col("a").alias("set"), F.col("n").alias("k"), "size"), folder, "members")
    nodes = met.where(F.col("kind") == FIRST).select(F.col("a").alias("line"), F.struct(F.col("b").alias("doc_id"), F.col("n").alias("line_no")).alias("place"), (F.col("size") > 0).alias("repeats"))
    wanted = save(nodes.join(small_side(members), "line").select("place.doc_id", "place.line_no", "line", "set", "k", "size"), folder, "wanted")
    read = plain.join(_packed(wanted, ["line_no", "line", "set", "k", "size"]), "doc_id").select("text", "_lines").mapInArrow(trimmed(_texts), "node long, set long, k int, size int, text string, body binary")
    # A group beyond BLOCK is dealt into blocks, and each pair of blocks is a task of its own.
    if wanted.where(F.col("size") > BLOCK).isEmpty():
        tasks = read.withColumnRenamed("set", "task")
    else:
        read = save(read, folder, "texts")
        tasks = read.where(F.col("size") <= BLOCK).withColumnRenamed("set", "task").unionByName(blocks(read.where(F.col("size") > BLOCK), "set", "node", BLOCK // 2).drop("set"))
    links = connected_components(solve(tasks, _similar_lines, n, VERIFIED), folder, "lines")
    links = small_side(save(links.withColumnRenamed("node", "line"), folder, "linked"))
    # Only lines that repeat or are linked can go.
    final = nodes.join(links, "line", "left").where("repeats or component is not null").withColumn("component", F.coalesce("component", "line"))
    final = save(final.select("line", "component", "place"), folder, "final")
    first = final.groupBy("component").agg(F.min("place").alias("stays"))
    keep = small_side(save(final.join(first, "component").select("line", "stays"), folder, "keep"))
    return rows.join(keep, "line").where(place != F.col("stays")).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with repeated lines taken out of their text, and n_lines and n_removed added."""
    spark = docs.sparkSession
    folder = work_dir(spark, "lines")
    gone = save(dropped_lines(docs.select("doc_id", F.col(text).alias("text")), folder), folder, "gone")
    names = [n if n not in docs.columns else f"dedup_{n}" for n in ("n_lines", "n_removed")]
    key, extra = next(n for n in ("_doc", "_dedup_doc", "_own_doc") if n not in docs.columns), next(n for n in ("_lines", "_dedup_lines", "_own_lines") if n not in docs.columns)
    packed = _packed(gone, ["line_no"]).withColumnsRenamed({"doc_id": key, "_lines": extra})
    marked = docs.join(packed, docs["doc_id"].cast("long") == packed[key], "left").drop(key)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            column = batch.column(i)
            raw, offsets = utf8(column)
            lines = np.diff(np.searchsorted(np.flatnonzero(raw == 0x0A), offsets)) + 1
            lines[np.diff(offsets) == 0] = 0
            removed = np.zeros(len(column), np.int64)
            lists = batch.column(batch.schema.get_field_index(extra))
            new = {}
            for k in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if column[k].is_valid:
                    drop = {x["line_no"] for x in lists[k].as_py()}
                    old = column[k].as_py().split("\n")
                    stay = [x for no, x in enumerate(old) if no not in drop]
                    new[k], removed[k] = "\n".join(stay), len(old) - len(stay)
            if new:
                mask = np.zeros(len(column), bool)
                mask[list(new)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(new.values()), column.type))
            arrays = [column if k == i else batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != extra]
            yield pa.record_batch([*arrays, pa.array(lines), pa.array(removed)], names=[*(n for n in batch.schema.names if n != extra), *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return marked.mapInArrow(trimmed(task), schema)
