"""Best-fit packing of token pieces into sequences, after a Martello-Toth dominance reduction.

A piece is a document's ids with an end id, cut only where it is longer than a sequence. The problem depends on the lengths
alone, so the pieces are counted by length: at most `capacity` numbers come to the driver, whatever the number of documents.
The plan works on whole classes of equal bins:
  * reduction: for the largest length w left, if a set {w}, {w, a} or {w, a, c} dominates every other set that fits with w
    (each item of the other set, or several together, fits in place of one of its items), as many such bins as there are
    items are fixed, and those items leave the instance;
  * the rest goes best-fit in descending length: into the fullest open bin where it still fits.
Each piece then gets a rank among those of its length, and the plan maps ranks of a length to sequences and offsets.

Defined results: null is the empty text and makes one piece, the end id; repeated rows are packed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions, save, trimmed
from .tokens import encoder, forget_idle

CAPACITY = 4096
END_ID = 1


@dataclass
class Bins:
    """`count` bins of the same content: (length, how many of it in each bin)."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)
    fixed: bool = False


def reduce_instance(left: dict[int, int], capacity: int) -> list[Bins]:
    """Fixes dominating sets of up to three items; takes their items out of `left`."""
    done: list[Bins] = []

    def fix(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(left[x] // k for x, k in need.items())
        done.append(Bins(n, sorted(need.items(), reverse=True), True))
        for x, k in need.items():
            left[x] -= n * k
            if not left[x]:
                del left[x]

    for w in sorted(left, reverse=True):
        while w in left:
            room = capacity - w
            rest = sorted(x for x in left if x != w or left[w] > 1)
            fits = rest[: bisect_right(rest, room)]
            if not fits:
                fix(w)
                continue
            a = fits[-1]
            have = lambda x: left[x] - (x == w)
            small: list[int] = []
            for x in fits:
                small += [x] * min(have(x), 3 - len(small))
                if len(small) == 3:
                    break
            if a == room or len(small) < 2 or small[0] + small[1] > room:
                fix(w, a)
                continue
            if len(small) == 3 and sum(small) <= room:
                break  # four or more items may share the bin: no test here
            # At most two items go with w. For each y the largest x >= y that fits with it.
            pairs = []
            for y in fits:
                i = bisect_right(fits, room - y) - 1
                if i < 0 or fits[i] < y:
                    break
                x = fits[i]
                if x == y and have(x) < 2:
                    continue
                pairs.append((x, y))
            best = max((x + y for x, y in pairs), default=0)
            if a >= best:
                fix(w, a)
                continue
            c = max((y for x, y in pairs if x == a), default=0)
            if c and all(y <= c or x + y <= a for x, y in pairs):
                fix(w, a, c)
                continue
            break
    return done


def best_fit(left: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing over classes of equal bins; a bit mask has the residuals of which bins are open."""
    open_: dict[int, list[Bins]] = {}
    mask = 0
    done: list[Bins] = []

    def put(b: Bins, residual: int) -> None:
        nonlocal mask
        if residual:
            open_.setdefault(residual, []).append(b)
            mask |= 1 << residual
        else:
            done.append(b)

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            above = mask >> w
            if above:
                r = w + (above & -above).bit_length() - 1
                b = open_[r].pop()
                if not open_[r]:
                    del open_[r]
                    mask &= ~(1 << r)
            else:
                r, b = capacity, Bins(n)
            q = r // w
            whole = min(b.count, n // q)
            used = whole
            if whole:
                put(Bins(whole, [*b.items, (w, q)]), r - q * w)
                n -= whole * q
            if whole < b.count and n and n < q:
                put(Bins(1, [*b.items, (w, n)]), r - n * w)
                used, n = used + 1, 0
            if b.count > used and b.items:
                put(Bins(b.count - used, b.items), r)
    return done + [b for bs in open_.values() for b in bs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Bins], int]:
    """Bins by class, and how many of all bins the reduction has fixed."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    if left and max(left) > capacity:
        raise ValueError("an item is longer than a sequence")
    fixed = reduce_instance(left, capacity)
    return fixed + best_fit(left, capacity), sum(b.count for b in fixed)


def _lookup(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, bins' items of that length, sequence of the first bin, offset in it), by length and rank."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for b in bins:
        offset = 0
        for w, q in b.items:
            rows.append((w, rank.get(w, 0), q, base, offset))
            rank[w] = rank.get(w, 0) + b.count * q
            offset += w * q
        base += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; the texts are not shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(vocabulary).column(batch.column(1))):
                ids = np.concatenate((ids, end)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    which.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget_idle()

    return docs.select("doc_id", "text").mapInArrow(trimmed(task), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; `folder` gets the pieces as a table, so they are made once."""
    spark = cut.sparkSession
    table = save(cut, folder, "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    bins, _ = plan(counts, capacity)
    lookup = spark.sparkContext.broadcast(_lookup(bins))  # grows with the number of lengths, not of documents
    # The rank among equal lengths: counted within buckets, which start where the buckets before them end.
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(8 * partitions(spark))))
    sizes = dealt.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("rank", inner - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lookup.value
        keys = (at[:, 0] << 44) | at[:, 1]
        for batch in batches:
            w, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = at[np.searchsorted(keys, (w << 44) | rank, "right") - 1]
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + slot * w)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
