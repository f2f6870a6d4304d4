"""MinHash near-dedup with bottom-k sketches of one hash function.

Each document is the set of its distinct shingle hashes; its sketch is the k smallest. Linked are documents with
100 * |A & B| >= percent * |A | B|, found in a funnel in which every stage moves a document once:
  1. documents with equal sets are one class, from here on stood for by its smallest doc_id;
  2. inverted lists: retained values, taken three neighbours at a time, are the keys of lists of classes, and lists connect
     those of their classes whose 64-bit signatures (size and bits) are near (lost with a probability below 1e-6) into coarse groups. Of two sets with likeness J, each of the first t values of their union is in both with
     probability J, so for J = 0.85 and t = 48 no three neighbours in a row are shared with a probability below 1e-9 (1e-7 for J = 0.8); sets of
     up to 50 values, whose sketches are the sets, use single values of an exact prefix instead, and lose nothing;
  3. union-sketch estimation: the share of the k smallest values of the union that both sketches have, within five standard
     deviations of the threshold, splits the coarse groups;
  4. exact Jaccard on the full sets, inside the groups that are left, gives the links; their components are the result.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows with the same doc_id are
one document for the components, and each row is returned; a null doc_id is linked with nothing and kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import Union, blocks, connected_components, solve
from .store import partitions, save, small_side, trimmed, work_dir
from .words import batch_words, mix64, run_hashes, shingle_sets, utf8

K = 128
T = 48
RUN = 3
SMALL = 50
FEW, LIST, BITS = 64, 8192, 52
_SINGLE = np.uint64(0x5851F42D4C957F2D)


def sketch_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the inverted lists of an ascending set; see stage 2."""
    n = len(s)
    keys = [run_hashes(s[:T], RUN)]
    if n <= SMALL * 100 // percent + 1:
        # Two sets with the overlap asked for share a value among the smallest n - ceil(n * percent / 100) + 1 of each.
        prefix = n - -(-n * percent // 100) + 1
        keys.append(mix64(s[:prefix] ^ _SINGLE))
    return np.concatenate(keys)


def _sets(docs: DataFrame, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(batch_words(*utf8(part.column(1))), width)
                ids = [None if not len(s) else hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.record_batch([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary()), pa.array(np.array([signature(s) for s in sets], np.uint64).view(np.int64))], names=["doc_id", "n_shingles", "set_id", "sketch", "sign"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(task), "doc_id long, n_shingles long, set_id binary, sketch binary, sign long")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(batch_words(*utf8(part.column(1))), width)
                yield pa.record_batch([part.column(0), part.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "component", "members"])

    return docs.mapInArrow(trimmed(task), "node long, component long, members binary")


def signature(s: np.ndarray) -> int:
    """12 bits of size, exact below FEW and logarithmic above, and BITS bits: one of the least value in each of as many ranges of
    hashes, in which near sets differ little."""
    n = len(s)
    size = n if n < FEW else FEW + round(64 * math.log2(n / FEW))
    bits = np.zeros(64, np.uint8)
    if n:
        bins = ((s >> np.uint64(32)) * np.uint64(BITS) >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        bits[12 + bins[new]] = (mix64(s[new]) & np.uint64(1)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0]) | size << BITS


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures allow for the likeness: sizes within its ratio; no more differing bits than values that only one set
    may have; and, where sets are large, than five standard deviations above the mean."""
    a, b = np.broadcast_arrays(a, b)
    na, nb = (np.where(c < FEW, c, FEW * 2.0 ** ((c - FEW) / 64)) for c in ((x >> np.uint64(BITS)).astype(float) for x in (a, b)))
    differ = np.bitwise_count((a ^ b) & np.uint64((1 << BITS) - 1))
    p = 0.6 * (100 - percent) / 100
    most = np.where(np.minimum(na, nb) < FEW, 64, BITS * p + 5 * (BITS * p * (1 - p)) ** 0.5)
    alone = 1.02 * (na + nb) * (100 - percent) / (100 + percent)
    return (100 * np.minimum(na, nb) >= 0.98 * percent * np.maximum(na, nb)) & (differ <= np.minimum(most, alone))


def _spread(node: np.ndarray, sign: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links of a list's nodes under the signatures' distance: each node is held against those not yet reached."""
    left = np.arange(len(node))
    out = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _near(sign[left], sign[i], percent)
            if near.any():
                found = left[near].tolist()
                out += [(int(node[j]), int(node[i])) for j in found]
                queue += found
                left = left[~near]
    return out


def _coarse_links(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside each list, in rows sorted by key. A list of more than LIST nodes is linked through, one node with the
        next, as it comes by: more than is needed, which the later stages take apart."""
        hk, hn, hs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        chained: tuple[int, int] | None = None  # key and last node of a list that is linked through

        def lists(k: np.ndarray, v: np.ndarray, g: np.ndarray) -> list[tuple[int, int]]:
            edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[_near(g[two], g[two + 1], percent)]
            out = list(zip(v[two].tolist(), v[two + 1].tolist(), strict=True))
            for a, b in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist(), strict=True):
                out += _spread(v[a:b], g[a:b], percent)
            return out

        for batch in batches:
            k = np.concatenate((hk, batch.column(0).to_numpy()))
            v, g = np.concatenate((hn, batch.column(1).to_numpy())), np.concatenate((hs, batch.column(2).to_numpy().view(np.uint64)))
            links: list[tuple[int, int]] = []
            if chained and len(k):
                m = int(np.count_nonzero(k == chained[0]))
                run = [chained[1], *v[:m].tolist()]
                links += zip(run[1:], run[:-1], strict=True)
                chained = (chained[0], run[-1]) if m == len(k) else None
                k, v, g = k[m:], v[m:], g[m:]
            if len(k):
                other = np.flatnonzero(k != k[-1])
                last = int(other[-1]) + 1 if len(other) else 0
                links += lists(k[:last], v[:last], g[:last]) if last else []
                hk, hn, hs = k[last:], v[last:], g[last:]
                if len(hk) > LIST:
                    links += zip(hn[1:].tolist(), hn[:-1].tolist(), strict=True)
                    chained = (int(hk[0]), int(hn[-1]))
                    hk, hn, hs = hk[:0], hn[:0], hs[:0]
            else:
                hk, hn, hs = k, v, g
            if links:
                pairs = np.unique(np.array(links, np.int64), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if len(hk) and (links := lists(hk, hn, hs)):
            pairs = np.array(links, np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return task


def _inverted(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value number by entry, with the entries' owners grouped by value: numbers, owners, first owner by number."""
    flat = np.concatenate(arrays)
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(number))))
    return number, owner[order], first


def _centre_first(number: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows by descending commonness of their values: the middle of a group of copies comes first and joins most of them."""
    common = np.add.reduceat(np.diff(first)[number], begins[:-1]) / np.maximum(np.diff(begins), 1)
    return np.argsort(-common, kind="stable")


def link_sets(arrays: list[np.ndarray], linked) -> list[tuple[int, int]]:
    """Spanning links under linked(i, overlaps, candidates) -> bool array, comparing by inverted lists; pairs that are
    connected already are not compared."""
    n = len(arrays)
    number, owners, first = _inverted(arrays)
    begins = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    sets = Union(n)
    out: list[tuple[int, int]] = []
    roots = np.arange(n)
    for i in _centre_first(number, first, begins).tolist():
        if (roots == roots[i]).all():
            break
        own = number[begins[i] : begins[i + 1]]
        posts = np.concatenate([owners[first[v] : first[v + 1]] for v in own])
        overlap = np.bincount(posts, minlength=n)
        cand = np.flatnonzero((overlap > 0) & (roots != roots[i]))
        if not len(cand):
            continue
        good = cand[linked(i, overlap[cand], cand)]
        for j in good.tolist():
            if sets.join(i, j):
                out.append((i, j))
        if len(good):
            roots = sets.roots()
    return out


def _estimated(percent: int):
    """Links of stage 3, from sketches: exact for sets that their sketches hold whole."""

    def fn(table: pa.Table) -> list[tuple[int, int]]:
        sk = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        size = table.column("n_shingles").to_numpy()

        def linked(i: int, overlap: np.ndarray, cand: np.ndarray) -> np.ndarray:
            good = 100 * np.minimum(size[cand], size[i]) >= percent * np.maximum(size[cand], size[i])
            # All that both sketches share bounds the estimate from above; most pairs end here.
            whole = (size[cand] <= K) & (size[i] <= K)
            among = np.where(whole, size[cand] + size[i] - overlap, K)
            good &= overlap >= among * (percent / 100 - np.where(whole, 0.0, 5 * (percent * (100 - percent) / 1e4 / K) ** 0.5)) - 1e-9
            for c in np.flatnonzero(good).tolist():
                j = cand[c]
                union = np.union1d(sk[i], sk[j])
                if size[i] > K or size[j] > K:
                    union = union[:K]
                top = union[-1]
                both = np.intersect1d(sk[i], sk[j], assume_unique=True)
                share = np.count_nonzero(both <= top) / len(union)
                spread = 0.0 if size[i] <= K and size[j] <= K else 5 * (percent * (100 - percent) / 1e4 / len(union)) ** 0.5
                good[c] = share >= percent / 100 - spread - 1e-12
            return good

        return link_sets(sk, linked)

    return fn


def _exact(percent: int):
    def fn(table: pa.Table) -> list[tuple[int, int]]:
        full = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        size = np.array([len(x) for x in full])
        return link_sets(full, lambda i, overlap, cand: 100 * overlap >= percent * (size[i] + size[cand] - overlap))

    return fn


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; width: words in a shingle; percent: the least likeness."""
    spark = docs.sparkSession
    n, folder = partitions(spark), work_dir(spark, "near-dedup")
    sets = save(_sets(docs, width), folder, "sets")
    classes = sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("sign").alias("sign"))
    classes = save(classes, folder, "classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sketch_keys(np.frombuffer(x, np.uint64), percent) for x in batch.column("sketch").to_pylist()]
            size = [len(x) for x in got]
            node, sign = np.repeat(batch.column("node").to_numpy(), size), np.repeat(batch.column("sign").to_numpy(), size)
            flat = np.concatenate(got) if got else np.empty(0, np.uint64)
            yield pa.record_batch([pa.array(flat.view(np.int64)), pa.array(node), pa.array(sign)], names=["key", "node", "sign"])

    lists = classes.select("node", "sketch", "sign").mapInArrow(trimmed(keys), "key long, node long, sign long")
    coarse = lists.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_coarse_links(percent)), "a long, b long")
    groups = connected_components(coarse, folder, "coarse")
    tasks = blocks(classes.select("node", "n_shingles", "sketch").join(groups, "node"), "component", "node")
    fine = connected_components(solve(tasks, _estimated(percent), n), folder, "fine")
    fine = save(fine, folder, "fine")
    full = _full_sets(docs.select("doc_id", "text").join(small_side(fine.withColumnRenamed("node", "doc_id")), "doc_id").select("doc_id", "text", "component"), width)
    links = solve(blocks(full, "component", "node"), _exact(percent), n)
    final = connected_components(links, folder, "links")
    members = classes.select("set_id", "node").join(final, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    with_text = sets.where("set_id is not null and doc_id is not null").select("doc_id", "n_shingles", "set_id").join(members, "set_id").drop("set_id")
    rest = sets.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = with_text.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
