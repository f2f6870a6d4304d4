"""LM scoring: a bigram Katz model with Good-Turing discounts and exactly normalised backoff weights.

Tokens are the words of a text and one end; the first token's context is the start. The training counts c lie in partitioned
tables, and each token is evaluated by the recursion

    P(w | h) = (1 - r) d(c(h, w)) c(h, w) / c(h)      if (h, w) was seen in training,
             = a(h) P(w)                              if h was seen, but not with w,
             = P(w)                                   if h is unknown,
    P(w)     = d'(c(w)) c(w) / N,  and what that leaves of 1 for the one class of unknown words.

d and d' are the Good-Turing discounts of counts up to K, from all counts of counts of their order; r = RESERVE keeps a little
mass for every context, also where no count is small; a(h) = (1 - sum of seen P(w | h)) / (1 - sum of their P(w)), so
P(. | h) sums to one over the V known words and the unknown class.

How it runs, with no join of tokens and no table in one task or on the driver:
  1. words are counted in training (64-bit hashes, added up in each batch first) and put into parts by hash; a word's id tells its
     part and its rank there. A part is one packed row;
  2. the texts are read again, words looked up part by part, and the bigrams sent to shards by context, packed, sorted and
     compressed by batch. Contexts with more than a small share of all tokens are dealt by both words;
  3. a shard counts its bigrams, writes them and its contexts' sums as packed rows, and answers each batch with the counts
     of its tokens. Counts of counts, a few numbers, are only then known, so answers carry counts and no probabilities;
  4. the answers meet by batch, discounts and backoff weights (looked up part by part) are applied, and the documents' sums come out.

Defined results: a null text is empty and has the end as its only token; every row is scored, and repeated rows count as
often as they stand; the fold of a null doc_id is that of the empty string; with no training rows every token is of the
unknown class and has probability 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import runs
from .store import partitions, save, work_dir
from .words import batch_words, mix64, utf8

K = 5
RESERVE = 1e-3
HOT = 8  # a context is dealt by both words if it has more than a HOT-th of a shard's mean share
DOCS, BYTES = 8192, 12_000_000
END_HASH = np.uint64(0x0E4D)
START, UNKNOWN = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
_ROWS = "kind int, at long, body binary, n array<long>"
_ARROW = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("body", pa.binary()), ("n", pa.list_(pa.int64()))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed: sorted or small numbers leave little."""
    out = []
    c = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
        body = c.compress(planes.tobytes())
        out.append(np.array([len(a), len(body)], np.int64).tobytes() + a.dtype.str.encode().ljust(8) + body)
    return b"".join(out)


def unpack(data: bytes, wanted: tuple[int, ...] | None = None) -> list[np.ndarray]:
    """The packed arrays, or those of some numbers alone, in their order."""
    out, at, number = [], 0, 0
    d = zstandard.ZstdDecompressor()
    while at < len(data):
        n, size = np.frombuffer(data, np.int64, 2, at)
        if wanted is None or number in wanted:
            kind = np.dtype(data[at + 16 : at + 24].decode().strip())
            raw = d.decompress(data[at + 24 : at + 24 + size], max_output_size=int(n) * kind.itemsize or 1) if n else b""
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
        at, number = at + 24 + int(size), number + 1
    return out


def discounts(n: list[int]) -> np.ndarray:
    """d[0..K], d[0] unused, from n[r] = number of events seen r times, r = 1 .. K + 1; 1 where the estimate is no discount."""
    d = np.ones(K + 1)
    if n[1] == 0:
        return d
    common = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        if n[r] and common < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


def in_training(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for d in doc_ids], bool)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash by distinct token, token codes with the ends, and the first token of each row."""
    w = batch_words(*utf8(part.column(1)))
    from .words import hash_strings

    hashes = np.append(hash_strings(w.distinct), END_HASH)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    codes = np.empty(first[-1], np.int64)
    is_end = np.zeros(first[-1], bool)
    is_end[first[1:] - 1] = True
    codes[is_end] = len(hashes) - 1
    codes[~is_end] = w.codes
    return hashes, codes, first


def _slices(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of at most DOCS rows and about `size` (or BYTES) bytes of text, or one row."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (size or BYTES), "right"))
            b = min(max(b, a + 1), a + DOCS)
            yield batch.slice(a, b - a)
            a = b


def _read_rows(path: str, kind: int | None = None) -> Iterator[bytes]:
    """Bodies of a written table's rows, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    for info in files.get_file_info(fs.FileSelector(folder, recursive=True)):
        if info.type != fs.FileType.File or not info.path.endswith(".parquet"):
            continue
        if kind is not None and f"/kind={kind}/" not in info.path:
            continue
        # Without a buffer the reader takes the whole column into memory first.
        for batch in pq.ParquetFile(files.open_input_file(info.path), buffer_size=1 << 20).iter_batches(batch_size=1, columns=["body"], use_threads=False):
            rows = batch.column(0).to_pylist()
            del batch
            while rows:
                yield rows.pop(0)


def vocabulary(docs: DataFrame, folder: str) -> str:
    """Writes the parts: hashes, ids and counts by hash, and counts by rank; gives the table's path."""
    n = partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            hashes, codes, first = _tokens(part)
            train = in_training(part.column(0).to_pylist())
            c = np.bincount(codes[np.repeat(train, np.diff(first))], minlength=len(hashes))
            keep = c > 0
            yield pa.record_batch([pa.array(hashes[keep].view(np.int64)), pa.array(c[keep])], names=["word", "c"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part = table.column("part")[0].as_py()
            words, c = table.column("word").to_numpy().view(np.uint64), table.column("c").to_numpy()
            order = np.lexsort((words, -c))
            words, c = words[order], c[order]
            if len(words) * n + part >= int(START):
                raise OverflowError("more words than 32-bit ids; use fewer partitions of the vocabulary or wider ids")
            ids = (np.arange(len(words)) * n + part).astype(np.uint32)
            by_hash = np.argsort(words)
            counts = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
            body = pack(words[by_hash], ids[by_hash], c[by_hash], c)
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([part], pa.int64()), pa.array([body]), pa.array([[len(c), int(c.sum()), *counts[1 : K + 2].tolist()]], pa.list_(pa.int64()))], schema=_ARROW)

    counts = docs.select("doc_id", "text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    parts = counts.withColumn("part", F.pmod("word", F.lit(n))).repartition(n, "part").sortWithinPartitions("part").mapInArrow(build, _ROWS)
    save(parts, folder, "words")
    return f"{folder}/words"


class Totals:
    """N, V and the unigram probabilities by count."""

    def __init__(self, rows: list[list[int]]):
        s = np.sum(rows, axis=0) if rows else np.zeros(K + 3, np.int64)
        self.v, self.n = int(s[0]), int(s[1])
        counts = [0, *map(int, s[2:])]
        self.d = discounts(counts)
        left = sum(counts[r] * r * (1 - self.d[r]) for r in range(1, K + 1)) / self.n if self.n else 1.0
        self.scale = 1.0 if left > 0 else self.n / (self.n + 1)
        self.unknown = left if left > 0 else 1 / (self.n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) by training count; 0 is the unknown class."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, self.d[np.minimum(c, K)] ** (c <= K) * c / self.n * self.scale, self.unknown)


def _look_up(path: str, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of words, each looked for in its own part."""
    ids, counts = np.full(len(hashes), UNKNOWN, np.uint32), np.zeros(len(hashes), np.int64)
    part = hashes.view(np.int64) % n  # as vocabulary() deals them
    order = np.lexsort((hashes, part))
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for body in _read_rows(path):
        words, own, c = unpack(body, (0, 1, 2))
        p = int(own[0] % np.uint32(n))
        mine = order[edges[p] : edges[p + 1]]
        at = np.minimum(np.searchsorted(words, hashes[mine]), len(words) - 1)
        hit = words[at] == hashes[mine]
        ids[mine[hit]], counts[mine[hit]] = own[at[hit]], c[at[hit]]
    return ids, counts


def _counts_by_id(path: str, ids: np.ndarray, n: int) -> np.ndarray:
    """Counts of words by id; 0 for the unknown class."""
    out = np.zeros(len(ids), np.int64)
    part = (ids % np.uint32(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for body in _read_rows(path):
        own, by_rank = unpack(body, (1, 3))
        p = int(own[0] % np.uint32(n))
        at = order[edges[p] : edges[p + 1]]
        at = at[ids[at] < UNKNOWN]
        out[at] = by_rank[ids[at] // np.uint32(n)]
    return out


def _hot(totals: Totals, n: int) -> float:
    """Contexts of a higher count are dealt by both words."""
    return (totals.n / n) / HOT


def _send(n: int, words_path: str, totals: Totals, train_docs: int):
    limit = _hot(totals, n)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20
        for number, part in enumerate(_slices(batches)):
            docs = part.num_rows
            hashes, codes, first = _tokens(part)
            ids, counts = _look_up(words_path, hashes, n)
            train = in_training(part.column(0).to_pylist())
            length = np.diff(first)
            row = np.repeat(np.arange(docs), length)
            c = counts[codes]
            add = lambda x: np.bincount(row, x, docs)
            plain = add(np.log10((c + 1) / (totals.n + totals.v + 1)))
            w, h, ch = ids[codes], np.empty(len(codes), np.uint32), np.empty(len(codes), np.int64)
            h[1:], ch[1:] = w[:-1], c[:-1]
            h[first[:-1]], ch[first[:-1]] = START, train_docs
            known = (h != UNKNOWN) & (ch > 0)
            own = add(np.where(known, np.log10((1 - RESERVE) / np.maximum(ch, 1)), np.log10(totals.p(c))))
            ids64 = part.column(0).fill_null(-1).to_numpy().astype(np.int64)
            null = np.array([x is None for x in part.column(0).to_pylist()], np.uint8)
            info = pack(ids64, null, (~train).astype(np.uint8), length.astype(np.int64), add(c > 0).astype(np.int64), plain, own)
            key = (h.astype(np.uint64) << np.uint64(32)) | w
            spread = np.where(ch > limit, mix64(key), mix64(h.astype(np.uint64)))
            shard = (spread % np.uint64(n)).astype(np.int64)
            shard[~known] = -1
            order = np.lexsort((key, ~train[row], shard))
            order = order[np.searchsorted(shard[order], 0) :]
            edges = np.searchsorted(shard[order], np.arange(n + 1))
            out = [(base + number, base + number, 3, info)]
            for s in np.flatnonzero(np.diff(edges)).tolist():
                x = order[edges[s] : edges[s + 1]]
                t = int(np.count_nonzero(train[row[x]]))
                out.append((s, base + number, 2, pack(key[x[:t]], row[x[:t]].astype(np.uint16), key[x[t:]], row[x[t:]].astype(np.uint16))))
            shards, at, kind, body = zip(*out, strict=True)
            yield pa.record_batch([pa.array(shards, pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["shard", "at", "kind", "body"])

    return task


def _shard(n: int, words_path: str, totals: Totals):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            if table.column("kind")[0].as_py() == 3:
                yield pa.Table.from_arrays([table.column("kind"), table.column("at"), table.column("body"), pa.array([[]] * len(table), pa.list_(pa.int64()))], schema=_ARROW).combine_chunks().to_batches()[0]
                continue
            at = table.column("at").to_pylist()
            got = [unpack(b) for b in table.column("body").to_pylist()]
            sizes = np.array([len(g[0]) for g in got])
            keys, which = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            c = np.bincount(which, minlength=len(keys))
            seen = c[which]
            answers = []
            for a, g, end in zip(at, got, np.cumsum(sizes).tolist(), strict=True):
                own = seen[end - len(g[0]) : end]
                place = np.minimum(np.searchsorted(keys, g[2]), max(len(keys) - 1, 0))
                hit = keys[place] == g[2] if len(keys) else np.zeros(len(g[2]), bool)
                rows, values = np.concatenate((g[1], g[3][hit])), np.concatenate((own, c[place[hit]] if len(keys) else own[:0]))
                by_row = np.argsort(rows, kind="stable")
                answers.append((2, a, pack(rows[by_row], values[by_row].astype(np.uint32), g[2][~hit], g[3][~hit]), []))
            shard = np.array([table.column("key")[0].as_py()], np.int64)
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            p = totals.p(_counts_by_id(words_path, low, n))
            context, first = np.unique((keys >> np.uint64(32)).astype(np.uint32), return_index=True)
            if len(keys):
                sums = [np.add.reduceat((c == r).astype(np.int64), first).astype(np.uint32) for r in range(1, K + 1)]
                large = np.add.reduceat(np.where(c > K, c, 0), first)
                mass = np.add.reduceat(p, first)
                counts = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
                answers.append((0, at[0], pack(keys, c.astype(np.uint32)), counts[1 : K + 2].tolist()))
                answers.append((1, at[0], pack(shard, context, *sums, large, mass), []))
            for i in range(0, len(answers), 64):
                kind, where, body, m = zip(*answers[i : i + 64], strict=True)
                yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(where, pa.int64()), pa.array(body, pa.binary()), pa.array(m, pa.list_(pa.int64()))], schema=_ARROW)

    return task


def _weights(path: str, contexts: np.ndarray, counts: np.ndarray, d: np.ndarray, n: int, limit: float) -> np.ndarray:
    """log10 of a(h) c(h) / (1 - r) for ascending context ids: what an unseen token has in place of its share above. A context is
    looked for in its own shard, or if its count is above the limit in all."""
    seen, mass = np.zeros(len(contexts)), np.zeros(len(contexts))
    where = np.where(counts > limit, -1, (mix64(contexts.astype(np.uint64)) % np.uint64(n)).astype(np.int64))
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(n + 1))
    for body in _read_rows(path, 1):
        (shard,), own, *sums, large, m = unpack(body)
        hit = np.concatenate((order[: edges[0]], order[edges[shard] : edges[shard + 1]]))
        at = np.minimum(np.searchsorted(own, contexts[hit]), len(own) - 1)
        same = own[at] == contexts[hit]
        at, hit = at[same], hit[same]
        seen[hit] += large[at] + sum(d[r] * r * sums[r - 1][at].astype(np.float64) for r in range(1, K + 1))
        mass[hit] += m[at]
    left = 1 - (1 - RESERVE) * seen / np.maximum(counts, 1)
    return np.log10(left / (1 - mass)) + np.log10(np.maximum(counts, 1) / (1 - RESERVE))


def _sum_up(n: int, words_path: str, shards_path: str, totals: Totals, d: np.ndarray, train_docs: int):
    logs = np.log10(d)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "at"):
            kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
            ids, null, held, length, known, plain, score = unpack(bodies[kinds.index(3)])
            docs = len(ids)
            got = [unpack(b) for k, b in zip(kinds, bodies, strict=True) if k == 2]
            for rows, c, _, _ in got:
                c = c.astype(np.int64)
                score = score + np.bincount(rows, np.log10(c) + logs[np.minimum(c, K)] * (c <= K), docs)
            keys = np.concatenate([g[2] for g in got]) if got else np.empty(0, np.uint64)
            if len(keys):
                rows = np.concatenate([g[3] for g in got])
                contexts, which = np.unique((keys >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                counts = _counts_by_id(words_path, contexts, n)
                counts[contexts == START] = train_docs
                low, back = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
                p = np.log10(totals.p(_counts_by_id(words_path, low, n)))
                score = score + np.bincount(rows, _weights(shards_path, contexts, counts, d, n, _hot(totals, n))[which] + p[back], docs)
            yield pa.record_batch([pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(length), pa.array(known), pa.array(np.full(docs, totals.n)), pa.array(plain), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return task


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    n, folder = partitions(spark), work_dir(spark, "katz")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words_path = vocabulary(docs, folder)
    stats = spark.read.parquet(words_path).select(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(K + 3)]).first()
    totals = Totals([[x or 0 for x in stats]])
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    train_docs = docs.where(fold != 2).count()
    sent = docs.mapInArrow(_send(n, words_path, totals, train_docs), "shard long, at long, kind int, body binary")
    sent = sent.withColumn("key", F.when(F.col("kind") == 3, -1 - F.col("shard")).otherwise(F.col("shard")))
    dealt = sent.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("key", "at")
    dealt.mapInArrow(_shard(n, words_path, totals), _ROWS).write.option("compression", "uncompressed").partitionBy("kind").parquet(f"{folder}/shards")
    back = spark.read.schema(_ROWS).parquet(f"{folder}/shards")
    counts = back.where("kind = 0").select(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(K + 1)]).first()
    d = discounts([0, *(x or 0 for x in counts)])
    answers = back.where("kind in (2, 3)").select("kind", "at", "body").repartition(n, "at").sortWithinPartitions("at")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.mapInArrow(_sum_up(n, words_path, f"{folder}/shards", totals, d, train_docs), out)
