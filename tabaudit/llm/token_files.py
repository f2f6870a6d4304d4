"""Token-ID / binary output: Arrow IPC files whose record batches hold fixed-size lists of ids and of mask bits.

The ids of all documents, in ascending doc_id order and each followed by an end id, form one stream. A shard holds a
contiguous range of documents; its file cuts the shard's part of the stream into sequences of equal length, the last one
padded with zeros under a mask of False. The footer of the file format locates every batch, and fixed-size lists make
sequence k of a batch a plain offset, so a memory-mapped file is read at random places without a copy.

Defined results: a null text is empty and gives the end id alone; repeated doc_ids keep all their rows, ordered by text;
null doc_ids come first; an empty table gives no rows and no files; other columns are ignored.
Executors write each file under a name of their attempt and then rename it, so a repeated task replaces its own file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cut_points, slot
from .store import partitions, save
from .tokens import encoder, tokenizer

SEQUENCE = 2048
BATCH_ROWS = 128
_INDEX = "doc_id long, shard int, at long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _name(shard: int) -> str:
    return f"tokens-{shard:06d}.arrow"


def schema(wide: bool, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends ids; writes record batches of whole sequences as they fill up, so it holds one batch at most."""

    def __init__(self, uri: str, shard: int, wide: bool, length: int = SEQUENCE, rows: int = BATCH_ROWS, attempt: str = "0"):
        self.fs, folder = _filesystem(uri)
        self.fs.create_dir(folder, recursive=True)
        self.path, self.temporary = f"{folder}/{_name(shard)}", f"{folder}/_{_name(shard)}.{attempt}"
        self.kind, self.length, self.rows = np.uint32 if wide else np.uint16, length, rows
        self.schema = schema(wide, length)
        self.sink = self.fs.open_output_stream(self.temporary)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def append(self, ids: np.ndarray) -> int:
        """Takes a document's ids, and says where in the shard they begin."""
        at, full = self.total, self.length * self.rows
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= full:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i : i + full], full)
            rest = flat[len(flat) // full * full :]
            self.held, self.n = [rest.copy()], len(rest)
        return at

    def _write(self, flat: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.length)
        self.out.write_batch(pa.record_batch([ids, mask], schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.zeros(-(-self.n // self.length) * self.length, self.kind)
            flat[: self.n] = np.concatenate(self.held)
            self._write(flat, self.n)
        self.out.close()
        self.sink.close()
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Random access to a shard: ids at any place of its stream, or whole sequences with their masks."""

    def __init__(self, uri: str, shard: int):
        fs, folder = _filesystem(uri)
        path = f"{folder}/{_name(shard)}"
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _flat(self, batch: int) -> np.ndarray:
        if self._last[0] != batch:
            self._last = (batch, self.file.get_batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def ids(self, at: int, n: int) -> np.ndarray:
        """A view into the mapped file where the ids lie in one batch."""
        size, found = self.rows * self.length, []
        while n > 0:
            b, i = divmod(at, size)
            piece = self._flat(b)[i : i + n]
            found.append(piece)
            at, n = at + len(piece), n - len(piece)
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint16)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(k // self.rows)
        i = k % self.rows
        return batch.column("ids")[i].values.to_numpy(zero_copy_only=True), batch.column("mask")[i].values.to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, vocabulary: str, uri: str, end_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """Writes the files below `uri`; returns the index doc_id, shard, at, n_tokens, start as a table kept there."""
    spark = docs.sparkSession
    n = partitions(spark)
    cuts = cut_points(docs, "doc_id", n)
    placed = docs.select("doc_id", "text", slot(F.col("doc_id"), cuts).alias("shard"))
    placed = placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}"
        wide = tokenizer(vocabulary).get_vocab_size() > 1 << 16
        writer, shard = None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc, shards = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            at, counts = [], []
            for s, ids in zip(shards.tolist(), encoder(vocabulary).column(batch.column(1)), strict=True):
                if s != shard:
                    if writer:
                        writer.close()
                    writer, shard = ShardWriter(uri, s, wide, length, attempt=attempt), s
                at.append(writer.append(np.concatenate((ids, end))))
                counts.append(len(ids) + 1)
            yield pa.record_batch([doc, pa.array(shards, pa.int32()), pa.array(at, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "shard", "at", "n_tokens"])
        if writer:
            writer.close()

    index = save(placed.mapInArrow(task, _INDEX), uri, "index")
    sizes = {r["shard"]: r["n"] for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a shard
    begins, total = [], 0
    for s in range(len(cuts) + 1):
        begins.append(total)
        total += sizes.get(s, 0)
    return index.withColumn("start", F.element_at(F.array(*map(F.lit, begins)), F.col("shard") + 1).cast("long") + F.col("at"))


def read_token_digests(index: DataFrame, uri: str) -> DataFrame:
    """Reads each document's ids from the files; gives doc_id, start, n_tokens and their crc32 as little-endian uint32."""
    n = partitions(index.sparkSession)
    dealt = index.repartition(n, "shard").sortWithinPartitions("shard", "at")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard = None, None
        for batch in batches:
            crc = []
            for s, at, k in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n_tokens")), strict=True):
                if s != shard:
                    reader, shard = ShardReader(uri, s), s
                crc.append(zlib.crc32(reader.ids(at, k).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
