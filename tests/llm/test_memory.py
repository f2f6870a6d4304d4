"""Workers give memory back after a task."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest

from tabaudit.llm import katz, store, tokens
from tabaudit.llm.queries import vocabulary_path
from tabaudit.llm.store import trimmed


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_freed_memory_goes_back():
    kept = []

    def task(batches):
        # Many small arrays, of which every last one stays: the heap can't shrink from its end alone.
        own = [np.ones(2000) for _ in range(20_000)]
        kept.append(own[-1])
        yield from batches

    batch = pa.record_batch([pa.array([1])], names=["x"])
    before = resident()
    assert len(list(task(iter([batch])))) == 1 and resident() - before > 200e6
    assert len(list(trimmed(task)(iter([batch])))) == 1
    assert resident() - before < 100e6


def test_remembered_cuts_are_small():
    path = vocabulary_path("word_bpe_49k.json")
    column = pa.array([" ".join(f"{i:x}z" for i in range(a, a + 1000)) for a in range(0, 500_000, 1000)])
    own = tokens.Encoder(path)
    list(own.column(column.slice(0, 1)))  # the tokenizer is loaded

    def task(batches):
        for _ in own.column(column):
            pass
        yield from batches

    batch = pa.record_batch([pa.array([1])], names=["x"])
    list(trimmed(task)(iter([batch])))
    with_cuts = resident()
    own._reset()
    list(trimmed(lambda batches: batches)(iter([batch])))
    assert with_cuts - resident() < 60e6  # strings and numbers of a dictionary took more than 200 bytes each


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_cuts_of_one_hash_and_forgotten_ones(monkeypatch, limit):
    path = vocabulary_path("word_bpe_49k.json")
    texts = [f"word{i % 37} of {i % 5}  lines\n{i}" for i in range(300)] + [None, "", " odd   space"]
    expected = tokens.encode_whole(path, [t or "" for t in texts])
    monkeypatch.setattr(tokens, "REMEMBERED", limit)
    monkeypatch.setattr(tokens, "TOGETHER", 700)
    monkeypatch.setattr(tokens, "GATHERED", 7)
    for hashes in (tokens.hash_strings, lambda a: np.zeros(len(a), np.uint64)):
        monkeypatch.setattr(tokens, "hash_strings", hashes)
        own = tokens.Encoder(path)
        for _ in range(2):
            assert [x.tolist() for x in own.column(pa.array(texts))] == expected


def test_idle_workers_forget():
    path = vocabulary_path("word_bpe_49k.json")
    list(tokens.encoder(path).column(pa.array(["some words"])))
    tokens.forget_idle(0.2)
    assert tokens.encoder(path).words.to_pylist()  # a task came: nothing is forgotten
    time.sleep(0.4)
    assert tokens.encoder(path).words.to_pylist()
    tokens.forget_idle(0.05)
    time.sleep(0.5)
    assert not tokens.encoder(path).words.to_pylist()


def test_model_shards_are_files_of_their_own(spark, tmp_path):
    made = spark.range(0, 1, 1, 1).selectExpr("explode(sequence(1, 5)) AS n").selectExpr("encode(cast(n AS string), 'UTF-8') AS body")
    store.save(made, f"file://{tmp_path}", "rows", rows=1)
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 5
    assert sorted(katz._read_rows(f"file://{tmp_path}/rows")) == [b"1", b"2", b"3", b"4", b"5"]
