"""Linking at scale: connected components of edge tables, and exact linking inside candidate groups cut into bounded blocks.

Nothing here gathers a group of unbounded size in one task: groups with more than BLOCK members are cut into blocks, every pair of
blocks is a task of its own, and each task gives spanning links only, at most one a member. The links then meet again in
connected_components(), whose steps are grouped minima and joins of an edge table; nothing goes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, save, trimmed

BLOCK = 256


class Union:
    """Disjoint sets of 0 .. n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component) for the nodes of an edge table (a, b), component being the smallest node that is reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written as a table, until an edge table repeats."""

    def canonical(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = save(canonical(edges), folder, f"{name}-0")
    now, step = state(e), 0
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = canonical(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        step += 1
        e = save(canonical(small), folder, f"{name}-{step}")
        before, now = now, state(e)
        drop(edges.sparkSession, folder, f"{name}-{step - 1}")
        if before == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def blocks(members: DataFrame, group: str, key: str, block: int = BLOCK) -> DataFrame:
    """Adds `task`: members of a group up to `block` share one task; those of larger groups are dealt into blocks, and each is
    copied to the tasks of all pairs with its block."""
    sizes = members.groupBy(group).count().where("count > 1")
    n = F.ceil(F.col("count") / block).cast("int")
    dealt = members.join(sizes, group).withColumn("_n", n).withColumn("_i", F.pmod(F.xxhash64(key, F.lit(7)), F.col("_n")).cast("int")).drop("count")
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    lo, hi = F.least("_i", "_j"), F.greatest("_i", "_j")
    return dealt.withColumn("task", F.xxhash64(F.col(group), lo, hi)).drop("_n", "_i", "_j")


def solve(tasks: DataFrame, fn: Callable[[pa.Table], list[tuple[int, int]]], n: int, size: int = 0) -> DataFrame:
    """Spanning links (a, b) of each task's rows: fn gets them as a table, or those of some tasks of `size` bytes together, and gives
    pairs of row numbers. `node` has the names."""

    def gathered(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        total = 0
        for table in tables:
            held.append(table)
            total += table.nbytes
            if total >= size:
                yield pa.concat_tables(held)
                held, total = [], 0
        if held:
            yield pa.concat_tables(held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(runs(batches, "task")):
            node = table.column("node").to_numpy()
            found = fn(table)
            if found:
                i, j = np.array(found, np.int64).T
                yield pa.record_batch([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(trimmed(task), "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal keys out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
