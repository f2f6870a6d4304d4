"""Order by doc_id without a single task: cut points, a partition number by binary search, neighbours across partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that divide `key` into about equal parts; one aggregate over that column."""
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, probs, max(10_000, 20 * n)).alias("c")).first()["c"]
    return sorted(set(got or []))


def slot(key: Column, cuts: list[int], base: int = 0) -> Column:
    """Number of cut points that are not above the key, by nested comparisons; null keys get 0."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(key >= F.lit(cuts[m]), slot(key, cuts[m + 1 :], base + m + 1)).otherwise(slot(key, cuts[:m], base))
