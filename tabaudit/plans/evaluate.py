"""Planted anomalies: how many of them the detectors find, and how often they flag what was left as it was; and a paired test.

Cells of clean tables are changed where a hash of table and seed says, tables are analysed with and without, and a plant counts as found
if a flag of its kind stands at its place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors

# How far a planted value lies off, in spreads, or in decades of wide positive series.
SPREADS = {"point_outlier": 10.0, "level_shift": 8.0, "numeric_jump": 10.0}
DECADES = {"point_outlier": 3.0, "level_shift": 2.0, "numeric_jump": 3.0}


def plant(series: DataFrame, kind: str, seed: int = 7) -> DataFrame:
    """The series with one anomaly each: a point in its inner part, a step from there on, or the last two fifths raised. Adds planted
    (bool) and plant_x, the first changed x."""
    if kind not in SPREADS:
        raise ValueError(f"can't plant {kind}")
    w = detectors.by_series()
    p = detectors.points(series).withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(detectors.along_x()))
    p = p.withColumn("_up", F.row_number().over(w.orderBy("value", "x"))).withColumn("wide", detectors.log_space())
    spread = detectors.or_else(F.stddev_pop("value").over(w), F.abs(F.avg("value").over(w)), F.lit(1.0))
    place = F.lit(2) + F.pmod(F.xxhash64(*detectors.KEY, F.lit(seed)), F.greatest(F.col("n") - 2, F.lit(1)))
    first = F.floor(F.col("n") * 0.6) + 1 if kind == "level_shift" else place
    hit = F.col("i") == first if kind == "point_outlier" else F.col("i") >= first
    far = F.when(F.col("wide"), F.col("value") * 10 ** DECADES[kind]).otherwise(F.col("value") + SPREADS[kind] * spread)
    p = p.withColumn("planted", hit).withColumn("_new", F.when(hit, far).otherwise(F.col("value")))
    p = p.withColumn("plant_x", F.min(F.when(hit, F.col("x"))).over(w))
    return p.select(*detectors.KEY, "x", "x_lab", F.lit(0).cast("long").alias("row_id"), F.col("_new").alias("value"), "planted", "plant_x")


def found(planted: DataFrame, kind: str) -> DataFrame:
    """By series: whether a flag of the kind stands at the plant (hit), or anywhere (any)."""
    run = {"point_outlier": detectors.numeric_outliers, "numeric_jump": detectors.numeric_jumps, "level_shift": detectors.level_shifts}[kind]
    place = {"point_outlier": "x", "numeric_jump": "x_to", "level_shift": "shift_from"}[kind]
    f = run(planted).where("flagged").select(*detectors.KEY, F.col(place).alias("at"))
    where = planted.groupBy(*detectors.KEY).agg(F.first("plant_x").alias("plant_x"), F.count("*").alias("n"))
    near = F.abs(F.col("at") - F.col("plant_x")) <= 1e-9 * F.greatest(F.abs("plant_x"), F.lit(1.0))
    on = [where[k].eqNullSafe(f[k]) for k in detectors.KEY]
    return where.join(f, on, "left").groupBy(*(where[k] for k in detectors.KEY), "n").agg(F.max(F.coalesce(near, F.lit(False)).cast("int")).alias("hit"), F.max(F.col("at").isNotNull().cast("int")).alias("any"))


def recall(series: DataFrame, seed: int = 7, min_points: int = 8) -> DataFrame:
    """(kind, series, recall, elsewhere, clean_rate): plants found, flagged only elsewhere, and series flagged with nothing planted."""
    out = None
    enough = detectors.points(series).groupBy(*detectors.KEY).count().where(F.col("count") >= min_points).drop("count")
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in detectors.KEY]
    some = series.join(enough, on(series, enough), "left_semi")
    for kind in SPREADS:
        changed = found(plant(some, kind, seed), kind).agg(F.count("*").alias("series"), F.avg("hit").alias("recall"), F.avg(((F.col("any") == 1) & (F.col("hit") == 0)).cast("double")).alias("elsewhere"))
        clean = found(detectors.points(some).withColumn("row_id", F.lit(0).cast("long")).withColumn("plant_x", F.lit(float("inf"))), kind).agg(F.avg("any").alias("clean_rate"))
        row = changed.withColumn("kind", F.lit(kind)).join(clean.withColumn("kind", F.lit(kind)), "kind").select("kind", "series", "recall", "elsewhere", "clean_rate")
        out = row if out is None else out.unionByName(row)
    return out


def paired_permutation(a: list[float], b: list[float], times: int = 10_000, seed: int = 13) -> float:
    """Two-sided p of the mean difference of paired results under random signs."""
    d = np.asarray(a, float) - np.asarray(b, float)
    if not len(d) or not d.any():
        return 1.0
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (times, len(d)))
    return float((np.sum(np.abs(signs @ d) >= abs(d.sum()) - 1e-12) + 1) / (times + 1))


def overlap_distribution(compared: DataFrame) -> DataFrame:
    """Quartiles of recall and precision of generated against real captions (rows of claims.compare)."""
    q = lambda c: [F.percentile(c, F.lit(x)).alias(f"{c}_{int(100 * x)}") for x in (0.25, 0.5, 0.75)]
    return compared.agg(F.count("*").alias("captions"), F.count("recall").alias("with_claims"), *q("recall"), *q("precision"))

