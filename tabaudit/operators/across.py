"""Checks that join or rank what the detectors give: cells across tables, units in a column, suppression, scores, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounding_tolerance


def metric_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def cross_table(cells: DataFrame) -> DataFrame:
    """The worst disagreement of each pair of tables with the same metric and axes, over cells at equal coordinates.

    Rows: table_id, table_pos, metric, axes (a sorted list as text), coord (canonical text), row_id, value, raw. An equi-join on
    metric, axes and coordinates; a pair of tables meets only in the cells they share."""
    first = cells.where("value is not null").groupBy("table_id", "table_pos", metric_name(F.col("metric")).alias("metric"), "axes", "coord").agg(F.min_by(F.struct("value", "raw"), "row_id").alias("c"))
    one = first.select(*(F.col(c) for c in ("metric", "axes", "coord")), F.col("table_id").alias("table_a"), F.col("table_pos").alias("pos_a"), F.col("c.value").alias("a"), F.col("c.raw").alias("raw_a"))
    two = first.select(*(F.col(c) for c in ("metric", "axes", "coord")), F.col("table_id").alias("table_b"), F.col("table_pos").alias("pos_b"), F.col("c.value").alias("b"), F.col("c.raw").alias("raw_b"))
    both = one.join(two, ["metric", "axes", "coord"]).where("pos_a < pos_b")
    gap, slack = F.abs(F.col("a") - F.col("b")), rounding_tolerance(F.col("raw_a")) + rounding_tolerance(F.col("raw_b"))
    both = both.withColumn("gap", gap).withColumn("slack", slack)
    equal = F.col("gap") <= F.greatest(F.col("slack") * (1 + 1e-9), 1e-9 * F.greatest(F.abs("a"), F.abs("b")))
    both = both.withColumn("equal", equal).withColumn("strength", F.when(F.col("slack") > 0, F.col("gap") / F.nullif("slack", F.lit(0.0))).otherwise(F.col("gap")))
    g = both.groupBy("metric", "table_a", "table_b").agg(F.count("*").alias("shared"), F.sum(F.col("equal").cast("long")).alias("consistent"), F.max_by(F.struct("coord", "a", "b", "strength"), F.when(~F.col("equal"), F.struct("strength", "coord"))).alias("w"))
    return g.select("metric", "table_a", "table_b", "shared", "consistent", "w.coord", "w.a", "w.b", "w.strength", (F.col("consistent") / F.col("shared")).alias("support"), (F.col("consistent") < F.col("shared")).alias("flagged"))


def unit_mismatches(cells: DataFrame, min_cells: int = 5) -> DataFrame:
    """Columns of numbers with a unit (k K M G T B) where one cell alone has another unit, though its number lies among the others."""
    pat = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([kKMGTB])\s*$"
    x = cells.withColumn("num", F.regexp_extract("raw", pat, 1).try_cast("double")).withColumn("unit", F.regexp_extract("raw", pat, 2)).where("num is not null")
    u = x.groupBy("table_id", "col", "unit").agg(F.count("*").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.min("raw").alias("raw"))
    g = u.groupBy("table_id", "col").agg(F.count("*").alias("units"), F.sum("n").alias("cells"), F.max_by(F.struct("unit", "n", "lo", "hi"), F.struct("n", "unit")).alias("main"), F.min_by(F.struct("unit", "n", "lo", "raw"), F.struct("n", "unit")).alias("odd"))
    hit = (F.col("units") == 2) & (F.col("cells") >= min_cells) & (F.col("odd.n") == 1) & (F.col("main.n") >= 4) & F.col("odd.lo").between(F.col("main.lo"), F.col("main.hi"))
    return g.select("table_id", "col", "units", "cells", F.col("main.unit").alias("main_unit"), F.when(hit, F.col("odd.raw")).alias("odd"), hit.alias("flagged"))


def suppress(flags: DataFrame, index_axes: DataFrame) -> DataFrame:
    """Without jumps and shifts along serial numbers, and without jumps that start or end at an outlier of the same table and axis.
    Rows: table_id, axis, type, at (of an outlier), x_from, x_to."""
    serial = index_axes.where("flagged").select("table_id", "axis")
    kept = flags.join(serial.withColumn("_i", F.lit(True)), ["table_id", "axis"], "left").where(F.col("_i").isNull() | ~F.col("type").isin("numeric_jump", "level_shift")).drop("_i")
    at = kept.where("type = 'point_outlier' and at is not null").select("table_id", "axis", F.col("at").alias("_at")).distinct()
    jumps, rest = kept.where("type = 'numeric_jump'"), kept.where("type <> 'numeric_jump'")
    for end in ("x_from", "x_to"):
        jumps = jumps.join(at.withColumnRenamed("_at", end), ["table_id", "axis", end], "left_anti")
    return rest.unionByName(jumps.select(rest.columns))


def priority(flags: DataFrame) -> DataFrame:
    """Adds priority HIGH, MEDIUM or LOW. Rows: type, strength, support, and endpoint, column_scale (booleans), spearman where known."""
    s, p = F.col("strength"), F.col("support")
    e = F.greatest(s, F.abs(F.coalesce("spearman", F.lit(0.0))))
    # Thresholds on strength and support for HIGH and MEDIUM.
    rules = {
        "numeric_jump": ((s >= 10) & ~F.col("endpoint"), (s >= 3) & ~F.col("endpoint")),
        "win_reversal": (s >= 3, s >= 2),
        "cat_exception": (p >= 0.9, p >= 0.75),
        "duplicate": (s >= 3, s >= 2),
        "cross_table_inconsistency": ((s >= 5) & (p >= 0.5), (s >= 5) | ((s >= 2) & (p >= 0.5))),
        "flatness": (F.lit(False), F.lit(True)),
        "unit_mismatch": (F.lit(True), F.lit(True)),
        "point_outlier": ((s >= 6) & ~F.col("column_scale"), (s >= 3.5) & ~F.col("column_scale")),
        "monotonicity": (s >= 0.5, s >= 0.2),
        "level_shift": ((p >= 0.9) & (s >= 5), (p >= 0.9) & (s >= 3)),
        "trend": ((p >= 0.9) & (e >= 0.8), (p >= 0.9) & (e >= 0.5)),
    }
    out = F.lit("LOW")
    for kind, (high, medium) in rules.items():
        out = F.when(F.col("type") == kind, F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")).otherwise(out)
    return flags.withColumn("priority", out)


def ranked(flags: DataFrame) -> DataFrame:
    """Flags by priority, then descending strength, then order of emission; `rank` counts within a table."""
    level = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    return flags.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(level, F.col("strength").desc(), "seq")))


def multiset_overlap(a: DataFrame, b: DataFrame, value: str) -> Column | DataFrame:
    """How many values two tables of numbers share, each as often as both have it."""
    x, y = a.groupBy(value).agg(F.count("*").alias("n")), b.groupBy(value).agg(F.count("*").alias("m"))
    return x.join(y, value).agg(F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).alias("shared"))


def pathological(levels: DataFrame, max_axes: int = 6, max_combinations: int = 50_000) -> DataFrame:
    """Tables with too many axes or combinations of levels. Rows: table_id, axis, level."""
    n = levels.groupBy("table_id", "axis").agg(F.countDistinct("level").alias("n"))
    g = n.groupBy("table_id").agg(F.count("*").alias("axes"), F.round(F.exp(F.sum(F.log("n")))).alias("combinations"))
    return g.withColumn("flagged", (F.col("axes") > max_axes) | (F.col("combinations") > max_combinations))


def winners(cells: DataFrame, lower_is_better: bool, max_settings: int = 500, max_span: float = 1000.0) -> DataFrame:
    """By table and setting: the best competitor, the runner-up and both values. Rows: table_id, setting, who, value.

    Tables with too many settings, with a competitor that has several values in a setting, or with values of a setting that span
    more than `max_span` have no contest; ties have no winner; names need a letter."""
    x = cells.where("value is not null")
    seen = F.min("row_id") if "row_id" in x.columns else F.lit(0)
    per = x.groupBy("table_id", "setting", "who").agg(F.count("*").alias("n"), F.first("value").alias("value"), seen.alias("seen"))
    size = F.abs(F.nullif("value", F.lit(0.0)))
    each = per.groupBy("table_id", "setting").agg(F.max("n").alias("n"), F.count(size).alias("c"), (F.max(size) / F.min(size)).alias("span"))
    fair = each.groupBy("table_id").agg(F.count("*").alias("settings"), F.max("n").alias("n"), F.max(F.when(F.col("c") >= 2, F.col("span"))).alias("span"))
    fair = fair.where((F.col("settings") <= max_settings) & (F.col("n") == 1) & (F.coalesce("span", F.lit(1.0)) <= max_span)).select("table_id")
    named = per.where(F.col("who").rlike(r"\p{L}")).join(fair, "table_id")
    key = F.col("value") if lower_is_better else -F.col("value")
    w = Window.partitionBy("table_id", "setting").orderBy(key, "seen", "who")
    top = named.withColumn("place", F.row_number().over(w)).where("place <= 2")
    g = top.groupBy("table_id", "setting").agg(F.max(F.when(F.col("place") == 1, F.col("who"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("value"))).alias("best_value"), F.max(F.when(F.col("place") == 2, F.col("who"))).alias("second"), F.max(F.when(F.col("place") == 2, F.col("value"))).alias("second_value"))
    return g.where("second is not null and best_value <> second_value")


def leaders(won: DataFrame) -> DataFrame:
    """By table: a sentence on who wins most settings, or that nobody leads."""
    n = won.groupBy("table_id", "best").agg(F.count("*").alias("k"))
    g = n.groupBy("table_id").agg(F.sum("k").alias("settings"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), "best"))), 1, 3).alias("top"))
    first = F.col("top")[0]
    most = F.concat(first["best"], F.lit(" is best in "), (-first["m"]).cast("string"), F.lit(" of "), F.col("settings").cast("string"), F.lit(" settings."))
    split = F.concat(F.lit("Nobody leads: "), F.array_join(F.transform("top", lambda t: F.concat(t["best"], F.lit(" in "), (-t["m"]).cast("string"))), ", "), F.lit(" of "), F.col("settings").cast("string"), F.lit(" settings."))
    return g.select("table_id", "settings", F.when(-first["m"] * 2 > F.col("settings"), most).when(F.col("settings") >= 3, split).alias("sentence"))
