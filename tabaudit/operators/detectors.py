"""The eight pattern detectors over series.

A series is what has the same KEY: one table, one axis, one combination of the other axes. Input rows are
    table_id, axis, fixed_key, x DOUBLE (the number of a numeric level, the position of an ordered one), x_lab, row_id, value
and points() leaves one finite value a level, the first row's. Every detector is windows and aggregates by KEY and gives
statistics with a `flagged` column, so millions of series run at once; flags are its flagged rows. What reads a series' points in
order sorts within the key, and nothing reads a table as a whole but whole_table_outliers(), whose tables are summaries.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import HIGHER_PARTS, HIGHER_WORDS, LOWER_WORDS

KEY = ["table_id", "axis", "fixed_key"]
INF = float("inf")


def by_series() -> WindowSpec:
    return Window.partitionBy(*KEY)


def along_x() -> WindowSpec:
    return by_series().orderBy("x")


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def points(series: DataFrame) -> DataFrame:
    """The first row's value by level; levels without a finite value are left out."""
    first = series.groupBy(*KEY, "x").agg(F.min_by("x_lab", "row_id").alias("x_lab"), F.min_by("value", "row_id").alias("value"))
    return first.where(finite("value"))


def or_else(*cs: Column) -> Column:
    """The first that is neither null nor zero, else the last."""
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in cs[:-1]), cs[-1])


def with_mad(df: DataFrame, c: str, window: WindowSpec | None = None, when: Column | None = None) -> DataFrame:
    """Adds <c>_med and <c>_mad, the median and the median absolute deviation, of the rows for which `when` holds."""
    window = window or by_series()
    pick = lambda x: x if when is None else F.when(when, x)
    df = df.withColumn(f"{c}_med", F.median(pick(F.col(c))).over(window))
    return df.withColumn(f"{c}_mad", F.median(pick(F.abs(F.col(c) - F.col(f"{c}_med")))).over(window))


def with_fit(df: DataFrame, window: WindowSpec | None = None, when: Column | None = None) -> DataFrame:
    """Adds slope, intercept, resid_sd and r2 of value on x; both are scaled by their largest magnitude first, so squares
    don't overflow. A single x gives slope 0 and the mean."""
    window = window or by_series()
    pick = lambda c: c if when is None else F.when(when, c)
    over = lambda c: c.over(window)
    sx, sy = (or_else(over(F.max(F.abs(pick(F.col(c))))), F.lit(1.0)) for c in ("x", "value"))
    df = df.withColumn("_sx", sx).withColumn("_sy", sy)
    df = df.withColumn("_u", pick(F.col("x") / F.col("_sx"))).withColumn("_v", pick(F.col("value") / F.col("_sy")))
    df = df.withColumn("_mu", over(F.avg("_u"))).withColumn("_mv", over(F.avg("_v")))
    df = df.withColumn("_du", F.col("_u") - F.col("_mu")).withColumn("_dv", F.col("_v") - F.col("_mv"))
    df = df.withColumn("_suu", over(F.sum(F.col("_du") * F.col("_du")))).withColumn("_suv", over(F.sum(F.col("_du") * F.col("_dv")))).withColumn("_vv", over(F.avg(F.col("_dv") * F.col("_dv"))))
    df = df.withColumn("_b", F.when(F.col("_suu") > 0, F.col("_suv") / F.nullif("_suu", F.lit(0.0))).otherwise(0.0))
    df = df.withColumn("_r", F.col("_dv") - F.col("_b") * F.col("_du")).withColumn("_rr", over(F.avg(F.col("_r") * F.col("_r"))))
    df = df.withColumn("slope", F.col("_b") * F.col("_sy") / F.col("_sx")).withColumn("intercept", (F.col("_mv") - F.col("_b") * F.col("_mu")) * F.col("_sy"))
    df = df.withColumn("resid_sd", F.sqrt("_rr") * F.col("_sy"))
    df = df.withColumn("r2", F.when(F.col("_vv") > 0, F.greatest(F.lit(0.0), 1 - F.col("_rr") / F.nullif("_vv", F.lit(0.0)))).otherwise(0.0))
    return df.drop("_sx", "_sy", "_u", "_v", "_mu", "_mv", "_du", "_dv", "_suu", "_suv", "_vv", "_b", "_r", "_rr")


def pearson(a: Column, b: Column, window: WindowSpec | None = None) -> Column:
    """Null where one is constant."""
    window = window or by_series()
    over = lambda c: c.over(window)
    vary = (over(F.max(a)) > over(F.min(a))) & (over(F.max(b)) > over(F.min(b)))
    spread = F.sqrt(over(F.var_pop(a)) * over(F.var_pop(b)))
    return F.when(vary, over(F.covar_pop(a, b)) / F.nullif(spread, F.lit(0.0)))


def average_rank(c: str) -> Column:
    return F.rank().over(by_series().orderBy(c)) + (F.count("*").over(Window.partitionBy(*KEY, c)) - 1) / 2.0


def with_direction(df: DataFrame) -> DataFrame:
    """Adds `direction` of value along (x, value): increasing, non_decreasing, decreasing, non_increasing, none, or flat for a single point."""
    df = df.withColumn("_d", F.signum(F.lead("value").over(by_series().orderBy("x", "value")) - F.col("value")))
    up, down, same = (F.coalesce(F.sum(F.when(F.col("_d") == s, 1).otherwise(0)).over(by_series()), F.lit(0)) for s in (1, -1, 0))
    n = F.count("_d").over(by_series())
    name = F.when(n == 0, "flat").when((down == 0) & (up > 0), F.when(same == 0, "increasing").otherwise("non_decreasing")).when((up == 0) & (down > 0), F.when(same == 0, "decreasing").otherwise("non_increasing")).otherwise("none")
    return df.withColumn("direction", name).drop("_d")


def numeric_jumps(series: DataFrame, k_mad: float = 4.0, ratio: float = 3.0, min_points: int = 3) -> DataFrame:
    """Steps that leave the local trend by more than k_mad spreads and have the ratio; the last step of a steady climb is told apart."""
    p = points(series).withColumn("n", F.count("*").over(by_series())).where(F.col("n") >= min_points)
    p = p.withColumn("x_to", F.lead("x").over(along_x())).withColumn("value_to", F.lead("value").over(along_x())).withColumn("is_last", F.lead("x", 2).over(along_x()).isNull())
    s = p.where("x_to is not null").withColumn("signed", F.col("value_to") - F.col("value")).withColumn("step", F.abs("signed"))
    s = with_mad(with_mad(s, "step"), "signed")
    s = s.withColumn("typical", or_else(F.col("step_mad"), F.col("step_med"))).withColumn("spread", or_else(F.col("signed_mad"), F.col("typical")))
    low, high = F.least("value", "value_to"), F.greatest("value", "value_to")
    s = s.withColumn("ratio", F.when(low > 0, high / F.nullif(low, F.lit(0.0))).otherwise(F.lit(INF)))
    s = s.withColumn("trend_dev", F.when(F.col("spread") > 0, F.abs(F.col("signed") - F.col("signed_med")) / F.nullif("spread", F.lit(0.0))).otherwise(0.0))
    # The endpoint of a climb: the last step dwarfs the others, which go the same way in a tight progression.
    other = lambda c: F.when(~F.col("is_last"), c)
    size = or_else(F.max(other(F.abs("signed"))).over(by_series()), F.lit(1.0))
    s = s.withColumn("_med", F.median(other(F.col("step"))).over(by_series())).withColumn("_mean", F.avg(other(F.col("signed"))).over(by_series())).withColumn("_top", F.max("step").over(by_series())).withColumn("_size", size)
    s = s.withColumn("_sd", F.coalesce(F.stddev_pop(other(F.col("signed") / F.col("_size"))).over(by_series()) * F.col("_size"), F.lit(0.0)))
    way = other(F.when(F.col("signed") != 0, F.signum("signed")))
    signs = F.when(F.min(way).over(by_series()) < F.max(way).over(by_series()), 2).otherwise(1)
    climb = F.col("is_last") & (F.col("n") >= 3) & ((F.col("_med") == 0) | (F.col("_top") > 8 * F.col("_med"))) & (signs <= 1) & (F.col("signed") * F.col("_mean") > 0) & (F.col("_sd") / F.nullif(F.abs("_mean"), F.lit(0.0)) < 0.5)
    s = s.withColumn("endpoint_of_climb", F.coalesce(climb, F.lit(False)))
    s = s.withColumn("flagged", (F.col("trend_dev") > k_mad) & (F.col("ratio") >= ratio)).withColumn("strength", F.when(F.col("ratio") == INF, 999.0).otherwise(F.col("ratio")))
    gap = F.round(F.abs(F.col("x_to") - F.col("x")) / 3, 4)
    s = s.withColumn("try_1", F.least("x", "x_to") + gap).withColumn("try_2", F.least("x", "x_to") + 2 * gap)
    return s.select(*KEY, F.col("x").alias("x_from"), "x_to", F.col("value").alias("value_from"), "value_to", "ratio", "step", F.col("typical").alias("typical_step"), "trend_dev", "endpoint_of_climb", "strength", "try_1", "try_2", "flagged")


def monotonicity(series: DataFrame, expected: str, min_points: int = 3) -> DataFrame:
    """Reversals against an expected direction, 'increasing' or 'decreasing', of more than 5 % of the range; a row a series."""
    p = points(series)
    p = p.withColumn("_d", F.lead("value").over(along_x()) - F.col("value"))
    p = p.withColumn("n", F.count("*").over(by_series())).withColumn("_range", or_else(F.max("value").over(by_series()) - F.min("value").over(by_series()), F.lit(1.0)))
    wrong = (F.col("_d") < 0 if expected == "increasing" else F.col("_d") > 0) & (F.abs("_d") / F.col("_range") > 0.05)
    g = p.where(F.col("n") >= min_points).groupBy(*KEY).agg(F.first("n").alias("n"), F.first("_range").alias("_range"), F.count(F.when(wrong, 1)).alias("reversals"), F.max(F.when(wrong, F.abs("_d"))).alias("_top"))
    return g.select(*KEY, "n", "reversals", (F.coalesce("_top", F.lit(0.0)) / F.col("_range")).alias("strength"), (F.col("reversals") > 0).alias("flagged"))


def win_reversals(cells: DataFrame, lower_is_better: bool = True, min_points: int = 3) -> DataFrame:
    """Whether the best entity along x changes back, or is one of three or more. Rows have entity and entity_pos too, fixed_key being
    the other axes without the entity; levels with fewer than two entities have no winner; ties go to the entity seen first."""
    first = cells.groupBy(*KEY, "x", "entity").agg(F.min_by("value", "row_id").alias("value"), F.min("entity_pos").alias("pos"))
    first = first.where(finite("value"))
    order = F.struct(F.col("value") if lower_is_better else -F.col("value"), "pos")
    best = first.groupBy(*KEY, "x").agg(F.count("*").alias("n"), F.min_by("entity", order).alias("winner")).where("n >= 2")
    levels = cells.groupBy("table_id", "axis").agg(F.countDistinct("x").alias("levels")).where(F.col("levels") >= min_points)
    seq = best.join(levels, ["table_id", "axis"]).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "winner"))), lambda s: s["winner"]).alias("names"))
    names = F.col("names")
    back = F.exists(F.sequence(F.lit(2), F.greatest(F.size(names) - 1, F.lit(2))), lambda i: (i < F.size(names)) & (F.get(names, i) != F.get(names, i - 1)) & F.array_contains(F.slice(names, F.lit(1), F.greatest(i - 1, F.lit(0))), F.get(names, i)))
    distinct = F.size(F.array_distinct(names)).cast("long")
    return seq.select(*KEY, F.array_join(names, ",").alias("winners"), distinct.alias("distinct_winners"), distinct.cast("double").alias("strength"), ((distinct >= 3) | F.coalesce(back, F.lit(False))).alias("flagged"))


def category_exceptions(cells: DataFrame, lower_is_better: bool = True, min_support: int = 4) -> DataFrame:
    """By pair of neighbours among an ordered axis' levels that occur: how often the earlier is the better, and whether exceptions
    are few. x is the level's position, fixed_key the combination of the other axes."""
    p = points(cells)
    levels = cells.groupBy("table_id", "axis", "x").agg(F.min("x_lab").alias("x_lab"))
    nxt = levels.withColumn("x_next", F.lead("x").over(Window.partitionBy("table_id", "axis").orderBy("x"))).withColumn("lo", F.lead("x_lab").over(Window.partitionBy("table_id", "axis").orderBy("x"))).where("x_next is not null")
    hi = p.join(nxt.select("table_id", "axis", "x", "x_next", F.col("x_lab").alias("hi"), "lo"), ["table_id", "axis", "x"])
    both = hi.alias("h").join(p.alias("l"), (F.col("h.table_id") == F.col("l.table_id")) & (F.col("h.axis") == F.col("l.axis")) & F.col("h.fixed_key").eqNullSafe(F.col("l.fixed_key")) & (F.col("h.x_next") == F.col("l.x")))
    better = F.col("h.value") < F.col("l.value") if lower_is_better else F.col("h.value") > F.col("l.value")
    g = both.groupBy("h.table_id", "h.axis", "hi", "lo").agg(F.sum(better.cast("long")).alias("holds"), F.sum((~better & (F.col("h.value") != F.col("l.value"))).cast("long")).alias("fails"))
    total = F.col("holds") + F.col("fails")
    share = F.col("holds") / F.nullif(total, F.lit(0))
    return g.select("table_id", "axis", "hi", "lo", "holds", "fails", share.alias("strength"), ((total >= min_support) & (F.col("fails") > 0) & (F.col("fails") <= F.greatest(F.lit(1), F.floor(total / 4)))).alias("flagged"))


PLACEHOLDERS = ("-", "--", "–", "—", "n/a", "na")


def printed_decimals(v: Column) -> Column:
    """Whether a double prints, in its shortest form, with two digits or more after the point."""
    a = F.abs(v)
    plain = F.length(F.regexp_extract(F.format_string("%s", v), r"\.(\d+)$", 1)) >= 2
    mantissa = F.regexp_extract(F.format_string("%s", v), r"\.(\d+)E", 1) != "0"
    large = F.length(F.regexp_extract(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"0+$", ""), r"\.(\d+)$", 1)) >= 2
    return F.when(v == 0, False).when((a >= 1e-4) & (a < 1e-3), True).when((a >= 1e-3) & (a < 1e7), plain).when((a >= 1e7) & (a < 1e16), large).otherwise(mantissa)


# Names of data splits.
SPLITS = ("dev", "test", "val", "valid", "validation", "train", "training")


def sideways_axes(cells: DataFrame) -> DataFrame:
    """(table_id, axis) of axes all of whose levels, two at least, name a split and a metric: rows of a table that lies on its side."""
    low = F.lower("x_lab")
    word = lambda ws: low.rlike("(^|[^a-z])(" + "|".join(ws) + ")($|[^a-z])")
    named = word(SPLITS) & (word(LOWER_WORDS + HIGHER_WORDS) | low.rlike("|".join(HIGHER_PARTS)))
    return cells.groupBy("table_id", "axis").agg(F.bool_and(F.coalesce(named, F.lit(False))).alias("all"), F.countDistinct("x_lab").alias("n")).where("all and n >= 2").select("table_id", "axis")


def flat_entities(cells: DataFrame) -> DataFrame:
    """By (entity, axis): whether all combinations with two levels or more have one value. Rows have entity; fixed_key is the rest."""
    cells = cells.join(sideways_axes(cells), ["table_id", "axis"], "left_anti")
    p = cells.where(~F.lower(F.trim("entity")).isin(*PLACEHOLDERS)).groupBy(*KEY, "entity", "x").agg(F.min_by("value", "row_id").alias("value")).where(finite("value"))
    combo = p.groupBy(*KEY, "entity").agg(F.count("*").alias("n"), F.countDistinct(F.rint(F.col("value") * 1e6)).alias("d")).where("n >= 2")
    return combo.groupBy("table_id", "axis", "entity").agg(F.count("*").alias("combos"), F.max("d").alias("most_values"), (F.max("d") == 1).alias("flagged"))


def duplicates(cells: DataFrame) -> DataFrame:
    """Equal values with two printed decimals at several levels of an axis along which the entity otherwise varies."""
    flat = flat_entities(cells).where("flagged").select("table_id", "axis", "entity")
    cells = cells.join(sideways_axes(cells), ["table_id", "axis"], "left_anti")
    p = cells.where(~F.lower(F.trim("entity")).isin(*PLACEHOLDERS)).groupBy(*KEY, "entity", "x").agg(F.min_by("value", "row_id").alias("value")).where(finite("value"))
    p = p.join(flat, ["table_id", "axis", "entity"], "left_anti").where(printed_decimals(F.col("value")))
    g = p.groupBy(*KEY, "entity", F.rint(F.col("value") * 1e6).alias("_v")).agg(F.count("*").alias("levels"), F.min("value").alias("value"))
    return g.where("levels >= 2").select(*KEY, "entity", "value", "levels", F.col("levels").cast("double").alias("strength"), F.lit(True).alias("flagged"))


def level_shifts(series: DataFrame, share: float = 0.30, min_baseline: int = 5, z: float = 3.0, persist: int = 3, expect_flat: tuple[str, ...] = ()) -> DataFrame:
    """The longest run of later points far from an early baseline, or from its extrapolated line where that trends; a row a series."""
    p = points(series).withColumn("n", F.count("*").over(by_series())).where(F.col("n") >= min_baseline + persist).withColumn("i", F.row_number().over(along_x()))
    p = p.withColumn("nb", F.greatest(F.lit(min_baseline), F.floor(F.col("n") * share).cast("int")))
    base = F.col("i") <= F.col("nb")
    p = with_fit(with_mad(p, "value", when=base), when=base)
    sd = or_else(1.4826 * F.col("value_mad"), F.abs("value_med") * 0.05, F.lit(1.0))
    p = p.withColumn("ref_sd", or_else(F.col("resid_sd"), sd))
    width = F.max(F.when(base, F.col("x"))).over(by_series()) - F.min("x").over(by_series())
    p = p.withColumn("trending", (F.col("r2") >= 0.6) & (F.abs("slope") * width > 2 * or_else(F.col("resid_sd"), F.lit(1e-9))))
    p = p.withColumn("expected", F.when(F.col("trending"), F.col("intercept") + F.col("slope") * F.col("x")).otherwise(F.col("value_med")))
    p = p.withColumn("hit", (F.col("i") > F.col("nb")) & (F.abs(F.col("value") - F.col("expected")) > z * F.col("ref_sd")))
    p = p.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(*KEY, "hit").orderBy("x")))
    stats = p.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("n", "value_med", "ref_sd", "trending")), F.max(F.when(base, F.col("x"))).alias("baseline_to"), F.min("x").alias("baseline_from"))
    run = Window.partitionBy(*KEY, "island")
    hits = p.where("hit").withColumn("_run", F.count("*").over(run)).withColumn("_place", F.row_number().over(run.orderBy("x")) - 1)
    runs = hits.groupBy(*KEY, "island").agg(F.count("*").alias("n_persist"), F.min("i").alias("from_i"), F.avg("value").alias("shifted_mean"), F.min("x").alias("shift_from"), F.max("x").alias("shift_to"), F.max(F.when(F.col("_place") == F.floor(F.col("_run") / 2), F.col("expected"))).alias("ref"))
    best = runs.groupBy(*KEY).agg(F.max_by(F.struct("n_persist", "shifted_mean", "shift_from", "shift_to", "ref"), F.struct("n_persist", -F.col("from_i"))).alias("r"))
    g = stats.join(best, KEY, "left").select(*KEY, "n", F.col("value_med").alias("baseline"), "ref_sd", "trending", "baseline_from", "baseline_to", F.coalesce("r.n_persist", F.lit(0)).cast("long").alias("n_persist"), "r.shifted_mean", "r.shift_from", "r.shift_to", "r.ref")
    g = g.withColumn("strength", F.abs(F.col("shifted_mean") - F.col("ref")) / F.col("ref_sd"))
    flat = F.col("axis").isin(*expect_flat) if expect_flat else F.lit(False)
    return g.withColumn("support", F.when(F.col("trending"), 0.4).when(flat, 1.0).otherwise(0.3)).withColumn("flagged", F.col("n_persist") >= persist).drop("ref")


def numeric_outliers(series: DataFrame, z: float = 3.5, min_points: int = 5) -> DataFrame:
    """Points of numeric axes, all rows and not only the first of a level, by the first of these modes that decides a series:
    monotone (none), leverage, vs_cluster, residual."""
    p = series.where(finite("value") & finite("x")).withColumn("n", F.count("*").over(by_series())).where(F.col("n") >= min_points)
    p = with_direction(p).withColumn("_dense", F.dense_rank().over(along_x())).withColumn("_nx", F.max("_dense").over(by_series()))
    p = p.withColumn("_rx", average_rank("x")).withColumn("_ry", average_rank("value"))
    p = p.withColumn("rho", pearson(F.col("_rx"), F.col("_ry")))
    monotone = (F.col("_nx") >= 2) & (F.abs("rho") >= 0.9) & ~F.col("direction").isin("none", "flat")
    p = p.withColumn("_same", F.count("*").over(Window.partitionBy(*KEY, "x"))).withColumn("_most", F.max("_same").over(by_series())).withColumn("_least", F.min("_same").over(by_series()))
    leverage = (F.col("_nx") == 2) & (F.col("_least") == 1) & (F.col("_most") >= F.greatest(F.lit(4), F.col("n") - 1))
    p = p.withColumn("_down", F.row_number().over(by_series().orderBy(F.col("value").desc())))
    core = (F.col("n") <= 4) | (F.col("_down") > 2)
    p = p.withColumn("_lo", F.min(F.when(core, F.col("value"))).over(by_series())).withColumn("_hi", F.max(F.when(core, F.col("value"))).over(by_series())).withColumn("_mid", F.median(F.when(core, F.col("value"))).over(by_series())).withColumn("_range", F.max("value").over(by_series()) - F.min("value").over(by_series()))
    outside = (F.col("_range") > 0) & (F.abs(F.col("value") - F.col("_mid")) > F.greatest(6 * (F.col("_hi") - F.col("_lo")), 0.4 * F.col("_range"))) & ((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
    p = p.withColumn("_out", outside).withColumn("_n_out", F.sum(F.col("_out").cast("int")).over(by_series()))
    p = with_fit(p).withColumn("_all", F.median("value").over(by_series()))
    p = p.withColumn("resid", F.when(F.col("_nx") >= 2, F.col("value") - (F.col("intercept") + F.col("slope") * F.col("x"))).otherwise(F.col("value") - F.col("_all")))
    p = with_mad(p, "resid").withColumn("z", F.abs(F.col("resid") - F.col("resid_med")) / F.nullif(1.4826 * F.col("resid_mad"), F.lit(0.0)))
    order = by_series().orderBy("x", "value", "row_id")
    p = p.withColumn("_i", F.row_number().over(order))
    far = F.coalesce((F.col("z") > z) & ~((F.col("_nx") >= 2) & (F.col("r2") >= 0.9) & ((F.col("_i") == 1) | (F.col("_i") == F.col("n")))), F.lit(False))
    p = p.withColumn("_far", far).withColumn("_n_far", F.sum(F.col("_far").cast("int")).over(by_series()))
    mode = F.when(monotone, "monotone").when(leverage, "leverage").when(F.col("_n_out").between(1, 2), "vs_cluster").otherwise("residual")
    p = p.withColumn("mode", mode)
    flagged = F.when(F.col("mode") == "leverage", F.col("_same") == 1).when(F.col("mode") == "vs_cluster", F.col("_out")).when(F.col("mode") == "residual", F.col("_far") & F.col("_n_far").between(1, 2)).otherwise(False)
    p = p.withColumn("flagged", F.coalesce(flagged, F.lit(False))).withColumn("strength", F.when(F.col("mode").isin("leverage", "vs_cluster"), 8.0).otherwise(F.col("z")))
    return p.select(*KEY, "x", "row_id", "value", "mode", "z", "strength", "flagged")


def log_space(window: WindowSpec | None = None) -> Column:
    """Whether values are positive and their core, without extremes, still spans one and a half decades."""
    window = window or by_series()
    n, top = F.count("*").over(window), F.col("_up")
    strip = F.when(n >= 7, 2).otherwise(1)
    core = (top > strip) & (top <= n - strip)
    lo, hi = F.min(F.when(core, F.col("value"))).over(window), F.max(F.when(core, F.col("value"))).over(window)
    low, high = F.min("value").over(window), F.max("value").over(window)
    span = lambda a, b: F.when(a > 0, F.log10(b / F.nullif(a, F.lit(0.0)))).otherwise(0.0)
    return (low > 0) & (n >= 5) & (span(low, high) >= 2.0) & (span(lo, hi) >= 1.5)


def categorical_outliers(series: DataFrame, min_points: int = 5) -> DataFrame:
    """Values of unordered categories far from the core, which is all but the least and the largest; wide positive columns in logarithms."""
    p = points(series).withColumn("n", F.count("*").over(by_series())).where(F.col("n") >= min_points)
    p = p.withColumn("_up", F.row_number().over(by_series().orderBy("value", "x"))).withColumn("log", log_space())
    p = p.withColumn("v", F.when(F.col("log"), F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value")))
    core = (F.col("_up") > 1) & (F.col("_up") < F.col("n"))
    lo, hi, mid = (f(F.when(core, F.col("v"))).over(by_series()) for f in (F.min, F.max, F.median))
    span = F.max("v").over(by_series()) - F.min("v").over(by_series())
    out = (span > 0) & (F.abs(F.col("v") - mid) > F.greatest(6 * (hi - lo), 0.4 * span)) & ((F.col("v") < lo) | (F.col("v") > hi))
    p = p.withColumn("_out", out).withColumn("_n", F.sum(F.col("_out").cast("int")).over(by_series()))
    return p.select(*KEY, "x_lab", "value", "log", F.lit(8.0).alias("strength"), (F.col("_out") & F.col("_n").between(1, 2)).alias("flagged"))


def whole_table_outliers(cells: DataFrame, min_cells: int = 5) -> DataFrame:
    """The one value of a table, if it is one, that is far from all others by robust z > 8 and half the range; wide positive tables in
    logarithms. Rows: table_id, row_id, value, and where they are known
        x                  the number or place on the table's only ordered axis: tables that rise or fall along it are left alone,
        row_key, col_key   labels of a wide table of two axes: `column_scale` tells a column that lies beyond a quartile as a whole."""
    for name, kind in (("x", "double"), ("row_key", "string"), ("col_key", "string")):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast(kind))
    t = Window.partitionBy("table_id")
    along = Window.partitionBy("table_id", F.col("x").isNotNull()).orderBy("x", "row_id")
    p = cells.where(finite("value")).withColumn("n", F.count("*").over(t)).where(F.col("n") >= min_cells)
    p = p.withColumn("_on", finite("x")).withColumn("_d", F.signum(F.lead("value").over(along) - F.col("value")))
    rank = lambda c: F.rank().over(Window.partitionBy("table_id", "_on").orderBy(c)) + (F.count("*").over(Window.partitionBy("table_id", "_on", c)) - 1) / 2.0
    p = p.withColumn("_rx", F.when(F.col("_on"), rank("x"))).withColumn("_ry", F.when(F.col("_on"), rank("value")))
    up, down, points_on = (F.sum(F.when(F.col("_on") & c, 1).otherwise(0)).over(t) for c in (F.col("_d") > 0, F.col("_d") < 0, F.lit(True)))
    rho = pearson(F.col("_rx"), F.col("_ry"), t)
    p = p.withColumn("_climbs", (points_on >= 5) & (F.coalesce(F.abs(rho), F.lit(0.0)) >= 0.9) & ((up == 0) != (down == 0)))
    p = p.withColumn("_up", F.row_number().over(t.orderBy("value", "row_id"))).withColumn("log", log_space(t))
    p = p.withColumn("v", F.when(F.col("log"), F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value")))
    core = F.when((F.col("_up") > 1) & (F.col("_up") < F.col("n")), F.col("v"))
    p = p.withColumn("_mid", F.median(core).over(t)).withColumn("_mad", F.median(F.abs(core - F.col("_mid"))).over(t))
    span = F.max("v").over(t) - F.min("v").over(t)
    p = p.withColumn("z", F.abs(F.col("v") - F.col("_mid")) / F.nullif(1.4826 * F.col("_mad"), F.lit(0.0)))
    p = p.withColumn("_out", ~F.col("_climbs") & F.coalesce((F.col("z") > 8) & (F.abs(F.col("v") - F.col("_mid")) > 0.5 * span), F.lit(False)))
    at = lambda i: F.max(F.when(F.col("_up") == F.floor(i) + 1, F.col("v"))).over(t)
    p = p.withColumn("_q1", at(F.col("n") / 4)).withColumn("_q3", at(F.col("n") * 3 / 4))
    column = Window.partitionBy("table_id", "col_key")
    levels = lambda c: F.size(F.collect_set(c).over(t))
    alone = F.col("col_key").isNull() | F.col("row_key").isNull() | (levels("col_key") < 3) | (levels("row_key") < 3) | (F.count("*").over(column) < 3)
    beyond = ((F.col("v") < F.col("_q1")) & (F.max("v").over(column) < F.col("_q1"))) | ((F.col("v") > F.col("_q3")) & (F.min("v").over(column) > F.col("_q3")))
    p = p.withColumn("column_scale", ~alone & beyond)
    return p.select("table_id", "row_id", "value", "log", "z", "column_scale", F.lit(9.0).alias("strength"), (F.col("_out") & (F.sum(F.col("_out").cast("int")).over(t) == 1)).alias("flagged"))


def trends(series: DataFrame, r2_min: float = 0.5, min_points: int = 6, expect_flat: tuple[str, ...] = ()) -> DataFrame:
    """Least-squares and rank association along x; a row a series."""
    p = points(series).withColumn("n", F.count("*").over(by_series())).where(F.col("n") >= min_points)
    p = with_fit(with_direction(p))
    p = p.withColumn("_rx", average_rank("x")).withColumn("_ry", average_rank("value"))
    p = p.withColumn("spearman", pearson(F.col("_rx"), F.col("_ry"))).withColumn("pearson", pearson(F.col("x"), F.col("value")))
    g = p.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("n", "slope", "r2", "pearson", "spearman", "direction")), (F.max("value") - F.min("value")).alias("_range"), (F.max("x") - F.min("x")).alias("_width"), F.min_by("value", "x").alias("start_value"), F.max_by("value", "x").alias("end_value"), F.min("x").alias("x_from"), F.max("x").alias("x_to"))
    line = (F.col("r2") >= r2_min) & (F.abs(F.col("slope") * F.col("_width")) > 0.5 * F.col("_range"))
    mono = ~F.col("direction").isin("none", "flat") & (F.abs("spearman") >= 0.9) & (F.abs(F.col("end_value") - F.col("start_value")) > 0.5 * F.col("_range"))
    flat = F.col("axis").isin(*expect_flat) if expect_flat else F.lit(False)
    g = g.withColumn("flagged", F.coalesce((F.col("_range") > 0) & (line | mono), F.lit(False))).withColumn("strength", F.col("r2")).withColumn("support", F.when(flat, 1.0).otherwise(0.3))
    return g.drop("_range", "_width")


def index_like_axes(cells: DataFrame) -> DataFrame:
    """By numeric axis of a table: whether its values are a serial number, 0 or 1 upwards by ones, one row each. Rows: table_id, axis, x."""
    g = cells.where(finite("x")).groupBy("table_id", "axis").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.bool_and(F.col("x") == F.rint("x")).alias("whole"))
    return g.select("table_id", "axis", "n", ((F.col("n") >= 5) & (F.col("d") == F.col("n")) & F.col("lo").isin(0.0, 1.0) & F.col("whole") & (F.col("hi") - F.col("lo") == F.col("n") - 1)).alias("flagged"))


@lru_cache(maxsize=64)
def _draws(n: int, times: int, seed: int) -> np.ndarray:
    """Indices of resamples, row by row from the standard generator, so that they are the same everywhere."""
    import random

    r = random.Random(seed)
    return np.array([[r.randrange(n) for _ in range(n)] for _ in range(times)])


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r by row, NaN where one side is constant; sides are scaled first, so that squares don't overflow."""
    a, b = (v / np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny) for v in (a, b))
    a, b = (v - v.mean(axis=1, keepdims=True) for v in (a, b))
    constant = (np.ptp(a, axis=1) == 0) | (np.ptp(b, axis=1) == 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(constant, np.nan, r)


def _ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks by row."""
    less = (v[:, None, :] < v[:, :, None]).sum(axis=2)
    equal = (v[:, None, :] == v[:, :, None]).sum(axis=2)
    return less + (equal + 1) / 2


def interval(x: np.ndarray, y: np.ndarray, ranked: bool, times: int = 2000, level: float = 0.95, seed: int = 0) -> list[float] | None:
    """Percentile interval of a correlation over resampled pairs; None with fewer than four points, where the correlation isn't defined,
    or if half of the resamples have none."""
    n = len(x)
    take = _ranks if ranked else (lambda v: v)
    if n < 4 or np.isnan(_correlations(take(x[None]), take(y[None]))[0]):
        return None
    got = []
    for part in np.array_split(_draws(n, times, seed), max(1, times * n * n // 4_000_000)):
        got.append(_correlations(take(x[part]), take(y[part])))
    r = np.sort(np.concatenate(got))
    r = r[~np.isnan(r)]
    if len(r) < times // 2:
        return None
    tail = (1 - level) / 2
    return [round(float(r[max(0, int(tail * len(r)) - 1)]), 3), round(float(r[min(len(r) - 1, int((1 - tail) * len(r)))]), 3)]


def trend_intervals(series: DataFrame, min_points: int = 6) -> DataFrame:
    """Bootstrap intervals of both correlations along x, a row a series; for those whose trend is flagged, since each costs thousands
    of resamples. A series is a group, small by nature."""

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("x")
        x, y = p["x"].to_numpy(float), p["value"].to_numpy(float)
        return pd.DataFrame([(*key, interval(x, y, False), interval(x, y, True))], columns=[*KEY, "pearson_ci", "spearman_ci"])

    p = points(series)
    wanted = trends(series, min_points=min_points).where("flagged").select(*KEY)
    return p.join(wanted, KEY, "left_semi").select(*KEY, "x", "value").groupBy(*KEY).applyInPandas(of, "table_id string, axis string, fixed_key string, pearson_ci array<double>, spearman_ci array<double>")


def fit_notes(series: DataFrame, min_points: int = 5) -> DataFrame:
    """Series whose spread is too large for a fit to be judged: (table_id, axis, fixed_key, note). They are left unflagged, and say so."""
    p = points(series)
    g = p.groupBy(*KEY).agg(F.count("*").alias("n"), F.var_pop("value").alias("v"), F.var_pop("x").alias("w")).where(F.col("n") >= min_points)
    lost = lambda c: F.isnan(c) | (F.abs(c) == INF)
    return g.where(lost(F.col("v")) | lost(F.col("w"))).select(*KEY, F.lit("fit quality not determinable: the values' spread is not finite").alias("note"))
