"""All detectors over all tables at once: tables -> series -> flags, suppressed, scored and ranked; and whole articles.

A detector is an entry of DETECTORS: a name and a function from a Context (the staged series and cells) to flags. analyze() takes all or
some of them, so leaving one out is a parameter. Series are written once, so that no detector parses or plans them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import metric_direction
from ..operators import across, detectors, reported
from ..sources.readers import cells as table_cells
from ..sources.readers import series as table_series
from ..sources.stage import staged

FLAG = ["table_id", "type", "axis", "fixed_key", "at", "x_from", "x_to", "detail", "strength", "support", "endpoint", "column_scale", "spearman", "seq"]


def flags_of(df: DataFrame, kind: str, seq: int, detail: list[str | Column], support: Column | None = None, **known: Column) -> DataFrame:
    """A detector's flagged rows as flags; `detail` becomes JSON."""
    null = {"at": "double", "x_from": "double", "x_to": "double", "spearman": "double"}
    cols = {c: known.get(c, F.lit(None).cast(t)) for c, t in null.items()}
    cols |= {c: known.get(c, F.lit(False)) for c in ("endpoint", "column_scale")}
    cols["axis"] = F.col("axis") if "axis" in df.columns else F.lit(None).cast("string")
    cols["fixed_key"] = F.col("fixed_key") if "fixed_key" in df.columns else F.lit(None).cast("string")
    text = F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in detail]))
    return df.where("flagged").select("table_id", F.lit(kind).alias("type"), *(v.alias(c) for c, v in cols.items()), text.alias("detail"), F.col("strength").cast("double").alias("strength"), (support if support is not None else F.lit(1.0)).cast("double").alias("support"), F.lit(seq).alias("seq")).select(FLAG)


def rounded(digits: int, *names: str) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


@dataclass
class Context:
    """What detectors look at."""

    series: DataFrame
    cells: DataFrame
    expected: dict[str, str]
    expect_flat: tuple[str, ...]

    @cached_property
    def numeric(self) -> DataFrame:
        return self.series.where("kind = 'numeric'")

    @cached_property
    def ordered(self) -> DataFrame:
        return self.series.where("kind in ('numeric', 'ordered_cat')")

    @cached_property
    def by_entity(self) -> DataFrame:
        return self.series.where("entity_value is not null").withColumn("fixed_key", F.col("rest_key")).withColumn("entity", F.col("entity_value"))

    def better(self, low: bool) -> Column:
        return F.col("lower_is_better") if low else ~F.col("lower_is_better")

    @cached_property
    def whole(self) -> DataFrame:
        """Cells with the place on the only ordered axis, and the labels of wide tables."""
        c = self.cells
        ways = F.filter("axes", lambda a: a["kind"].isin("numeric", "ordered_cat"))
        x = F.when(F.size(ways) == 1, F.col("numbers")[F.get(ways, 0)["axis"]])
        others = F.filter("axes", lambda a: a["axis"] != F.col("entity"))
        wide = F.col("entity").isNotNull() & (F.size(others) == 1)
        return c.withColumn("x", x).withColumn("row_key", F.when(wide, F.col("coords")[F.get(others, 0)["axis"]])).withColumn("col_key", F.when(wide, F.col("coords")[F.col("entity")]))


def _jumps(c: Context) -> DataFrame:
    return flags_of(detectors.numeric_jumps(c.numeric), "numeric_jump", 1, ["x_from", "x_to", "value_from", "value_to", "ratio", "step", "typical_step", "trend_dev", "try_1", "try_2"], x_from=F.col("x_from"), x_to=F.col("x_to"), endpoint=F.col("endpoint_of_climb"))


def _reversals(c: Context) -> DataFrame:
    found = [detectors.win_reversals(c.by_entity.where(c.better(low) & F.col("kind").isin("numeric", "ordered_cat")), low) for low in (True, False)]
    return flags_of(found[0].unionByName(found[1]), "win_reversal", 2, ["winners", "distinct_winners"])


def _monotonicity(c: Context) -> DataFrame:
    found = [detectors.monotonicity(c.ordered.where(F.col("axis") == axis), way) for axis, way in c.expected.items()] or [detectors.monotonicity(c.ordered.where("false"), "increasing")]
    df = found[0]
    for more in found[1:]:
        df = df.unionByName(more)
    return flags_of(df, "monotonicity", 3, ["n", "reversals"])


def _exceptions(c: Context) -> DataFrame:
    found = [detectors.category_exceptions(c.series.where(c.better(low) & (F.col("kind") == "ordered_cat")), low) for low in (True, False)]
    return flags_of(found[0].unionByName(found[1]), "cat_exception", 4, ["hi", "lo", "holds", "fails"], F.col("strength"))


def _flat(c: Context) -> DataFrame:
    return flags_of(detectors.flat_entities(c.by_entity).withColumn("strength", F.lit(1.0)), "flatness", 5, ["entity", "combos"])


def _duplicates(c: Context) -> DataFrame:
    return flags_of(detectors.duplicates(c.by_entity), "duplicate", 6, ["entity", "value", "levels"])


def _shifts(c: Context) -> DataFrame:
    found = detectors.level_shifts(c.numeric, expect_flat=c.expect_flat)
    return flags_of(found, "level_shift", 7, [*rounded(4, "baseline"), "ref_sd", "trending", "baseline_from", "baseline_to", *rounded(4, "shifted_mean"), "shift_from", "shift_to", "n_persist"], F.col("support"))


def _outliers(c: Context) -> DataFrame:
    """By series first; tables without an outlier there are looked at as a whole."""
    points = staged(detectors.numeric_outliers(c.numeric).where("flagged"), "outliers")
    categories = staged(detectors.categorical_outliers(c.series.where("kind = 'unordered_cat'")).where("flagged"), "outliers")
    some = points.select("table_id").unionByName(categories.select("table_id")).distinct()
    whole = detectors.whole_table_outliers(c.whole.join(some, "table_id", "left_anti"))
    out = flags_of(points, "point_outlier", 8, ["x", "value", "mode", "z"], at=F.col("x"))
    out = out.unionByName(flags_of(categories, "point_outlier", 9, ["x_lab", "value", "log"]))
    return out.unionByName(flags_of(whole, "point_outlier", 10, ["row_id", "value", "z", "log", "column_scale"], column_scale=F.col("column_scale")))


def _trends(c: Context) -> DataFrame:
    found = staged(detectors.trends(c.ordered, expect_flat=c.expect_flat), "trends")
    ci = detectors.trend_intervals(c.ordered)
    on = [found[k].eqNullSafe(ci[k]) for k in detectors.KEY]
    df = found.join(ci, on, "left").select(found["*"], "pearson_ci", "spearman_ci").withColumn("expected_flat", F.col("axis").isin(*c.expect_flat) if c.expect_flat else F.lit(False))
    detail = [*rounded(3, "slope", "r2", "pearson", "spearman"), "pearson_ci", "spearman_ci", "direction", *rounded(2, "start_value", "end_value"), "x_from", "x_to", "expected_flat"]
    return flags_of(df, "trend", 11, detail, F.col("support"), spearman=F.col("spearman"))


#: The detectors by name, in the order in which their flags are emitted.
DETECTORS: dict[str, Callable[[Context], DataFrame]] = {
    "numeric_jump": _jumps, "win_reversal": _reversals, "monotonicity": _monotonicity, "cat_exception": _exceptions, "flatness": _flat,
    "duplicate": _duplicates, "level_shift": _shifts, "point_outlier": _outliers, "trend": _trends,
}


def gate(series: DataFrame) -> DataFrame:
    """Tables with too many axes or combinations."""
    return across.pathological(series.select("table_id", "axis", F.col("x_lab").alias("level"))).where("flagged").select("table_id")


def context(tables: DataFrame, expected: dict[str, str] | None = None, expect_flat: tuple[str, ...] = ()) -> Context:
    s = staged(table_series(tables), "series")
    out = staged(gate(s), "gate")
    c = staged(table_cells(tables).join(out, "table_id", "left_anti"), "cells")
    return Context(s.join(out, "table_id", "left_anti"), c, expected or {}, expect_flat)


def finish(flags: DataFrame, c: Context, sizes: DataFrame | None = None) -> DataFrame:
    """Suppressed, scored and ranked; outliers of columns of model sizes go."""
    flags = across.suppress(flags, detectors.index_like_axes(c.numeric.select("table_id", "axis", "x")))
    if sizes is not None:
        flags = flags.join(sizes.withColumn("type", F.lit("point_outlier")), ["table_id", "type"], "left_anti").select(flags.columns)
    return across.ranked(across.priority(flags))


def together(found: list[DataFrame]) -> DataFrame:
    """All detectors' flags, written by one job, in which they run side by side."""
    flags = found[0]
    for more in found[1:]:
        flags = flags.unionByName(more)
    return staged(flags, "flags")


def analyze(tables: DataFrame, expected: dict[str, str] | None = None, expect_flat: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """Flags of all tables that aren't pathological. `expected` maps axes to 'increasing' or 'decreasing'; `only` names the detectors."""
    c = context(tables, expected, expect_flat)
    found = [f(c) for name, f in DETECTORS.items() if only is None or name in only]
    return finish(together(found), c, tables.where("sizes").select("table_id").distinct())


def not_checked(tables: DataFrame) -> DataFrame:
    """What could not be checked, and why."""
    s = table_series(tables)
    wide = across.pathological(s.select("table_id", "axis", F.col("x_lab").alias("level"))).where("flagged")
    return tables.where("note is not null").select("table_id", F.col("note").alias("reason")).unionByName(wide.select("table_id", F.lit("too many axes or combinations").alias("reason")))


# ---- whole articles


def unit_flags(tables: DataFrame) -> DataFrame:
    """Odd units in the columns of grids as printed; the flag stands at the grid's first table."""
    g = tables.where("note is null and size(body) > 0").select("table_id", "header", F.explode("body").alias("row"))
    c = g.select("table_id", F.posexplode("header").alias("i", "col"), "row").select("table_id", "col", F.get("row", F.col("i")).alias("raw"))
    found = across.unit_mismatches(c).withColumn("axis", F.col("col")).withColumn("strength", F.lit(1.0))
    return flags_of(found, "unit_mismatch", 12, ["odd", "main_unit", "cells"])


def canonical(coords: str = "coords", numbers: str = "numbers") -> Column:
    """Coordinates as one text: sorted by axis, numbers to nine decimals."""
    same = F.transform_values(coords, lambda k, v: F.coalesce(F.round(F.col(numbers)[k], 9).cast("string"), v))
    return F.to_json(F.array_sort(F.map_entries(same)))


def coordinate_cells(tables: DataFrame) -> DataFrame:
    """Cells as cross_table() takes them; tables meet only within their source."""
    c = table_cells(tables).where("table_pos is not null")
    axes = F.to_json(F.concat(F.array("source"), F.array_sort(F.transform("axes", lambda a: a["axis"]))))
    return c.select("source", "table_id", "table_pos", "metric", axes.alias("axes"), canonical().alias("coord"), "row_id", "value", "raw")


def cross_flags(cells: DataFrame) -> DataFrame:
    found = across.cross_table(cells).withColumn("table_id", F.col("table_a"))
    return flags_of(found, "cross_table_inconsistency", 13, ["table_b", "metric", "coord", "a", "b", "shared", "consistent"], F.col("support"))


def shape_notes(cells: DataFrame) -> DataFrame:
    """(table_id, reason) for pairs of tables of one source with the same metric and different axes, which aren't compared."""
    one = cells.groupBy("source", "table_id", "table_pos", across.metric_name(F.col("metric")).alias("metric"), "axes").agg(F.lit(1).alias("_n"))
    a, b = (one.select("source", "metric", F.col("table_id").alias(f"t_{x}"), F.col("table_pos").alias(f"p_{x}"), F.col("axes").alias(f"x_{x}")) for x in "ab")
    both = a.join(b, ["source", "metric"]).where("p_a < p_b and x_a <> x_b")
    return both.select(F.col("t_a").alias("table_id"), F.concat(F.lit("not compared with "), "t_b", F.lit(": the same metric '"), "metric", F.lit("' over other axes")).alias("reason"))


def stat_findings(tables: DataFrame) -> DataFrame:
    """Recomputed statistics of each source: (source, kind, item, status, severity, reason); status is finding, ok or not_applicable, the
    last always with its reason."""
    found = staged(reported.extract_tests(tables.where("stat_text is not null").select("source", F.col("stat_text").alias("text"))).select("source", "test", "string").distinct(), "tests")
    row = lambda df, kind, item, status, severity, reason: df.select("source", F.lit(kind).alias("kind"), item.alias("item"), status.alias("status"), severity.alias("severity"), F.when(status == "not_applicable", reason).alias("reason"))
    none, high = F.lit(None).cast("string"), F.when(F.col("status") == "finding", "high")
    out = row(reported.statcheck(found), "statcheck", F.col("string"), F.col("status"), F.col("severity"), F.col("reason"))
    m = reported.means(found)
    for kind, checked in (("grim", reported.grim(m, F.col("mean"), F.col("n"))), ("grimmer", reported.grimmer(m, F.col("mean"), F.col("sd"), F.col("n")))):
        why = F.lit("n isn't within 1..1000, a printed value lacks decimals, or the mean itself is impossible")
        out = out.unionByName(row(checked.withColumn("status", F.col(kind)), kind, F.col("string"), F.col("status"), high, why))
    c = table_cells(tables).where(detectors.finite("value"))
    b = reported.benford(c, ["source"], "value")
    out = out.unionByName(row(b, "benford", F.concat(F.col("n").cast("string"), F.lit(" values")), F.col("status"), F.when(F.col("status") == "finding", "medium"), F.lit("fewer than 30 values, a span below 100, or too few expected nines")))
    d = reported.terminal_digits(c, ["source"], "raw")
    out = out.unionByName(row(d, "terminal_digit", F.concat(F.col("n").cast("string"), F.lit(" values")), F.col("status"), F.when(F.col("status") == "finding", "medium"), F.lit("fewer than 50 values with decimals")))
    return out.withColumn("severity", F.coalesce("severity", none))


@dataclass
class Article:
    """All that was found in sources, by table_id or source."""

    tables: DataFrame
    flags: DataFrame
    findings: DataFrame
    notes: DataFrame

    def coverage(self) -> DataFrame:
        """By source: how many grids were read, and how, and how many tables came of them."""
        t = self.tables.where("grid_id is not null")
        return t.groupBy("source").agg(F.countDistinct("grid_id").alias("grids"), *(F.countDistinct(F.when(F.col("status") == s, F.col("grid_id"))).alias(s) for s in ("ok", "partial", "merged", "skipped", "non_table")), F.count(F.when(F.col("note").isNull(), 1)).alias("tables"))


def analyze_article(tables: DataFrame, expected: dict[str, str] | None = None, expect_flat: tuple[str, ...] = (), only: list[str] | None = None) -> Article:
    """Flags of all detectors, of units and across tables, ranked together; recomputed statistics; and what could not be checked."""
    tables = staged(tables, "tables")
    c = context(tables, expected, expect_flat)
    coords = staged(coordinate_cells(tables), "coordinates")
    found = [f(c) for name, f in DETECTORS.items() if only is None or name in only]
    flags = staged(finish(together([*found, unit_flags(tables), cross_flags(coords)]), c, tables.where("sizes").select("table_id").distinct()), "ranked")
    findings = staged(stat_findings(tables), "findings")
    notes = not_checked(tables).unionByName(shape_notes(coords)).unionByName(detectors.fit_notes(c.ordered).select("table_id", F.concat("axis", F.lit(": "), "note").alias("reason")))
    notes = notes.unionByName(findings.where("status = 'not_applicable'").select(F.col("source").alias("table_id"), F.concat_ws(": ", "kind", "item", "reason").alias("reason")))
    return Article(tables, flags, findings, staged(notes, "notes"))


def direction_of(tables: DataFrame) -> DataFrame:
    return tables.withColumn("direction", metric_direction(F.col("metric")))
