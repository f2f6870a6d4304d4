"""Captions and takeaways of all tables: each table's few facts meet in one row, and a batched function fills the templates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences
from ..operators import across
from ..sources.readers import cells as table_cells
from .analyze import direction_of

TOP = 4


def _facts(flags: DataFrame, told: tuple[str, ...] | None) -> DataFrame:
    """By table: its flags in order as JSON, all or, for captions, the first of those that captions tell of."""
    f = flags if told is None else flags.where(F.col("type").isin(*sentences.DESCRIPTIVE) | (F.col("type").isin(*sentences.PROMOTED) & F.col("priority").isin("HIGH", "MEDIUM")))
    if told is not None:
        f = f.withColumn("_i", F.row_number().over(Window.partitionBy("table_id").orderBy("rank"))).where(F.col("_i") <= TOP)
    row = F.struct("rank", "type", "axis", "fixed_key", "detail", "strength", "priority")
    return f.groupBy("table_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("flags"))


def unpacked(text: str | None) -> list[dict]:
    """Flags with their details and coordinates as dicts."""
    out = []
    for f in json.loads(text) if text else []:
        fixed = json.loads(f["fixed_key"]) if str(f.get("fixed_key") or "").startswith("[") else []
        coords = {e["key"]: e["value"] for e in fixed} if all(isinstance(e, dict) for e in fixed) else {}
        out.append({"axis": None, **f, "coords": coords, "detail": json.loads(f.get("detail") or "{}")})
    return out


def _meta(tables: DataFrame) -> DataFrame:
    t = direction_of(tables.where("note is null and metric is not null"))
    return t.select("table_id", "grid_id", "table_pos", "name", "metric", "entity", "who", "direction", "lower_is_better", F.transform("axes", lambda a: a["axis"]).alias("axes"))


def _table(row) -> dict:
    return {c: (None if getattr(row, c) is None or getattr(row, c) is pd.NA else getattr(row, c)) for c in ("name", "metric", "entity", "who", "direction")} | {"axes": list(row.axes)}


def captions(tables: DataFrame, flags: DataFrame, level: str = "medium", word_budget: int | None = None) -> DataFrame:
    """(table_id, caption) of every table that was read."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.table_id, sentences.caption(_table(r), unpacked(r.flags), level, word_budget)) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["table_id", "caption"])

    return _meta(tables).join(_facts(flags, sentences.DESCRIPTIVE), "table_id", "left").mapInPandas(task, "table_id string, caption string")


def contests(tables: DataFrame) -> DataFrame:
    """By table and setting: the winner and the runner-up. Lower wins only where the metric's name says so."""
    c = direction_of(table_cells(tables)).where("who is not null")
    others = F.map_filter("coords", lambda k, v: k != F.col("who"))
    order = F.min("row_id").over(Window.partitionBy("table_id", "setting"))
    x = c.withColumn("setting", F.to_json(F.array_sort(F.map_entries(others)))).withColumn("first_row", order)
    x = x.withColumn("competitor", F.col("coords")[F.col("who")])
    rows = x.select("table_id", "setting", F.col("competitor").alias("who"), "value", "direction", "first_row", "row_id")
    won = [across.winners(rows.where(part).select("table_id", "setting", "who", "value", "row_id"), low) for part, low in ((F.col("direction") == "lower", True), (F.coalesce(F.col("direction"), F.lit("")) != "lower", False))]
    return won[0].unionByName(won[1]).join(rows.groupBy("table_id", "setting").agg(F.min("first_row").alias("first_row")), ["table_id", "setting"])


def takeaways(tables: DataFrame, flags: DataFrame) -> DataFrame:
    """(grid_id, takeaway) of every grid: up to three sentences on the tables it was split into."""
    won = contests(tables).groupBy("table_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("first_row", "best", "best_value", "second", "second_value")))).alias("wins"))
    one = _meta(tables).join(_facts(flags, None), "table_id", "left").join(won, "table_id", "left")
    per = one.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("table_pos", "table_id", "name", "metric", "entity", "who", "direction", "axes", "flags", "wins"))).alias("tables"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for grid, parts in zip(pdf["grid_id"], pdf["tables"], strict=True):
                found = [({k: p[k] for k in ("name", "metric", "entity", "who", "direction")} | {"axes": list(p["axes"])}, unpacked(p["flags"]), json.loads(p["wins"] or "[]")) for p in (p if isinstance(p, dict) else p.asDict() for p in parts)]
                rows.append((grid, sentences.grid_takeaway(found)))
            yield pd.DataFrame(rows, columns=["grid_id", "takeaway"])

    return per.mapInPandas(task, "grid_id string, takeaway array<string>")
