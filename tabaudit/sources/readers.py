"""Files of small tables as DataFrames: a row a table, then cells and series.

Any number of files is read in parallel (binaryFile), each parsed by a plain function in an Arrow-batched map. What could not be
read becomes a row with `note` and no cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gate, infer, latex, office, text_layer

TABLES = (
    "table_id string, source string, name string, metric string, entity string, lower_is_better boolean, note string, stat_text string, who string, "
    "axes array<struct<pos:int,axis:string,kind:string,ord:array<string>>>, "
    "cells array<struct<row_id:long,coords:map<string,string>,numbers:map<string,double>,value:double,raw:string>>, "
    "grid_id string, table_pos int, status string, caveats array<string>, header array<string>, body array<array<string>>, sizes boolean"
)
COLUMNS = [c.split()[0] for c in TABLES.replace("struct<pos:int,axis:string,kind:string,ord:array<string>>", "s").replace("struct<row_id:long,coords:map<string,string>,numbers:map<string,double>,value:double,raw:string>", "s").split(", ")]
Grids = Iterator[tuple[str, list[str], list[list[str]]]]


def _csv(name: str, body: bytes) -> tuple[Grids, str]:
    return iter([(name, *infer.parse_csv(body.decode("utf-8-sig")))]), ""


FORMATS: dict[str, Callable[[str, bytes], tuple[Grids, str]]] = {"csv": _csv, "tex": latex.grids, "txt": latex.grids, "docx": office.docx_grids, "xlsx": office.xlsx_grids}


def _text(x: float | str) -> str:
    return f"{x:g}" if isinstance(x, float) and abs(x) < 1e15 and float(f"{x:g}") == x else str(x)


def table_rows(base: dict, grid_id: str, title: str, header: list[str], body: list[list[str]], hints: infer.Hints | None, verdict: gate.Verdict | None = None, first: int = 0) -> list[dict]:
    """Rows of TABLES for one grid; a grid that the gate refuses is a note."""
    seen = {"grid_id": grid_id, "header": header, "body": body, "status": "ok", "caveats": []}
    if verdict is not None:
        seen |= {"header": verdict.header, "body": verdict.body, "status": verdict.status, "caveats": verdict.caveats}
        if verdict.status not in ("ok", "partial"):
            return [base | seen | {"table_id": grid_id, "name": title, "note": verdict.reason}]
        header, body = verdict.header, verdict.checked
    try:
        tables, notes = infer.all_tables(infer.Grid(header, body), title, hints)
    except ValueError as e:
        tables, notes = [], [str(e)]
    out = []
    for i, t in enumerate(tables):
        axes = [{"pos": k, "axis": a, "kind": kind, "ord": o} for k, (a, kind, o) in enumerate(t.axes)]
        cells = [{"row_id": k, "coords": {a: _text(x) for a, x in c.items()}, "numbers": {a: x for a, x in c.items() if isinstance(x, float)}, "value": v, "raw": raw} for k, (c, v, raw) in enumerate(t.rows)]
        sizes = gate.parameter_column(t.metric, [raw for _, v, raw in t.rows if v is not None])
        # The grid stands on its first table's row.
        own = seen if i == 0 else seen | {"header": [], "body": []}
        out.append(base | own | {"table_id": f"{base['source']}#{t.name}", "name": t.name, "metric": t.metric, "entity": t.entity, "lower_is_better": t.lower_is_better, "axes": axes, "cells": cells, "table_pos": first + i, "sizes": sizes, "who": infer.competitors(t)})
    return out + [base | {"table_id": f"{grid_id}#note{i}", "note": n} for i, n in enumerate(notes)]


def parse_file(path: str, body: bytes, hints: infer.Hints | None = None) -> list[dict]:
    """Rows of TABLES for one file. Grids of articles (LaTeX, Word, Excel) pass the gate; a CSV file is taken as it is."""
    name = path.rsplit("/", 1)[-1]
    base = dict.fromkeys(COLUMNS) | {"source": path, "name": name, "axes": [], "cells": []}
    try:
        kind = name.rsplit(".", 1)[-1].lower()
        reader = FORMATS.get(kind)
        if reader is None:
            return [base | {"table_id": path, "note": "this kind of file can't be read here"}]
        grids, text = reader(name, body)
        out = [base | {"table_id": f"{path}#text", "stat_text": text}] if text else []
        for i, (title, header, rows) in enumerate(grids):
            verdict = None if kind == "csv" else gate.assess([header, *rows], structured=True)
            out += table_rows(base, f"{path}#grid{i}", title, header, rows, hints, verdict, len(out))
        return out
    except Exception as e:  # noqa: BLE001  one bad file is a note, not the end of the job
        return [base | {"table_id": path, "note": f"could not be read: {e}"}]


def read_tables(spark: SparkSession, path: str, hints: infer.Hints | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, b in zip(pdf["path"], pdf["content"], strict=True) for r in parse_file(p, bytes(b), hints)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"table_pos": "Int32", "lower_is_better": "boolean", "sizes": "boolean"})

    return files.mapInPandas(task, TABLES)


def from_text(spark: SparkSession, texts: dict[str, str], hints: infer.Hints | None = None) -> DataFrame:
    """Tables of texts by file name, for small inputs at hand."""
    rows = [r for name, text in texts.items() for r in parse_file(name, text.encode(), hints)]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], TABLES)


def from_words(words: DataFrame) -> DataFrame:
    """Tables recovered from the words of pages (doc_id, page, text, x0, x1, top), gated like grids read off a page."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, number, grid, note in pdf[["doc_id", "page", "number", "grid", "note"]].itertuples(index=False):
                base = dict.fromkeys(COLUMNS) | {"source": doc, "name": doc, "axes": [], "cells": []}
                if grid is None:
                    rows.append(base | {"table_id": f"{doc}#page{page}", "note": note})
                    continue
                cells = [list(map(str, r)) for r in grid]
                title = f"page{page}_table{int(number)}"
                rows += table_rows(base, f"{doc}#{title}", title, cells[0], cells[1:], None, gate.assess(cells))
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"table_pos": "Int32", "lower_is_better": "boolean", "sizes": "boolean"})

    return text_layer.recover_tables(words).mapInPandas(task, TABLES)


def cells(tables: DataFrame) -> DataFrame:
    """A row a cell: table_id, entity, metric, lower_is_better, axes, row_id, coords, value, raw."""
    return tables.where("note is null").select("table_id", "name", "metric", "entity", "lower_is_better", "axes", "who", "source", "table_pos", F.explode("cells").alias("c")).select("table_id", "name", "metric", "entity", "lower_is_better", "axes", "who", "source", "table_pos", "c.row_id", "c.coords", "c.numbers", "c.value", "c.raw")


def series(tables: DataFrame) -> DataFrame:
    """A row a cell and axis, as the detectors take them: x is the number of a numeric level (0 for a label among numbers), the
    position of an ordered one, the order of appearance of others; fixed_key the other coordinates in the order of the axes."""
    c = cells(tables)
    x = c.select("*", F.explode("axes").alias("a")).drop("axes").select("*", "a.pos", "a.axis", "a.kind", "a.ord").drop("a")
    x = x.withColumn("x_lab", F.col("coords")[F.col("axis")])
    others = F.map_filter("coords", lambda k, v: k != F.col("axis"))
    x = x.withColumn("fixed", others).withColumn("fixed_key", F.to_json(F.array_sort(F.map_entries(others))))
    rest = F.map_filter("coords", lambda k, v: (k != F.col("axis")) & (F.col("entity").isNull() | (k != F.col("entity"))))
    x = x.withColumn("rest_key", F.to_json(F.array_sort(F.map_entries(rest)))).withColumn("entity_value", F.when(F.col("entity").isNotNull() & (F.col("entity") != F.col("axis")), F.col("coords")[F.col("entity")]))
    seen = F.min("row_id").over(Window.partitionBy("table_id", "axis", "x_lab"))
    entity_pos = F.min("row_id").over(Window.partitionBy("table_id", "axis", "entity_value"))
    place = F.when(F.col("kind") == "numeric", F.coalesce(F.col("numbers")[F.col("axis")], F.lit(0.0))).when(F.col("kind") == "ordered_cat", F.nullif(F.array_position("ord", F.col("x_lab")).cast("double"), F.lit(0.0)))
    return x.withColumn("seen", seen).withColumn("entity_pos", entity_pos).withColumn("x", F.coalesce(place, F.col("seen").cast("double")))
