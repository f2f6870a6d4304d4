"""Command lines: `python -m tabaudit.cli csv FILE ...` for tables, `python -m tabaudit.cli article FILE ...` for articles.

Exit code 2 says that the input could not be read or names a column that isn't there.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.claims import compare
from .plans import report, text
from .plans.analyze import analyze, analyze_article
from .plans.bounded import run_bounded
from .sources.infer import Hints
from .sources.readers import read_tables
from .sources.stage import shared_folder


def orders(given: str | None) -> dict[str, list[str]]:
    """'axis=a,b;other=c,d' as lists by axis."""
    out = {}
    for part in filter(None, (given or "").split(";")):
        axis, found, levels = part.partition("=")
        if not found:
            raise ValueError(f"an order is written axis=first,second: {part}")
        out[axis.strip()] = [x.strip() for x in levels.split(",")]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabaudit")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("csv", help="check the tables of CSV files")
    c.add_argument("path")
    for name in ("metric", "entity", "order", "html", "compare-caption"):
        c.add_argument(f"--{name}")
    for name in ("ignore", "expect-increasing", "expect-decreasing", "expect-flat"):
        c.add_argument(f"--{name}", action="append", default=[])
    way = c.add_mutually_exclusive_group()
    way.add_argument("--lower-better", action="store_true")
    way.add_argument("--higher-better", action="store_true")
    c.add_argument("--caption", nargs="?", const="medium", choices=("short", "medium", "detailed"))
    c.add_argument("--caption-words", type=int)
    c.add_argument("--no-takeaway", action="store_true")
    c.add_argument("--json", action="store_true")
    a = sub.add_parser("article", help="check the tables and statistics of LaTeX, Word and Excel files")
    a.add_argument("path")
    a.add_argument("--expect-flat", action="append", default=[])
    a.add_argument("--detector-seconds", type=float, default=4.0)
    a.add_argument("--checkpoint-dir")
    a.add_argument("--json", action="store_true")
    return p


def _csv(spark: SparkSession, o: argparse.Namespace) -> str:
    better = True if o.lower_better else False if o.higher_better else None
    tables = read_tables(spark, o.path, Hints(o.metric, o.entity, better, orders(o.order), None, o.ignore))
    rows = tables.select("name", "note", "header", "entity").collect()
    if bad := [f"{r['name']}: {r['note']}" for r in rows if r["note"]]:
        raise ValueError("; ".join(bad))
    columns = {h for r in rows for h in r["header"] or []} | {r["entity"] for r in rows}
    if missing := [c for c in (o.metric, o.entity, *o.ignore, *o.expect_increasing, *o.expect_decreasing, *o.expect_flat) if c and c not in columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    expected = dict.fromkeys(o.expect_increasing, "increasing") | dict.fromkeys(o.expect_decreasing, "decreasing")
    flags = analyze(tables, expected, tuple(o.expect_flat))
    told = {r["table_id"]: r["caption"] for r in text.captions(tables, flags, o.caption or "medium", o.caption_words).collect()} if o.caption or o.compare_caption else {}
    takeaway = [] if o.no_takeaway else [s for r in text.takeaways(tables, flags).orderBy("grid_id").collect() for s in r["takeaway"]]
    out, pages = [], []
    for table, found in report.table_reports(tables, flags):
        more: dict[str, object] = {}
        if table["table_id"] in told:
            more["caption"] = told[table["table_id"]]
        if o.compare_caption:
            row = compare(spark.createDataFrame([(more["caption"], o.compare_caption)], "g string, r string"), "g", "r").first()
            more["caption_comparison"] = {k: row[k] for k in ("shared", "generated_only", "real_only", "recall", "precision")}
        if takeaway:
            more["takeaway"] = takeaway
        pages.append(report.html_report(table["name"], table, found))
        out.append(report.json_report(table, found, **more) if o.json else "\n".join([report.text_report(table["name"], table, found), *(f"{k}: {v}" for k, v in more.items())]))
    if o.html:
        with open(o.html, "w", encoding="utf-8") as f:
            f.write("\n".join(pages))
    return "\n\n".join(out)


def _article(spark: SparkSession, o: argparse.Namespace) -> str:
    tables = read_tables(spark, o.path)
    runs = run_bounded(tables, o.checkpoint_dir or f"{shared_folder(spark)}/detectors", o.detector_seconds, expect_flat=tuple(o.expect_flat))
    done = [r.detector for r in runs if r.status in ("completed", "reused")]
    a = analyze_article(tables, expect_flat=tuple(o.expect_flat), only=done or ["flatness"])
    sources = [r["source"] for r in a.tables.select("source").distinct().orderBy("source").collect()]
    if o.json:
        records = [{"detector": r.detector, "status": r.status, "reason": r.reason} for r in runs]
        rows = [r.asDict() for r in report.article_rows(a).orderBy("source").collect()]
        return json.dumps({"sources": rows, "detector_runs": records}, ensure_ascii=False, indent=2, default=str)
    return "\n\n".join(report.article_report(a, s, {r.detector: r.status for r in runs}) for s in sources)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tabaudit").getOrCreate()
    try:
        print({"csv": _csv, "article": _article}[o.command](spark, o))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
