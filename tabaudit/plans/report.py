"""Reports: flags as text, JSON and HTML, of tables and of whole articles.

What is large stays distributed: write_json() and the frames of an Article. What is read by a person is formatted from rows that the
caller limits by table or source.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentences
from .analyze import Article
from .text import takeaways, unpacked

PRIORITIES = ("HIGH", "MEDIUM", "LOW")


def priority_counts(flags: DataFrame) -> DataFrame:
    """(table_id, high, medium, low)."""
    return flags.groupBy("table_id").agg(*(F.count(F.when(F.col("priority") == p, 1)).alias(p.lower()) for p in PRIORITIES))


def report_rows(flags: DataFrame) -> DataFrame:
    """A JSON object a table, flags in order: what a web page or another program takes."""
    flag = F.struct("rank", "type", "priority", "axis", "fixed_key", F.round("strength", 4).alias("strength"), F.round("support", 4).alias("support"), "detail")
    per = flags.groupBy("table_id").agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    counts = priority_counts(flags).select("table_id", F.struct(*(p.lower() for p in PRIORITIES)).alias("counts"))
    return per.join(counts, "table_id").select("table_id", F.to_json(F.struct("table_id", "counts", "flags")).alias("json"))


def write_json(flags: DataFrame, path: str) -> None:
    """Reports of all tables as JSON lines."""
    report_rows(flags).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def _lines(flag: dict, table: dict) -> list[str]:
    at = f" along '{flag['axis']}'" if flag.get("axis") else ""
    head = sentences.scoped(flag, f"[{flag['priority']}] {flag['type']}{at}")
    text = sentences.phrase(flag, table["metric"], table["entity"])
    return [f"  {head}", f"      {text[:1].upper()}{text[1:]}: you may want to look at it."]


def summary(flags: list[dict]) -> str:
    n = {p: sum(f["priority"] == p for f in flags) for p in PRIORITIES}
    return ", ".join(f"{p}={k}" for p, k in n.items() if k)


def text_report(name: str, table: dict, flags: list[dict]) -> str:
    """One table's flags in order, with a summary by priority."""
    if not flags:
        return f"No anomalies flagged in '{name}'."
    lines = [f"Report for '{name}' ({len(flags)} flag(s))", "=" * 64, f"Summary: {summary(flags)}", ""]
    for f in flags:
        lines += _lines(f, table)
    return "\n".join(lines)


def json_report(table: dict, flags: list[dict], **more: object) -> str:
    """One table's flags; captions, takeaways and comparisons as they are asked for."""
    keep = ("type", "priority", "axis", "coords", "detail", "strength", "support")
    return json.dumps({"table": table["name"], "metric": table["metric"], "lower_is_better": table.get("lower_is_better"), "flags": [{k: f.get(k) for k in keep} for f in flags]} | more, ensure_ascii=False, indent=2)


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>
body {{ font: 15px/1.5 sans-serif; max-width: 60em; margin: 2em auto }} li {{ margin: .6em 0 }} .LOW {{ color: #555 }} .HIGH b {{ color: #a00 }}
</style></head><body><h1>{title}</h1><p>{summary}</p>
<p>Show: {choices}</p><ul>{items}</ul>
<script>
for (const box of document.querySelectorAll("input")) box.addEventListener("change", () => {{
  for (const item of document.querySelectorAll("li." + box.value)) item.hidden = !box.checked;
}});
</script></body></html>
"""


def html_report(name: str, table: dict, flags: list[dict]) -> str:
    """A page that stands alone; flags can be shown and hidden by priority."""
    e = html.escape
    choices = " ".join(f'<label><input type="checkbox" value="{p}" checked> {p}</label>' for p in PRIORITIES if any(f["priority"] == p for f in flags))
    items = "".join(f'<li class="{e(f["priority"])}"><b>{e(_lines(f, table)[0].strip())}</b><br>{e(_lines(f, table)[1].strip())}</li>' for f in flags)
    return _PAGE.format(title=e(f"Report for {name}"), summary=e(summary(flags) or "No anomalies flagged."), choices=choices, items=items)


def table_reports(tables: DataFrame, flags: DataFrame) -> list[tuple[dict, list[dict]]]:
    """The tables of an input that one person reads, in order, with their flags."""
    rows = tables.where("note is null and metric is not null").orderBy("source", "table_pos").select("table_id", "name", "metric", "entity", "lower_is_better").collect()
    by: dict[str, list[dict]] = {}
    for r in flags.orderBy("table_id", "rank").select("table_id", "rank", "type", "axis", "fixed_key", "detail", "strength", "support", "priority").collect():
        by.setdefault(r["table_id"], []).append(unpacked(json.dumps([r.asDict()]))[0])
    return [(r.asDict(), by.get(r["table_id"], [])) for r in rows]


def article_rows(a: Article) -> DataFrame:
    """A JSON object a source: coverage, flags, findings, takeaways, and what could not be checked."""
    source = a.tables.select("table_id", "source").distinct()
    of = lambda df, *cols: F.to_json(F.collect_list(F.struct(*cols)))
    flags = a.flags.join(source, "table_id").groupBy("source").agg(of(a.flags, "table_id", "rank", "type", "priority", "axis", "detail").alias("pattern_flags"))
    found = a.findings.where("status <> 'not_applicable'").groupBy("source").agg(of(a.findings, "kind", "item", "status", "severity").alias("stat_findings"), F.count(F.when(F.col("status") == "ok", 1)).alias("stat_ok"))
    where = F.coalesce(source["source"], a.notes["table_id"])
    notes = a.notes.join(source, "table_id", "left").withColumn("source", where).groupBy("source").agg(of(a.notes, "table_id", "reason").alias("could_not_check"))
    grids = a.tables.where("grid_id is not null").select("grid_id", "source").distinct()
    told = takeaways(a.tables, a.flags).join(grids, "grid_id").groupBy("source").agg(of(a.flags, "grid_id", "takeaway").alias("takeaways"))
    out = a.tables.select("source").distinct()
    for part in (a.coverage(), flags, found, notes, told):
        out = out.join(part, "source", "left")
    return out


def write_article_json(a: Article, path: str) -> None:
    article_rows(a).write.mode("overwrite").json(path)


def article_report(a: Article, source: str, runs: dict[str, str] | None = None) -> str:
    """One source as text: what was read, flags by table, recomputed statistics, what could not be checked, and a bottom line."""
    row = article_rows(a).where(F.col("source") == source).first()
    if row is None:
        return f"Nothing was read from '{source}'."
    own = a.tables.where(F.col("source") == source)
    tables = table_reports(own, a.flags.join(own.select("table_id").distinct(), "table_id", "left_semi"))
    out = [f"Report for '{source}'", "=" * 64, f"Tables read: {row['tables'] or 0} from {row['grids'] or 0} grids ({row['ok'] or 0} clean, {row['partial'] or 0} with caveats, {row['skipped'] or 0} skipped)"]
    if runs:
        out.append("Detector runs: " + ", ".join(f"{k} {v}" for k, v in sorted(runs.items())))
    out += ["", "PATTERNS"]
    for table, flags in tables:
        if flags:
            out += [f" {table['name']}: {summary(flags)}", *(line for f in flags for line in _lines(f, table))]
    if not any(flags for _, flags in tables):
        out.append("  none flagged")
    findings = json.loads(row["stat_findings"] or "[]")
    wrong = [f for f in findings if f["status"] == "finding"]
    out += ["", "REPORTED STATISTICS", *(f"  [{(f.get('severity') or '').upper()}] {f['kind']}: {f['item']}" for f in wrong), f"  {row['stat_ok'] or 0} agree with what was recomputed"]
    out += ["", "TAKEAWAYS (computed; the authors may conclude differently)", *(f"  {s}" for g in json.loads(row["takeaways"] or "[]") for s in g["takeaway"])]
    lost = json.loads(row["could_not_check"] or "[]")
    out += ["", "WHAT COULD NOT BE CHECKED", *(f"  {n['table_id']}: {n['reason']}" for n in lost)]
    strong = sum(f["priority"] == "HIGH" for _, flags in tables for f in flags)
    out += ["", f"Bottom line: {strong} high-priority flag(s) and {len(wrong)} statistic(s) to look at; {len(lost)} thing(s) could not be checked."]
    return "\n".join(out)
