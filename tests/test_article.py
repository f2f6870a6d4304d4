"""Articles end to end: the gate, units, cells across tables, recomputed statistics, sentences, reports and command lines."""

import json
import random

import numpy as np
import pytest

from tabaudit import cli
from tabaudit.functions import sentences
from tabaudit.functions.numbers import parse_number
from tabaudit.operators import detectors
from tabaudit.plans import bounded, evaluate, report, text
from tabaudit.plans.analyze import analyze_article
from tabaudit.sources import gate, infer, latex, text_layer
from tabaudit.sources.readers import from_text, from_words

TABLE = r"\begin{table}\caption{%s}\begin{tabular}{l%s} %s \\ \midrule %s \end{tabular}\end{table}"


def table(caption, header, rows):
    return TABLE % (caption, "c" * (len(header) - 1), " & ".join(header), " ".join(" & ".join(r) + r" \\" for r in rows))


SPEEDS = [[m, str(v), f] for m, v, f in (("alpha", 12.5, "1.9M"), ("beta", 13.0, "2.4M"), ("gamma", 12.75, "79.8G"), ("delta", 13.25, "154.7M"), ("eps", 12.0, "8.1M"))]
ARTICLE = r"""We saw t(38) = 2.10, p = .03 and z = 1.2, p = .01, and r(20) = 1.2, p < .001.
M = 3.45, SD = 1.20, N = 7 against M = 3.00, SD = 1.58, N = 5. """ + table("Accuracy of models", ["Model", "Accuracy"], [[m, str(v)] for m, v in (("alpha", 90.1), ("beta", 91.25), ("gamma", 89.5), ("delta", 92.0))]) + table("Accuracy again", ["Model", "Accuracy"], [[m, str(v)] for m, v in (("alpha", 90.1), ("beta", 93.75), ("gamma", 89.5), ("delta", 92.0))]) + table("Accuracy by size", ["Size", "Accuracy"], [[str(n), str(n * 1.5)] for n in range(1, 9)]) + table("Speed", ["Model", "Error", "FLOPs"], SPEEDS) + table("Words", ["a", "b"], [["x", "y1"], ["z", "w2"], ["u", "v3"]])


@pytest.fixture(scope="module")
def article(spark):
    return analyze_article(from_text(spark, {"paper.tex": ARTICLE}))


def test_article(article):
    kinds = {r["type"] for r in article.flags.collect()}
    assert {"cross_table_inconsistency", "unit_mismatch", "trend"} <= kinds
    found = {(r["kind"], r["status"]) for r in article.findings.collect()}
    assert {("statcheck", "finding"), ("statcheck", "not_applicable"), ("grim", "finding"), ("grim", "ok"), ("grimmer", "ok"), ("benford", "not_applicable")} <= found
    assert all(r["reason"] for r in article.findings.where("status = 'not_applicable'").collect())
    notes = [r["reason"] for r in article.notes.collect()]
    assert any("over other axes" in n for n in notes) and any("no numeric column" in n for n in notes)
    (row,) = article.coverage().collect()
    assert (row["grids"], row["skipped"], row["ok"]) == (5, 1, 4)


def test_article_report(article):
    said = report.article_report(article, "paper.tex")
    for part in ("PATTERNS", "REPORTED STATISTICS", "WHAT COULD NOT BE CHECKED", "Bottom line:", "79.8G"):
        assert part in said
    (row,) = report.article_rows(article).collect()
    assert row["source"] == "paper.tex" and json.loads(row["pattern_flags"]) and json.loads(row["takeaways"])
    assert report.article_report(article, "other.tex").startswith("Nothing")


def test_captions_and_takeaways(article, spark):
    told = {r["table_id"].split("#")[1]: r["caption"] for r in text.captions(article.tables, article.flags).collect()}
    assert told["Accuracy by size"].startswith("Accuracy across Size. Accuracy increases as Size increases (roughly linear, Pearson r=1.0")
    said = {r["grid_id"]: r["takeaway"] for r in text.takeaways(article.tables, article.flags).collect()}
    assert said["paper.tex#grid0"][0] == "delta has the best Accuracy (92), ahead of beta (91.25)."
    assert any("check" in s for s in said["paper.tex#grid3"])
    short = {r["caption"] for r in text.captions(article.tables, article.flags, word_budget=4).collect()}
    assert "Accuracy across Size." in short


def test_json_lines(article, spark, tmp_path):
    report.write_json(article.flags, str(tmp_path / "flags"))
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "flags")).collect()]
    assert all(sum(r["counts"].values()) == len(r["flags"]) for r in rows) and len(rows) == article.flags.select("table_id").distinct().count()
    report.write_article_json(article, str(tmp_path / "article"))
    assert spark.read.json(str(tmp_path / "article")).count() == 1


def flag(kind, **more):
    return {"type": kind, "axis": "x", "coords": {}, "detail": {}, "strength": 1.0, "priority": "HIGH"} | more


def test_sentences():
    t = {"name": "t", "metric": "RMSE", "entity": "method", "who": "method", "direction": "lower", "axes": ["x", "method"]}
    jump = flag("numeric_jump", detail={"x_from": 1.0, "x_to": 2.5}, coords={"method": "A"})
    assert sentences.caption(t, [jump]) == "RMSE for each method across x. RMSE jumps sharply between x=1 and x=2.5 (method=A)."
    assert sentences.caption(t, [flag("numeric_jump", priority="LOW")]) == "RMSE for each method across x. No notable pattern is flagged."
    many = [flag("win_reversal", detail={"winners": "A,B,A"}), flag("cat_exception", strength=0.5), jump | {"strength": 9.0}]
    assert sentences.caption(t, many, "detailed").endswith("Also: the best method changes along x (order: A, B, A); the usual ordering along x has an exception.")
    assert sentences.caption(t, many, word_budget=6) == "RMSE for each method across x."
    win = lambda best, v=1.0: {"best": best, "best_value": v, "second": "C", "second_value": 2.0}
    assert sentences.who_wins(t, [win("A"), win("A")]) == "A has the best RMSE in both settings."
    assert sentences.who_wins(t, [win("A"), win("B")]) is None
    assert sentences.who_wins(t, [win("A"), win("B"), win("C")]) == "No single method leads: A in 1, B in 1, C in 1 of the 3 settings."
    shift = flag("level_shift", detail={"baseline": 2.0, "shifted_mean": 3.0, "shift_from": 7.0}, priority="LOW")
    assert sentences.what_matters(t, [shift]) == "RMSE moves to a new level from x=7 on (about 2 before, 3 after). The tool is not confident this is a shift rather than a steep trend."
    assert sentences.what_matters(t, [flag("level_shift", detail={"baseline": 2.0, "shifted_mean": 2.1}, priority="LOW")]) is None
    assert sentences.what_to_check([(t, jump), (t, jump)]) == "Before relying on it, check the 2 flagged values, for example: RMSE jumps sharply between x=1 and x=2.5 (method=A)."
    columns = [({**t, "metric": m, "name": f"t [{m}]"}, [], [win(b)]) for m, b in (("acc", "A"), ("auc", "A"), ("bleu", "B"), ("params", "C"))]
    assert sentences.grid_takeaway(columns) == ["A has the best value in 2 of 3 result columns (acc, auc); B in bleu."]


def test_html_is_escaped():
    t = {"name": "<b>", "metric": "<m>", "entity": None}
    page = report.html_report("<b>", t, [flag("flatness", axis="<script>")])
    assert "<script>alert" not in page and "&lt;script&gt;" in page and 'value="HIGH"' in page and 'value="LOW"' not in page


@pytest.mark.parametrize("rows, status, part", [
    ([["a", "b"], ["1", "2"]], "skipped", "too small"),
    ([["Manuscript number", "x"], ["Keywords", "y"], ["z", "w"]], "non_table", "not a results"),
    ([["m", "(ms)"], ["a", "1"], ["b", "2"]], "skipped", "split across"),
    ([["1", "2"], ["3", "4"], ["5", "6"]], "skipped", "shredded"),
    ([["Table 6 and", "x", "y"], ["a", "1", "2"], ["b", "3", "4"]], "skipped", "shredded"),
    ([["m", "v"], ["a", "x"], ["b", "y"]], "skipped", "no numeric column"),
    ([["m", "v"], *[["t", "text"]] * 6, *[["t", str(i)] for i in range(4)]], "merged", "merged"),
    ([["a", "b"], *[["ab", "12"]] * 4], "skipped", "1-2 characters"),
    ([["model", "score"], ["alpha", "12.5"], ["beta", "13.5"], ["Total", "26.0"]], "partial", "caveats"),
    ([["model", "score"], ["alpha", "12.5"], ["beta", "13.5"]], "ok", "cleanly"),
])
def test_gate(rows, status, part):
    v = gate.assess(rows)
    assert v.status == status and part in v.reason


def test_gate_repairs():
    assert gate.unfuse([["a", "1.5 2.5"], ["b", ""]]) == ([["a", "1.5"], ["b", "2.5"]], 1)
    assert gate.unfuse([["a", "1.5 2.5", "3 4"]]) == ([["a", "1.5", "3"], ["a", "2.5", "4"]], 2)
    assert not gate.fused("12 345 678") and gate.fused("29.13 35.25") and not gate.fused("12")
    assert gate.size_header(["m", "A", "B"], [["", "7B", "30B"], ["x", "1", "2"], ["y", "3", "4"]]) == (["m", "A 7B", "B 30B"], [["x", "1", "2"], ["y", "3", "4"]])
    assert gate.parameter_column("params", ["7B", "30B"]) and not gate.parameter_column("score", ["7B", "30B"])
    ok = gate.assess([["model", "score"], ["alpha", "12.5"], ["beta", "13.5"], ["gamma", "14.5"], ["delta", "15.5"]])
    merged = gate.Verdict("merged", "", ["t", "v"], [["x", "12.5"], ["y", "13.5"], ["z", "14.5"], ["w", "15.5"]])
    assert gate.select([ok, ok]) == [ok] and gate.select([merged], [ok]) == [ok] and gate.select([merged]) == [merged]
    assert gate.stacked_caption([["Table 3: x"]]) and gate.longest_run(["1", "", "2", "x", "3"]) == 2


def page(lines):
    return [text_layer.Word(w, 60.0 * i + (0 if i else 5), 60.0 * i + 30, 10.0 * n) for n, line in enumerate(lines) for i, w in enumerate(line.split())]


def test_text_layer(spark):
    lines = ["Table 1 x", "Name AA BB", "alpha 1.5 2", "beta 3 4", "gamma 5 6", "delta 7 8"]
    assert text_layer.recover(page(lines)) == ([[["Model", "AA", "BB"], ["alpha", "1.5", "2"], ["beta", "3", "4"], ["gamma", "5", "6"], ["delta", "7", "8"]]], [])
    assert text_layer.recover(page([*lines, "eps 9 10 11"]))[1][0].endswith("refused")
    assert text_layer.recover(page(lines[2:]))[1] == ["a numeric block has no header line with one label per column; refused"]
    assert text_layer.recover(page(lines[:4]))[0] == [] and text_layer.recover([]) == ([], [])
    words = spark.createDataFrame([("d", 1, w.text, w.x0, w.x1, w.top) for w in page([x.replace("AA", "accuracy") for x in lines])], "doc_id string, page int, text string, x0 double, x1 double, top double")
    rows = from_words(words).collect()
    assert {r["status"] for r in rows} <= {"ok", "partial"} and all(r["note"] is None for r in rows) and rows


def test_includes():
    files = {"main.tex": r"a \input{part/one} % \input{no}" "\n" r"\include{main} \input{../x} \input{gone}", "part/one.tex": r"b \input{two.tex}", "part/two.tex": "c"}
    body, taken, issues = latex.expand(files, "main.tex")
    assert body.split() == ["a", "b", "c"] and taken == ["main.tex", "part/one.tex", "part/two.tex"]
    assert issues == ["include cycle: main.tex", "outside the project: x.tex", "include that can't be read: gone.tex"]
    assert latex.expand(files, "main.tex", max_depth=1)[2][0].startswith("include depth") and "bytes" in latex.expand(files, "main.tex", max_bytes=3)[2][0]


def test_both_parsers_agree(spark):
    cells = ["0.91 (0.03) (x)", "0.91 (0.03)", "8×10^{-3}", r"8 \times 10^3", "1e3k", "2e5", "300K", "5m", "1,234.5", "45%", "--", "1_000", "-.5", "2.", "−3", "inf", "1e999", "1d", "", " 7 ", "3 [1]", "k"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r["x"] for r in df.select("c", parse_number(df["c"]).alias("x")).collect()]
    assert got == [infer.number(c) for c in cells]


def plain_interval(x, y, ranked):
    def rank(v):
        return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]

    def r(a, b):
        if len(set(a)) == 1 or len(set(b)) == 1:
            return None
        a, b = (rank(a), rank(b)) if ranked else (a, b)
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        return sum((p - ma) * (q - mb) for p, q in zip(a, b)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5

    g, out = random.Random(0), []
    for _ in range(2000):
        at = [g.randrange(len(x)) for _ in x]
        out.append(r([x[i] for i in at], [y[i] for i in at]))
    out = sorted(v for v in out if v is not None)
    return [round(out[int(0.025 * len(out)) - 1], 3), round(out[int(0.975 * len(out))], 3)]


def test_intervals():
    x, y = [1.0, 2, 3, 4, 5, 6, 7], [1.0, 3, 2, 5, 4, 7, 9]
    for ranked in (False, True):
        assert detectors.interval(np.array(x), np.array(y), ranked) == pytest.approx(plain_interval(x, y, ranked), abs=0.0011)
    assert detectors.interval(np.array(x[:3]), np.array(y[:3]), False) is None and detectors.interval(np.array(x), np.ones(7), False) is None


def test_whole_table(spark):
    rows = [("climb", i, float(x), None, None, v) for i, (x, v) in enumerate(zip(range(3, 13), [1.0, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5, 1.65, 500.0]))]
    rows += [("spike", i, None, None, None, v) for i, v in enumerate([1.0, 1.1, 1.2, 1.05, 1.15, 1.12, 50.0])]
    wide = [[88, 89, 90, 61], [87, 88, 91, 60], [89, 90, 90, 5], [88, 87, 89, 62], [89, 88, 90, 61]]
    rows += [("wide", 4 * i + j, None, f"r{i}", f"c{j}", float(v)) for i, r in enumerate(wide) for j, v in enumerate(r)]
    df = spark.createDataFrame(rows, "table_id string, row_id long, x double, row_key string, col_key string, value double")
    got = [(r["table_id"], r["value"], r["column_scale"]) for r in detectors.whole_table_outliers(df).where("flagged").collect()]
    assert ("spike", 50.0, False) in got and ("wide", 5.0, True) in got and not [g for g in got if g[0] == "climb"]


def test_bounded_runs(spark, tmp_path):
    tables = from_text(spark, {"a.csv": "x,error\n" + "\n".join(f"{i * 3},{i * i}" for i in range(12))})
    runs = bounded.run_bounded(tables, str(tmp_path), 60.0, only=["numeric_jump"])
    again = bounded.run_bounded(tables, str(tmp_path), 60.0, only=["numeric_jump"])
    assert [r.status for r in runs] == ["completed"] and [r.status for r in again] == ["reused"] and runs[0].flags.count() == again[0].flags.count()
    assert bounded.limited(spark, lambda: spark.range(10**12).selectExpr("sum(id % 7)").collect(), 0.5) == "timed_out"
    with pytest.raises(ValueError):
        bounded.run_bounded(tables, str(tmp_path), 0)
    assert {r["status"]: r["n"] for r in bounded.status_counts(bounded.run_records(spark, runs + again)).collect()} == {"completed": 1, "reused": 1}


def test_planted_anomalies_are_found(spark):
    r = random.Random(2)
    rows = [("t", "x", f"k{k}", float(x), str(x), 0, 100 + 3 * r.random()) for k in range(8) for x in range(20)]
    got = {x["kind"]: x for x in evaluate.recall(spark.createDataFrame(rows, "table_id string, axis string, fixed_key string, x double, x_lab string, row_id long, value double")).collect()}
    assert got["point_outlier"]["recall"] > 0.8 and got["level_shift"]["recall"] > 0.8 and all(v["series"] == 8 for v in got.values())
    assert got["level_shift"]["clean_rate"] < 0.3
    assert evaluate.paired_permutation([1, 1, 1, 1, 1, 1, 1, 1], [0] * 8) < 0.02 and evaluate.paired_permutation([1, 0], [0, 1]) > 0.5


def test_command_lines(spark, tmp_path, capsys):
    f = tmp_path / "t.csv"
    f.write_text("size,error\n" + "\n".join(f"{i * 2 + 5},{i * 1.5}" for i in range(10)))
    assert cli.main(["csv", str(f), "--json", "--caption", "--expect-flat", "size", "--html", str(tmp_path / "r.html")], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["metric"] == "error" and "increases" in out["caption"] and any("expected not to matter" in s for s in out["takeaway"])
    assert (tmp_path / "r.html").read_text().startswith("<!doctype html>")
    assert cli.main(["csv", str(f), "--metric", "nope"], spark) == 2 and cli.main(["csv", str(f), "--ignore", "nope"], spark) == 2
    assert cli.orders("a=x,y;b=z") == {"a": ["x", "y"], "b": ["z"]}
    (tmp_path / "p.tex").write_text(ARTICLE)
    assert cli.main(["article", str(tmp_path / "p.tex"), "--detector-seconds", "120", "--checkpoint-dir", str(tmp_path / "c")], spark) == 0
    assert "Detector runs:" in capsys.readouterr().out
