"""Reading small tables and checking all of them at once."""

import io
import json
import zipfile

import pytest

from tabaudit.plans.analyze import analyze, not_checked
from tabaudit.sources import infer, latex, office
from tabaudit.sources.readers import from_text, read_tables, series


def grid(text):
    return infer.Grid(*infer.parse_csv(text))


JUMP = "p1,method,RMSE\n" + "\n".join(f"{p},{m},{v}" for m, vs in {"A": (1.6, 196, 209, 214), "B": (86, 20, 145, 136), "C": (48, 61, 72, 84)}.items() for p, v in zip((12, 15, 20, 25), vs, strict=True))
FLAT = "p1,method,error\n" + "\n".join(f"{p},{m},{v}" for m, vs in {"X": (12.34, 379.18, 379.18), "Z": (5, 5, 5)}.items() for p, v in zip((1, 2.5, 4), vs, strict=True))
SHIFT = "X,value\n" + "\n".join(f"{x * 2 + 7},{100 + (x % 3) if x < 10 else 200 + (x % 2)}" for x in range(20))
SPIKE = "X,value\n" + "\n".join(f"{x + 10},{15 if x == 5 else 1}" for x in range(12))
# Newcomb's 66 passage times of light.
SERIAL = "measurement,deviation\n" + "\n".join(f"{i + 1},{v}" for i, v in enumerate([28, 26, 33, 24, 34, -44, 27, 16, 40, -2, 29, 22, 24, 21, 25, 30, 23, 29, 31, 19, 24, 20, 36, 32, 36, 28, 25, 21, 28, 29, 37, 25, 28, 26, 30, 32, 36, 26, 30, 22, 36, 23, 27, 27, 28, 27, 31, 27, 26, 33, 26, 32, 32, 24, 39, 28, 24, 25, 32, 25, 29, 27, 28, 29, 16, 23]))


@pytest.mark.parametrize("cell, want", [("0.91 [0.88, 0.94]", 0.91), ("8×10^{-3}", 0.008), (r"8 \times 10^3", 8000.0), ("inf", None), ("1e999", None), ("300K", 300000.0), ("5m", None), ("1,234.5", 1234.5), ("45%", 45.0), ("--", None), ("1d", None)])
def test_number(cell, want):
    assert infer.number(cell) == want


def test_roles():
    t = infer.one_table(grid(JUMP), "t", infer.Hints())
    assert (t.metric, t.entity, t.lower_is_better) == ("RMSE", "method", True)
    assert [(a, k) for a, k, _ in t.axes] == [("p1", "numeric"), ("method", "unordered_cat")]
    wide = infer.one_table(grid("horizon,method_A,method_B\n" + "\n".join(f"{h},{h * 2.37},{h * 3.11}" for h in range(1, 7))), "w", infer.Hints())
    assert wide.entity == "method" and len(wide.rows) == 12
    low = infer.one_table(grid("tier,time\nlow,1\nhigh,3\nmedium,2\n"), "o", infer.Hints())
    assert low.axes[0] == ("tier", "ordered_cat", ["low", "medium", "high"])


def test_splits():
    many, _ = infer.all_tables(grid("model,accuracy,time_s,ratio\n" + "\n".join(f"m{i},{0.9 + i / 100},{i * 10},{i}" for i in range(6))), "t")
    assert [t.metric for t in many] == ["accuracy", "time_s", "ratio"]
    side, _ = infer.all_tables(grid("Gender.Descriptor,Gender.%Doc,Religion.Descriptor,Religion.%Doc\nhe,50%,A,1%\nshe,40%,B,2%\nthey,10%,C,3%"), "t")
    assert [len(t.rows) for t in side] == [3, 3]
    same, _ = infer.all_tables(grid("horizon,method_A,method_B\n" + "\n".join(f"{h},{h * 2.37},{h * 3.11}" for h in range(1, 7))), "t")
    assert len(same) == 1


def test_comments_only_before_the_header():
    header, rows = infer.parse_csv("\n# a\n# b\na,b\n#1,2\n,\n3,4\n")
    assert header == ["a", "b"] and rows == [["#1", "2"], ["3", "4"]]
    with pytest.raises(ValueError):
        infer.parse_csv("# only\n\n")


def test_analyze(spark):
    tables = from_text(spark, {"jump.csv": JUMP, "flat.csv": FLAT, "shift.csv": SHIFT, "spike.csv": SPIKE, "serial.csv": SERIAL, "none.csv": "a,b\nx,y\n"})
    flags = analyze(tables).collect()
    found = {(f["table_id"].split("#")[0], f["type"]) for f in flags}
    assert {("jump.csv", "numeric_jump"), ("jump.csv", "win_reversal"), ("flat.csv", "flatness"), ("flat.csv", "duplicate"), ("shift.csv", "level_shift"), ("spike.csv", "point_outlier"), ("serial.csv", "point_outlier")} <= found
    assert not {("serial.csv", "numeric_jump"), ("serial.csv", "level_shift")} & found
    at = sorted(json.loads(f["detail"])["value"] for f in flags if f["table_id"].startswith("serial") and f["type"] == "point_outlier")
    assert at == [-44.0, -2.0]
    assert [r["table_id"] for r in not_checked(tables).collect()] == ["none.csv#note0"] or not_checked(tables).count() == 1


def test_many_axes_are_reported_not_checked(spark):
    text = ",".join(f"a{i}" for i in range(10)) + ",value\n" + "\n".join(",".join(f"l{r}{i}" for i in range(10)) + f",{r}" for r in range(12))
    tables = from_text(spark, {"wide.csv": text})
    assert analyze(tables).count() == 0 and not_checked(tables).count() == 1


def test_files_are_read_in_parallel(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"t{i}.csv").write_text(JUMP)
    (tmp_path / "bad.pdf").write_bytes(b"%PDF")
    t = read_tables(spark, str(tmp_path))
    assert t.where("note is null").count() == 5 and t.where("note is not null").count() == 1
    assert series(t).where("axis = 'p1'").count() == 60


def test_latex():
    body = r"""\caption{Old}\end{table}\begin{table}\caption{RMSE by horizon % no
}\begin{tabular}{l|cc} \toprule Model & \multicolumn{2}{c}{Error} \\ & one & two \\ \midrule
\multirow{2}{*}{\textbf{A}} & 1.5 $\pm$ 0.1 & 2 \\ & 3 & X\&Y \\ \end{tabular}\end{table} t(38) = 2.10, p = .03"""
    tables, text = latex.grids("a.tex", body.encode())
    ((caption, header, rows),) = list(tables)
    assert caption.startswith("RMSE by horizon") and header == ["Model", "Error / one", "Error / two"]
    assert rows == [["A", "1.5", "2"], ["A", "3", "X&Y"]] and "t(38)" in text
    with pytest.raises(ValueError):
        latex.grid(r"a & b \\ c \\")


def test_office():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>x</t></si><si><t>value</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>3.0</v></c></row></sheetData></worksheet>')
    ((name, header, rows),) = list(office.xlsx_grids("a.xlsx", b.getvalue())[0])
    assert (name, header, rows) == ("a.xlsx S", ["x", "value"], [["1", "3"]])
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://w"><w:p><w:t>z = 1.96, p = .05</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc><w:tc><w:p><w:t>2</w:t></w:p></w:tc></w:tr></w:tbl></w:document>')
    tables, text = office.docx_grids("a.docx", b.getvalue())
    assert [(h, r) for _, h, r in tables] == [(["a", "b"], [["1", "2"]])] and "p = .05" in text
    assert office.headed(["a", "", "a"]) == ["a", "col1", "a_1"]
