"""Tables of Word and Excel files, from their zipped XML alone."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

Grids = Iterator[tuple[str, list[str], list[list[str]]]]


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e, *names: str):
    return (x for x in e.iter() if _tag(x) in names)


def trim(grid: list[list[str]]) -> list[list[str]]:
    """Without blank rows and without blank columns at either side."""
    rows = [r for r in grid if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    used = [i for i in range(width) if any(r[i].strip() for r in rows)]
    return [r[used[0] : used[-1] + 1] for r in rows] if used else []


def headed(header: list[str]) -> list[str]:
    """Names for blank headers, and numbers behind repeated ones."""
    out: list[str] = []
    for i, h in enumerate(header):
        name = h.strip() or f"col{i}"
        k = 0
        while (name if not k else f"{name}_{k}") in out:
            k += 1
        out.append(name if not k else f"{name}_{k}")
    return out


def cell_text(x: str) -> str:
    """A whole number without its '.0'."""
    return x[:-2] if x.endswith(".0") and x[:-2].lstrip("-").isdigit() else x


def docx_grids(name: str, body: bytes) -> tuple[Grids, str]:
    """All tables, spanned cells repeated; the paragraphs are the text."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text_of = lambda e: "".join(t.text or "" for t in _find(e, "t"))
    tables = []
    for k, table in enumerate(_find(root, "tbl")):
        grid = []
        for row in (r for r in table if _tag(r) == "tr"):
            cells: list[str] = []
            for cell in (c for c in row if _tag(c) == "tc"):
                span = next((int(next(iter(s.attrib.values()))) for s in _find(cell, "gridSpan")), 1)
                text = "\n".join(text_of(p) for p in _find(cell, "p")).strip()
                if any(_tag(m) == "vMerge" and "restart" not in m.attrib.values() for m in cell.iter()) and grid and len(cells) < len(grid[-1]):
                    text = grid[-1][len(cells)]
                cells += [text] * span
            grid.append(cells)
        if grid := trim(grid):
            tables.append((f"{name} table {k + 1}", headed(grid[0]), grid[1:]))
    return iter(tables), "\n".join(text_of(p) for p in _find(root, "p"))


def xlsx_grids(name: str, body: bytes) -> tuple[Grids, str]:
    """Each sheet that isn't empty, with the values that formulas had when it was saved."""
    tables = []
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in _find(si, "t")) for si in _find(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _find(book, "sheet"):
            target = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            path = rels[target].lstrip("/")
            root = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            grid: list[list[str]] = []
            for row in _find(root, "row"):
                cells: list[str] = []
                for c in (c for c in row if _tag(c) == "c"):
                    letters = "".join(ch for ch in c.attrib.get("r", "") if ch.isalpha())
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = next((x.text or "" for x in _find(c, "v")), "")
                    kind = c.attrib.get("t")
                    cells.append(shared[int(v)] if kind == "s" and v else "".join(t.text or "" for t in _find(c, "t")) if kind == "inlineStr" else cell_text(v))
                grid.append(cells)
            if grid := trim(grid):
                tables.append((f"{name} {sheet.attrib.get('name', '')}".strip(), headed(grid[0]), grid[1:]))
    return iter(tables), ""
