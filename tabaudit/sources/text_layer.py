"""Tables from the words of a page: runs of lines that end in equally many numbers, under a line with one label per column.

What isn't certain is refused with a note: nothing is guessed. words() of a page are rows (text, x0, x1, top).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby
from statistics import median_high

import pandas as pd
from pyspark.sql import DataFrame

# How near lines' tops are, how far a label may be off its column, and how few rows make a table.
NEAR, OFF, ROWS = 2.5, 0.45, 4
_NUMBER = re.compile(r"-?\d+(\.\d+)?")
_SIZE = re.compile(r"\d+(\.\d+)?[MBK]")
_HEADING = re.compile(r"(table|figure|fig\.)\s*\d+", re.I)


@dataclass(frozen=True)
class Word:
    text: str
    x0: float
    x1: float
    top: float

    @property
    def centre(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def number(self) -> bool:
        return bool(_NUMBER.fullmatch(self.text))


class Line:
    def __init__(self, words: list[Word]):
        self.words = sorted(words, key=lambda w: w.x0)
        self.k = next((n for n, w in enumerate(reversed(self.words)) if not w.number), len(self.words))

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)

    @property
    def label(self) -> list[str]:
        return [w.text for w in self.words[: len(self.words) - self.k]]

    @property
    def data(self) -> bool:
        """A label with two numbers or more behind it."""
        return self.k >= 2 and bool(self.label)

    @property
    def plain(self) -> bool:
        return not any(w.number for w in self.words)


def lines(words: list[Word]) -> list[Line]:
    """Words whose top is near that of the first word of the line."""
    out: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (w.top, w.x0)):
        if out and abs(out[-1][0].top - w.top) <= NEAR:
            out[-1].append(w)
        else:
            out.append([w])
    return [Line(ws) for ws in out]


def _header(block: list[Line], run: list[int]) -> int | None:
    """The nearest line above a run whose last words stand over its columns."""
    k = block[run[0]].k
    centres = [median_high([block[i].words[c - k].centre for i in run]) for c in range(k)]
    pitch = min(b - a for a, b in zip(centres, centres[1:], strict=False))
    for j in range(run[0] - 1, -1, -1):
        if not block[j].plain:
            return None
        over = block[j].words[-k:]
        if pitch > 0 and len(block[j].words) in (k, k + 1) and all(abs(w.centre - c) <= OFF * pitch for w, c in zip(over, centres, strict=True)):
            return j
    return None


def _names(block: list[Line], at: int, k: int) -> list[str]:
    """Labels of the columns; repeated ones belong to groups, which are named by the words above them."""
    own = block[at].words[-k:]
    names = [w.text for w in own]
    if len(set(names)) == k:
        return names
    period = names.index(names[0], 1) if names[0] in names[1:] else k
    middle = [sum(w.centre for w in own[g : g + period]) / len(own[g : g + period]) for g in range(0, k, period)]
    above: list[list[str]] = [[] for _ in middle]
    for line in block[max(0, at - 4) : at]:
        for w in line.words if len(line.words) >= 2 else []:
            if not w.number:
                above[min(range(len(middle)), key=lambda g: abs(middle[g] - w.centre))].append(w.text)
    return [f"{' '.join(above[c // period]) or f'group{c // period + 1}'} {name}" for c, name in enumerate(names)]


def _rows(block: list[Line], run: list[int], at: int) -> list[list[str]] | None:
    """Labels with numbers; a label that comes again gets the last size or section before it. None if they aren't told apart even so."""
    out: dict[str, list[str]] = {}
    size = ""
    for i in run:
        parts = block[i].label
        size = parts[0] if _SIZE.fullmatch(parts[0]) else size
        label = " ".join(parts)
        if label in out:
            section = next((block[j].text[:12] for j in range(i - 1, at, -1) if block[j].plain), "")
            label = f"{label} [{size or section}]"
        if label in out:
            return None
        out[label] = [w.text for w in block[i].words[-block[i].k :]]
    return [[label, *numbers] for label, numbers in out.items()]


def recover(words: list[Word]) -> tuple[list[list[list[str]]], list[str]]:
    """Tables (a header row, then data rows) and notes of one page."""
    blocks: list[list[Line]] = [[]]
    for line in lines(words):
        if _HEADING.match(line.text):
            blocks.append([])
        else:
            blocks[-1].append(line)
    tables, notes = [], []
    for block in blocks:
        data = [i for i, line in enumerate(block) if line.data]
        runs = [list(g) for _, g in groupby(data, key=lambda i: block[i].k)]
        for a, run in enumerate(runs):
            if len(run) < ROWS:
                if any(len(r) >= ROWS for r in runs[max(0, a - 1) : a + 2]):
                    return [], ["a line next to a table carries a different number of values than the table's rows; refused"]
                notes.append(f"{len(run)} line(s) with {block[run[0]].k} numbers not tabulated")
        for run in runs:
            if len(run) < ROWS:
                continue
            at = _header(block, run)
            rows = None if at is None else _rows(block, run, at)
            if at is None:
                notes.append("a numeric block has no header line with one label per column; refused")
            elif rows is None:
                notes.append("row labels are not unique; refused")
            else:
                tables.append([["Model", *_names(block, at, block[run[0]].k)], *rows])
    return tables, notes


def recover_tables(words: DataFrame) -> DataFrame:
    """(doc_id, page, number, grid, note) of pages of words (doc_id, page, text, x0, x1, top); a page is a group, small by nature."""

    def page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables, notes = recover([Word(*r) for r in pdf[["text", "x0", "x1", "top"]].itertuples(index=False)])
        rows = [(*key, i, t, None) for i, t in enumerate(tables)] + [(*key, None, None, n) for n in notes]
        return pd.DataFrame(rows, columns=["doc_id", "page", "number", "grid", "note"]).astype({"number": "Int32"})

    return words.where("text is not null").groupBy("doc_id", "page").applyInPandas(page, "doc_id string, page int, number int, grid array<array<string>>, note string")

