"""Whether a grid of cells is a results table that can be checked: ordered rules, repairs, and what is left out.

A rule looks at measures of the grid and gives a reason, or nothing; the first reason decides. Grids of formats that store cells
(LaTeX, Word, Excel) skip the rules that look for figures read as tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from .infer import number

# Labels of submission forms, of rows that sum up others, and of model sizes.
FORM_LABELS = (
    "manuscript number", "article type", "keywords", "corresponding author", "order of authors", "abstract", "--manuscript draft--",
    "submission", "cover letter", "funding information", "classifications", "suggested reviewers", "opposed reviewers",
)
TOTALS = {"total", "sum", "grand total"}
_PART = r"-?\d+(?:\.\d*)?[%MB]?"
_FUSED = re.compile(rf"\s*{_PART}(?:\s+{_PART})+\s*")
_SPACED = re.compile(r"\s*\d{1,3}(?:\s\d{3})+\s*")
_SIZE = re.compile(r"\d+(?:\.\d+)?\s?[kKMB]")
_PARAMETERS = re.compile(r"\s*\d[\d.,]*\s*[MB]\s*")
_CAPTION = re.compile(r"\s*(?:Table|Tab|le)\s*\d+\s*[:.]")
_SPLIT_METRIC = re.compile(r"(?:[a-z]\s*)?\((?:ms|s|%|kg|g)\)", re.I)
_BROKEN_CAPTION = re.compile(r"(?:table|able|fig|figure|ig|igure)\b.*\d|(?:table|figure)\s*\d", re.I)


def squeeze(cell: str | None) -> str:
    return " ".join((cell or "").split())


def share(cells: list[str]) -> float:
    """The share of cells with something in them that are numbers."""
    filled = [c for c in cells if c]
    return sum(number(c) is not None for c in filled) / len(filled) if filled else 0.0


def longest_run(cells: list[str]) -> int:
    """The most numbers one below the other; blanks don't count."""
    marks = "".join("n" if number(c) is not None else "t" for c in cells if c)
    return max(map(len, marks.split("t")), default=0)


def fused(cell: str) -> bool:
    """Two numbers or more in one cell, which aren't thousands set apart."""
    return bool(_FUSED.fullmatch(cell)) and not _SPACED.fullmatch(cell)


def sentence(cell: str) -> bool:
    words = cell.split()
    prose = len(cell) >= 50 and len(words) >= 7 and sum(map(str.isalpha, cell)) >= 0.6 * len(cell)
    return prose and (len(words) >= 10 or bool(re.search(r"[.!?](\s|$)", cell)))


def stacked_caption(rows: list[list[str]]) -> bool:
    """Whether a caption stands inside the body, so that several tables were read as one."""
    return any(_CAPTION.match(c) for r in rows for c in r)


def non_table(rows: list[list[str]]) -> bool:
    """A form, or prose in the shape of a table."""
    cells = [c for r in rows for c in r if c]
    text = " ".join(cells).lower()
    if not cells or sum(label in text for label in FORM_LABELS) >= 2:
        return True
    filled = [n for r in rows if (n := sum(map(bool, r)))]
    wordy = sum(number(c) is not None for c in cells) <= 0.05 * len(cells) and len(filled) >= 3
    return wordy and sum(n <= 2 for n in filled) >= 0.8 * len(filled) and sum(map(sentence, cells)) >= max(2, 0.6 * len(cells))


def labels(row: list[str]) -> bool:
    """Whether a row can be a header: at most four of ten cells are numbers."""
    filled = [c for c in row if c]
    return bool(filled) and 10 * sum(number(c) is not None for c in filled) <= 4 * len(filled)


def parameter_column(metric: str | None, raw: list[str]) -> bool:
    """Whether a metric is a list of model sizes, of which the largest always stands out."""
    name = (metric or "").lower()
    named = "param" in name or re.fullmatch(r"col\d+", name.rpartition(".")[2])
    return bool(named) and len(raw) >= 2 and all(_PARAMETERS.fullmatch(r) for r in raw)


def size_header(header: list[str], body: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """A first row without a label that holds only sizes belongs to the header, if plain numbers stand below."""
    if len(body) < 3 or not body[0] or body[0][0]:
        return header, body
    at = [i for i, c in enumerate(body[0]) if c]
    below = [r[i] for r in body[1:] for i in at if r[i]]
    sizes = len(at) >= 2 and all(_SIZE.fullmatch(body[0][i]) for i in at)
    if not sizes or not below or 5 * sum(bool(_SIZE.fullmatch(c)) for c in below) > len(below):
        return header, body
    return [" ".join(filter(None, (h, body[0][i] if i in at else ""))) for i, h in enumerate(header)], body[1:]


def unfuse(body: list[list[str]]) -> tuple[list[list[str]], int]:
    """Pairs of numbers in one cell go apart: into the blank cell below or above, or, where all numbers of a row are pairs, into two rows."""
    rows, n = [list(r) for r in body], 0
    pair = lambda c: fused(c) and len(c.split()) == 2
    for i, row in enumerate(rows):
        for j, cell in enumerate(row):
            blank = next((k for k in (i + 1, i - 1) if 0 <= k < len(rows) and not rows[k][j]), None) if pair(cell) else None
            if blank is not None:
                upper, lower = cell.split()
                rows[min(i, blank)][j], rows[max(i, blank)][j] = upper, lower
                n += 1
    out = []
    for row in rows:
        numbers = [c for c in row if fused(c) or number(c) is not None]
        if numbers and all(map(pair, numbers)):
            out += [[c.split()[k] if pair(c) else c for c in row] for k in (0, 1)]
            n += len(numbers)
        else:
            out.append(row)
    return out, n


@dataclass
class Shape:
    """A grid's measures."""

    rows: list[list[str]]
    structured: bool
    header: list[str] = field(default_factory=list)
    body: list[list[str]] = field(default_factory=list)

    @cached_property
    def width(self) -> int:
        """The most frequent width, the first seen of equals."""
        return Counter(map(len, self.rows)).most_common(1)[0][0]

    @cached_property
    def columns(self) -> list[list[str]]:
        return [list(c) for c in zip(*self.body, strict=True)]

    @cached_property
    def numeric(self) -> int:
        return sum(share(c) >= 0.6 for c in self.columns)

    @cached_property
    def cells(self) -> list[str]:
        return [c for r in self.body for c in r if c]

    @property
    def fill(self) -> float:
        return len(self.cells) / (len(self.body) * self.width)

    @property
    def tiny(self) -> float:
        return sum(len(c) <= 2 for c in self.cells) / len(self.cells) if self.cells else 1.0

    @property
    def lone(self) -> float:
        filled = [n for r in self.body if (n := sum(map(bool, r)))]
        return filled.count(1) / max(1, len(filled))


def _broken(s: Shape) -> bool:
    named = [c for c in s.header if c]
    return not labels(s.header) or (len(named) >= 3 and bool(_BROKEN_CAPTION.match(named[0])))


Rule = tuple[str, Callable[[Shape], bool], Callable[[Shape], str]]
#: Status, rule and reason, in order, once there is a header.
RULES: list[Rule] = [
    ("skipped", lambda s: any(_SPLIT_METRIC.match(c) for c in s.header), lambda s: "extraction failure: metric header split across columns; coordinates unverified"),
    ("skipped", _broken, lambda s: "extraction failure: unidentified or shredded original header; coordinates unverified"),
    ("merged", lambda s: not s.numeric and any(longest_run(c) >= 4 for c in s.columns), lambda s: "a results table was detected but it is merged with surrounding text"),
    ("skipped", lambda s: not s.numeric, lambda s: "no numeric column found; nothing to check for value anomalies"),
    ("skipped", lambda s: s.width > 12 and s.numeric < 0.3 * s.width, lambda s: f"only {s.numeric} of {s.width} columns are numeric; looks like a figure or text, not a results table"),
    ("skipped", lambda s: not s.structured and s.tiny > 0.6, lambda s: f"{s.tiny:.0%} of cells are 1-2 characters; looks like a figure or text rather than a results table"),
    ("skipped", lambda s: not s.structured and s.fill < 0.5 and s.lone >= 0.25, lambda s: f"looks like a chart read as a table ({s.fill:.0%} filled, {s.lone:.0%} of rows hold a single value)"),
    ("skipped", lambda s: not s.structured and s.fill < 0.4, lambda s: f"only {s.fill:.0%} of the grid is filled; too sparse to be a reliable results table"),
    ("skipped", lambda s: share(s.cells) < 0.2, lambda s: f"only {share(s.cells):.0%} of cells are numeric; not enough numeric content to check for value anomalies"),
]


@dataclass
class Verdict:
    """status: ok, partial (with caveats), merged, skipped or non_table. `body` has the total rows, `checked` is without them."""

    status: str
    reason: str
    header: list[str] = field(default_factory=list)
    body: list[list[str]] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)

    @property
    def checked(self) -> list[list[str]]:
        return [r for r in self.body if not r or r[0].lower() not in TOTALS]


def assess(grid: list[list[str]], structured: bool = False) -> Verdict:
    """The verdict on a grid whose first row is its header."""
    from .office import headed

    rows = [r for r in ([squeeze(c) for c in r] for r in grid) if any(r)]
    wide = max(map(len, rows), default=0)
    if len(rows) < 3 or wide < 2:
        return Verdict("skipped", f"too small to analyze ({len(rows)}x{wide}); need >=3 rows and >=2 columns")
    if non_table(rows):
        return Verdict("non_table", "not a results table (metadata/cover sheet or prose); skipped")
    s = Shape(rows, structured)
    uneven = sum(len(r) != s.width for r in rows)
    fitted = [(r + [""] * s.width)[: s.width] for r in rows]
    s.header, s.body = size_header(fitted[0], fitted[1:])
    for status, rule, reason in RULES:
        if rule(s):
            return Verdict(status, reason(s), headed(s.header), s.body)
    body, split = unfuse(s.body)
    v = Verdict("ok", "", headed(s.header), body)
    if uneven:
        v.caveats.append(f"{uneven} row(s) had an irregular column count and were padded/truncated to width {s.width}")
    if split:
        v.caveats.append(f"{split} cell(s) holding two rows' numbers were split back into their rows")
    if left_out := len(v.body) - len(v.checked):
        v.caveats.append(f"{left_out} total row(s) left out of the checks")
    if any(fused(c) for r in body for c in r):
        return Verdict("skipped", "cells still hold two numbers, so rows are misaligned", v.header, body, v.caveats)
    v.status, v.reason = ("partial", "parsed with caveats") if v.caveats else ("ok", "parsed cleanly")
    return v


def numbers_in(rows: list[list[str]]) -> Counter[float]:
    """How often each number stands in a body."""
    return Counter(x for r in rows for c in r if (x := number(squeeze(c))) is not None)


def shared_numbers(a: list[list[str]], b: list[list[str]]) -> int:
    return (numbers_in(a) & numbers_in(b)).total()


def covered(rows: list[list[str]], others: list[list[list[str]]], part: float = 0.8) -> bool:
    """Whether other bodies together hold most of a body's numbers, so that it can be replaced by them."""
    own, there = numbers_in(rows), sum(map(numbers_in, others), Counter())
    return bool(own) and bool(others) and (own & there).total() >= part * own.total()


def select(candidates: list[Verdict], isolated: list[Verdict] | None = None) -> list[Verdict]:
    """Of several readings of a page's tables those to keep: usable ones first, equal ones once, and merged stand-ins replaced by the
    tables that `isolated` recovered from them (4 shared numbers) once those cover them."""
    usable = [v for v in candidates if v.status in ("ok", "partial")]
    out, seen = [], set()
    for v in [*usable, *(v for v in candidates if v.status not in ("ok", "partial"))]:
        signature = (tuple(v.header), tuple(map(tuple, v.body)))
        if signature in seen or (v not in usable and v.status != "merged" and any(shared_numbers(v.body, u.body) >= 4 for u in usable)):
            continue
        seen.add(signature)
        parts = [w for w in isolated or [] if w.status in ("ok", "partial") and shared_numbers(w.body, v.body) >= 4]
        if v.status == "merged" and covered(v.body, [w.body for w in parts]):
            out += [w for w in parts if (tuple(w.header), tuple(map(tuple, w.body))) not in seen and not seen.add((tuple(w.header), tuple(map(tuple, w.body))))]
        else:
            out.append(v)
    return out
