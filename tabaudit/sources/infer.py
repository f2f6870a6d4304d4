"""From a grid of text cells to tidy tables: which columns are axes, which the entity, which the metric.

Plain functions on one small grid; readers.py runs them over any number of files in parallel.
"""

from __future__ import annotations

import csv
import io
import math
import re
from dataclasses import dataclass, field
from functools import cached_property

from ..functions.numbers import CELL, HIGHER_PARTS, HIGHER_WORDS, LEXICONS, LOWER_WORDS, MAGNITUDES, METRIC_WORDS, MISSING

_CELL = re.compile(CELL)


def number(cell: str | None) -> float | None:
    """The finite number a cell prints, or None; as functions.numbers.parse_number reads it."""
    text = (cell or "").strip()
    if text.lower() in MISSING:
        return None
    m = _CELL.match(text.translate({ord(","): None, ord("%"): None, ord("−"): "-"}).strip())
    if m is None:
        return None
    digits, exponent, power, unit = m.groups()
    if exponent and (power or unit):
        return None
    value = float(f"{digits.replace('_', '')}{exponent or f'e{power or MAGNITUDES.get(unit, 0)}'}")
    return value if math.isfinite(value) else None


def level(cell: str) -> float | str:
    x = number(cell)
    return cell.strip() if x is None else x


def lower_is_better(metric: str) -> bool | None:
    if "↑" in metric or "↓" in metric:
        return "↑" not in metric
    low = metric.lower()
    found = set(re.findall("[a-z]+", low))
    if found & set(LOWER_WORDS):
        return True
    return False if any(p in low for p in HIGHER_PARTS) or found & set(HIGHER_WORDS) else None


def names_metric(header: str) -> bool:
    return any(w in header.lower() for w in METRIC_WORDS)


@dataclass
class Col:
    name: str
    cells: list[str]

    @cached_property
    def numbers(self) -> list[float]:
        return [x for x in map(number, self.cells) if x is not None]

    @cached_property
    def numeric(self) -> bool:
        filled = [c for c in self.cells if c.strip().lower() not in MISSING]
        return bool(filled) and len(self.numbers) >= 0.8 * len(filled)

    @cached_property
    def near_unique(self) -> bool:
        return len(set(self.cells)) >= 0.95 * len(self.cells)

    @cached_property
    def serial(self) -> bool:
        """Whole numbers that hardly repeat, never fall, and span at most twice their count."""
        x = self.numbers
        if not self.numeric or len(self.cells) < 3 or not self.near_unique or len(x) < 0.95 * len(self.cells):
            return False
        whole = [round(v) for v in x]
        return all(abs(v - w) <= 1e-9 for v, w in zip(x, whole, strict=True)) and all(a <= b for a, b in zip(whole, whole[1:], strict=False)) and whole[-1] - whole[0] <= 2 * len(whole)

    @cached_property
    def sweep(self) -> bool:
        """Hardly repeating numbers in one direction: a setting that was varied."""
        x = self.numbers
        steps = [b - a for a, b in zip(x, x[1:], strict=False)]
        return len(x) >= max(4, 0.95 * len(self.cells)) and len(set(x)) >= 0.9 * len(x) and (min(steps) >= 0 or max(steps) <= 0)

    @cached_property
    def scale(self) -> float | None:
        sizes = sorted(abs(v) for v in self.numbers if v)
        return sizes[len(sizes) // 2] if sizes else None

    def kind(self, orders: dict[str, list[str]]) -> tuple[str, list[str]]:
        """numeric, ordered_cat with its order, or unordered_cat."""
        if self.name in orders:
            return "ordered_cat", list(orders[self.name])
        if self.numeric:
            return "numeric", []
        present = {c.strip().lower(): c.strip() for c in self.cells if c.strip()}
        for lexicon in LEXICONS:
            if present and set(present) <= set(lexicon):
                return "ordered_cat", [present[w] for w in lexicon if w in present]
        return "unordered_cat", []


@dataclass
class Hints:
    metric: str | None = None
    entity: str | None = None
    lower_is_better: bool | None = None
    orders: dict[str, list[str]] = field(default_factory=dict)
    index: list[str] | None = None
    ignore: list[str] = field(default_factory=list)


@dataclass
class Tidy:
    name: str
    metric: str
    entity: str | None
    lower_is_better: bool
    axes: list[tuple[str, str, list[str]]]
    rows: list[tuple[dict[str, float | str], float | None, str]]


class Grid:
    """Columns by name; of equal names the last one counts."""

    def __init__(self, header: list[str], rows: list[list[str]]):
        self.n = len(rows)
        self.cols = {h: Col(h, [r[i] if i < len(r) else "" for r in rows]) for i, h in enumerate(header)}

    @property
    def numeric(self) -> list[Col]:
        return [c for c in self.cols.values() if c.numeric]

    @property
    def text(self) -> list[Col]:
        return [c for c in self.cols.values() if not c.numeric]

    def pick(self, names: list[str], rename: dict[str, str] | None = None) -> Grid:
        out = Grid([], [])
        out.n = self.n
        out.cols = {(rename or {}).get(h, h): Col((rename or {}).get(h, h), self.cols[h].cells) for h in names}
        return out


def parse_csv(text: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows: leading blank and '#' lines skipped, blank rows dropped."""
    lines = text.removeprefix("﻿").splitlines(keepends=True)
    start = next((i for i, x in enumerate(lines) if x.strip() and not x.lstrip().startswith("#")), None)
    if start is None:
        raise ValueError("no header row found")
    header, *rows = csv.reader(io.StringIO("".join(lines[start:])))
    return [h.strip() for h in header], [r for r in rows if any(c.strip() for c in r)]


def one_table(g: Grid, name: str, hints: Hints) -> Tidy:
    """The long form if a metric is named or hinted, else the wide form: a column an entity."""
    measures = [c for c in g.numeric if not c.serial]
    named = [h for h in g.cols if names_metric(h)]
    if hints.metric is None and len(measures) >= 2 and not named:
        keys = list(hints.index) if hints.index is not None else [c.name for c in g.text] or [next(iter(g.cols))]
        keys += [c.name for c in g.numeric if c.serial and c.name not in keys]
        entities = [c for c in g.numeric if c.name not in keys]
        if entities:
            rows = [({k: level(g.cols[k].cells[i]) for k in keys} | {"method": e.name}, number(e.cells[i]), e.cells[i]) for i in range(g.n) for e in entities]
            axes = [(k, *g.cols[k].kind(hints.orders)) for k in keys] + [("method", "unordered_cat", [])]
            return Tidy(name, "value", "method", hints.lower_is_better is not False, axes, rows)
    metric = hints.metric or (named[0] if named else None) or (measures or g.numeric or [Col("", [])])[-1].name
    if metric not in g.cols:
        raise ValueError(f"{name}: no numeric column, so there is nothing to check (columns: {', '.join(g.cols)})")
    axes = [c for c in g.cols.values() if c.name != metric]
    ignore = set(hints.ignore)
    if len(axes) > 1:
        # Beyond the first near-unique numeric axis, others are readings along it; with a serial axis, unique labels are its aliases.
        ignore |= {c.name for c in [c for c in axes if c.numeric and c.name != hints.entity and c.near_unique][1:]}
        if any(c.serial for c in axes if c.name not in ignore):
            ignore |= {c.name for c in axes if not c.numeric and c.name != hints.entity and c.near_unique}
    axes = [c for c in axes if c.name not in ignore]
    candidates = [c for c in axes if not c.numeric and c.kind(hints.orders)[0] != "ordered_cat"]
    entity = hints.entity or (max(candidates, key=lambda c: len(set(c.cells))).name if candidates else None)
    kinds = {c.name: c.kind(hints.orders) for c in axes}
    if entity in kinds and kinds[entity][0] != "ordered_cat":
        kinds[entity] = ("unordered_cat", [])
    cells = g.cols[metric].cells
    rows = [({c.name: level(c.cells[i]) for c in axes}, number(cells[i]), cells[i]) for i in range(g.n)]
    better = hints.lower_is_better if hints.lower_is_better is not None else lower_is_better(metric)
    return Tidy(name, metric, entity, better is not False, [(h, *k) for h, k in kinds.items()], rows)


def _side_by_side(g: Grid) -> dict[str, list[tuple[str, str]]] | None:
    """Several tables printed next to each other: all headers 'Group.Sub', with the same text and number columns in each group."""
    if len(g.cols) < 4 or not all("." in h for h in g.cols):
        return None
    groups: dict[str, list[tuple[str, str]]] = {}
    for h in g.cols:
        group, sub = h.rsplit(".", 1)
        groups.setdefault(group, []).append((sub, h))
    shapes = {tuple(s for s, _ in m) for m in groups.values()}
    mixed = all(len({g.cols[h].numeric for _, h in m}) == 2 for m in groups.values())
    return groups if len(groups) >= 2 and len(shapes) == 1 and mixed else None


def all_tables(g: Grid, name: str, hints: Hints | None = None) -> tuple[list[Tidy], list[str]]:
    """The tables of a grid, split so that each has one metric, and notes on what could not be read."""
    hints = hints or Hints()
    notes: list[str] = []
    if hints.metric is None:
        if groups := _side_by_side(g):
            out = []
            for group, members in groups.items():
                got, more = all_tables(g.pick([h for _, h in members], {h: s for s, h in members}), f"{name} [{group}]", hints)
                out, notes = out + got, notes + more
            return out, notes
        named = [c.name for c in g.numeric if names_metric(c.name) or set(c.name.lower().split("_")) & {"ratio", "count", "metric"}]
        measures = [c for c in g.numeric if not c.serial]
        scales = [c.scale for c in measures if c.scale]
        metrics = named if len(named) >= 2 else []
        if not metrics and len(measures) >= 2 and len(scales) >= 2 and max(scales) / min(scales) >= 10:
            metrics = [c.name for c in measures if not c.sweep]
        if len(metrics) >= 2:
            shared = [h for h in g.cols if h not in metrics]
            out = []
            for m in metrics:
                try:
                    out.append(one_table(g.pick([*shared, m]), f"{name} [{m}]", Hints(m, hints.entity, hints.lower_is_better, hints.orders, None, hints.ignore)))
                except ValueError as e:
                    notes.append(str(e))
            if out:
                return out, notes
    return [one_table(g, name, hints)], notes


_TASKS = re.compile(r"benchmark|dataset|data set|task|corpus|language", re.I)


def competitors(t: Tidy) -> str | None:
    """The axis whose levels compete within each combination of the others. In a wide table that is the one text axis of its rows, unless
    they are tasks; None where it is unclear."""
    names = [a for a, *_ in t.axes]
    if t.entity not in names:
        return None
    if (t.entity, t.metric) != ("method", "value"):
        return t.entity
    rows = [a for a, kind, _ in t.axes if a != t.entity and kind != "numeric"]
    if not rows:
        return t.entity
    return rows[0] if len(rows) == 1 and not _TASKS.search(rows[0]) else None
