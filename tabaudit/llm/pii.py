"""PII: keyed, format-preserving pseudonyms for validated numbers, dates, addresses and secrets.

Every value that a pattern finds and its validation accepts is replaced by another value of the same format: a keyed Feistel
network permutes the set of all values with that pattern of digits, small and capital letters, so equal values stay equal in
all documents, different ones stay different, and only the key's holder can go back. Separators, prefixes and lengths stay.

  card      13 to 19 digits that pass the Luhn test; the last digit is computed anew, so pseudonyms pass it too
  iban      passes modulo 97; its two check digits are computed anew
  phone     '+' and 8 to 15 digits, or ten digits in the groups 3-3-4; the country code stays
  ssn       ddd-dd-dddd with an area, group and serial that are issued
  ip        four octets of 0 to 255, all or none padded to three digits; permuted as a 32-bit number
  date      a calendar date, as yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy or, if that is none, mm/dd/yyyy; permuted among the days of 1900 to 2099
  email     the part before the '@' and the host's labels but for the last
  secret    access keys, and values after 'password', 'token', 'secret' or 'api key' with '=' or ':'

Cards of one repeated digit, dates outside 1900 to 2099 and octets padded in part are no findings. A card or IBAN that isn't valid with all its groups is tried without the last ones, and the search goes on after its first group.

Defined results: null stays null; a text without findings is returned as it is; every row is kept, repeated ones each; an
empty table gives no rows; other columns pass through unread in pseudonymise().
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import trimmed

ROUNDS = 10
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "secret")
#: Only texts with a digit or an '@' can hold a finding; secrets have one digit at least.
TRIGGER = r"[0-9@]"
_TRIGGER = re.compile(TRIGGER)

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w]))
  | (?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
     | (?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])
     | (?<=password=)[^\s"']{6,128} | (?<=token=)[^\s"']{6,128} | (?<=secret=)[^\s"']{6,128}
     | (?<=password[ ]=[ ]")[^\s"]{6,128} | (?<=token[ ]=[ ]")[^\s"]{6,128} | (?<=secret[ ]=[ ]")[^\s"]{6,128}
     | (?<=api_key[ ]=[ ]")[^\s"]{6,128} | (?<=api_key=)[^\s"']{6,128}
     | (?<=password:[ ])[^\s"']{6,128} | (?<=token:[ ])[^\s"']{6,128})
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))
  | (?P<date>(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d(?P<sep>[./])\d\d(?P=sep)(?:19|20)\d\d)(?![\d./-]*\d))
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d))
  | (?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)
     | (?<![\d(+])(?:\(\d{3}\)[ ]?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d))
  | (?P<card>(?<![\d])\d(?:[ -]?\d){12,18}(?!\d))
    """,
    re.VERBOSE | re.ASCII,
)


class Cipher:
    """A Feistel network on mixed-radix numbers, keyed with BLAKE2b."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, tweak: bytes, i: int, x: int) -> int:
        h = blake2b(b"%b|%d|%d" % (tweak, i, x), key=self.key, digest_size=32)
        return int.from_bytes(h.digest(), "big")

    def permute(self, x: int, left: int, right: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0 .. left * right - 1; the halves take turns in being shifted by a function of the other."""
        a, b = divmod(x, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._f(tweak, i, a)) % right
            else:
                a = (a + sign * self._f(tweak, i, b)) % left
        return a * right + b

    def number(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0 .. size - 1: one of the next larger square, walked until it falls inside."""
        side = max(2, int(size**0.5) + 1)
        while True:
            x = self.permute(x, side, side, tweak, back)
            if x < size:
                return x

    def text(self, s: str, kind: str, back: bool = False) -> str:
        """Permutes the digits and ASCII letters of s, each within its class; all else stays."""
        slots = [(i, base, n) for i, ch in enumerate(s) for base, n in (("0", 10), ("a", 26), ("A", 26)) if base <= ch <= chr(ord(base) + n - 1)]
        if not slots:
            return s
        shape = "".join(base for _, base, _ in slots)
        half = (len(slots) + 1) // 2
        left, right = (prod(n for *_, n in part) for part in (slots[:half], slots[half:]))
        x = 0
        for i, base, n in slots:
            x = x * n + ord(s[i]) - ord(base)
        x = self.permute(x, left, right, f"{kind}:{shape}".encode(), back)
        out = list(s)
        for i, base, n in reversed(slots):
            x, d = divmod(x, n)
            out[i] = chr(ord(base) + d)
        return "".join(out)


def luhn(digits: str) -> int:
    """0 if the number passes."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_remainder(compact: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in compact[4:] + compact[:4])) % 97


def _refill(model: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if ch.isalnum() else ch for ch in model)


_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _day(s: str, form: str) -> int | None:
    try:
        return datetime.datetime.strptime(s, form).date().toordinal() - _EPOCH
    except ValueError:
        return None


def replacement(kind: str, s: str, cipher: Cipher, back: bool = False) -> str | None:
    """The pseudonym of a finding, or None if it isn't valid. `back` gives the original of a pseudonym."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = cipher.text(digits[:-1], kind, back)
        return _refill(s, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        compact = s.replace(" ", "")
        if not 15 <= len(compact) <= 34 or iban_remainder(compact) != 1:
            return None
        rest = cipher.text(compact[4:], kind + compact[:2], back)
        return _refill(s, compact[:2] + f"{98 - iban_remainder(compact[:2] + '00' + rest):02d}" + rest)
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        keep = m.end() if (m := re.match(r"\+\d{1,3}(?=\D)|\+\d", s)) else 0
        return s[:keep] + cipher.text(s[keep:], kind, back)
    if kind == "ssn":
        if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = (areas.index(int(s[:3])) * 99 + int(s[4:6]) - 1) * 9999 + int(s[7:]) - 1
        x, serial = divmod(cipher.number(x, len(areas) * 99 * 9999, b"ssn", back), 9999)
        return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        parts = s.split(".")
        octets = [int(o) for o in parts]
        # Octets with leading zeros are a format of their own if all have three digits, and no address else.
        padded = any(len(o) > 1 and o[0] == "0" for o in parts)
        if max(octets) > 255 or (padded and {len(o) for o in parts} != {3}):
            return None
        new = bytes(octets)
        while new == bytes(octets) or (padded and min(new) > 99):
            # A padded address stays one that shows it, so that it goes back.
            new = cipher.permute(int.from_bytes(new, "big"), 1 << 16, 1 << 16, b"ip", back).to_bytes(4, "big")
            if new == bytes(octets):
                break
        return ".".join(f"{o:03d}" if padded else str(o) for o in new)
    if kind == "date":
        form = "%Y-%m-%d" if s[4] == "-" else f"%d{s[2]}%m{s[2]}%Y"
        day_first = _day(s, form)
        if day_first is None and s[2] == "/" and (day := _day(s, "%m/%d/%Y")) is not None:
            # Only days that can't be read day first, so that pseudonyms go back.
            new = s
            while _day(new, form) is not None or new == s:
                day = cipher.number(day, _DAYS, b"date", back)
                new = datetime.date.fromordinal(_EPOCH + day).strftime("%m/%d/%Y")
                if new == s:
                    break
            return new
        if day_first is None:
            return None
        day = day_first
        return datetime.date.fromordinal(_EPOCH + cipher.number(day, _DAYS, b"date", back)).strftime(form)
    if kind == "email":
        name, host = s.split("@")
        labels, _, last = host.rpartition(".")
        return f"{cipher.text(name, 'name', back)}@{cipher.text(labels, 'host', back)}.{last}"
    keep = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|", s).end()
    if not any(ch.isdigit() for ch in s) and keep == 0:
        return None
    return s[:keep] + cipher.text(s[keep:], kind, back)


def _prefixes(kind: str, s: str) -> list[str]:
    """A card or IBAN with all its groups, and without the last ones."""
    ends = [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] in " -")]
    return [s[:e] for e in ends if kind != "card" or 13 <= sum(ch.isdigit() for ch in s[:e]) <= 19]


def _grouped(kind: str, s: str, cipher: Cipher, back: bool) -> tuple[str, str] | None:
    """The longest valid prefix and its pseudonym: one with which no longer prefix is valid, so that it goes back."""
    tried = _prefixes(kind, s)
    for k, p in enumerate(tried):
        new = replacement(kind, p, cipher, back)
        if new is not None:
            while any(replacement(kind, new + longer[len(p) :], cipher) is not None for longer in tried[:k]):
                new = replacement(kind, new, cipher, back)
            return p, new
    return None


def pseudonymise_text(text: str, cipher: Cipher, found: dict[str, int], back: bool = False) -> str:
    def searched(line: str) -> str:
        out, done, at = [], 0, 0
        while m := PATTERN.search(line, at):
            kind = m.lastgroup if m.lastgroup != "sep" else "date"
            old, at = m[0], m.end()
            if kind in ("card", "iban"):
                old, new = _grouped(kind, old, cipher, back) or (old, None)
                first = re.match(r"[A-Za-z0-9]+", m[0]).end()
                at = m.start() + (first if new is None else len(old))
            else:
                new = replacement(kind, old, cipher, back)
            if new is not None:
                out += [line[done : m.start()], new]
                done = m.start() + len(old)
                found[kind] = found.get(kind, 0) + 1
        return "".join([*out, line[done:]])

    # No finding spans lines, so only lines with a trigger are searched.
    return "\n".join(searched(line) if _TRIGGER.search(line) else line for line in text.split("\n"))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows with their text pseudonymised, and the counts n_<kind> and n_found added; other columns stay as they are."""
    names = [f"n_{k}" for k in KINDS]
    names = [n if n not in docs.columns else f"pii_{n}" for n in names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            column = batch.column(i)
            hit = pc.fill_null(pc.match_substring_regex(column, TRIGGER), False)
            at = [k for k, h in enumerate(hit.to_pylist()) if h]
            counts = {k: [0] * len(column) for k in KINDS}
            new: dict[int, str] = {}
            for k in at:
                found: dict[str, int] = {}
                new[k] = pseudonymise_text(column[k].as_py(), cipher, found)
                for kind, n in found.items():
                    counts[kind][k] = n
            if new:
                mask = pa.array([k in new for k in range(len(column))])
                column = pc.replace_with_mask(column, mask, pa.array([new[k] for k in at], column.type))
            arrays = [column if k == i else batch.column(k) for k in range(batch.num_columns)]
            yield pa.record_batch([*arrays, *(pa.array(counts[k], pa.int64()) for k in KINDS)], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return docs.mapInArrow(trimmed(task), schema).withColumn("n_found", sum((F.col(n) for n in names), F.lit(0)).cast("long"))
