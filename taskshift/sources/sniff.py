"""Delimiter and type guess for delimited text, from a bounded sample.

The first ``max_lines`` lines of a file are looked at (a documented bound: the
sample comes to the driver, the file never does). Delimiter: for each
candidate the sample is split into records, with quoted fields and line breaks
inside quotes; the score is the share of records that have the most common number
of fields, and among equal shares the one with more fields wins, then the order of
``DELIMITERS``. A candidate that splits nothing scores nothing.

Types form a lattice: a column starts at the narrowest type and widens cell by
cell, ``boolean``, ``bigint`` < ``double``, ``date`` < ``timestamp``, and ``string``
above all. Missing cells (empty, ``NA``) decide nothing; a column of only those is text.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from taskshift.functions.nulls import to_number

MAX_LINES = 1000
#: Characters of the sample; the file itself is read whole.
MAX_SAMPLE = 4 << 20
#: Files of a folder that are opened in search of one with more than a header.
MAX_FILES = 20
DELIMITERS = ("\t", ",", ";", "|")
MISSING = ("", "NA")

_NUMBER = re.compile(r"\s*[-+]?(\d{1,3}(,\d{3})+(\.\d*)?|\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?)\s*$")
_WHOLE = re.compile(r"\s*[-+]?(\d{1,3}(,\d{3})+|\d{1,18})\s*$")
_DATE = re.compile(r"\s*\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\s*$")
_TIME = re.compile(r"\s*\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?\s*$")
_WIDER = {frozenset(("bigint", "double")): "double", frozenset(("date", "timestamp")): "timestamp"}


class Guess(NamedTuple):
    """What a file looks like: delimiter, whether records span lines, names and types of its columns, share of records that agree."""

    sep: str
    multiline: bool
    columns: list[str]
    types: list[str]
    agreement: float


def cell_type(cell: str) -> str | None:
    """The narrowest type of one cell; None if it is missing."""
    if cell.strip() in MISSING:
        return None
    if cell.strip().lower() in ("true", "false"):
        return "boolean"
    if _WHOLE.match(cell) and not re.match(r"\s*0\d", cell):         # 00123 is a code, not a number
        return "bigint"
    if _NUMBER.match(cell) and not re.match(r"\s*0\d", cell):
        return "double"
    return "date" if _DATE.match(cell) else "timestamp" if _TIME.match(cell) else "string"


def widen(a: str | None, b: str | None) -> str | None:
    """The least type that holds both."""
    if a is None or b is None or a == b:
        return a or b
    return _WIDER.get(frozenset((a, b)), "string")


def records(lines: list[str], sep: str) -> list[list[str]]:
    """The sample's records; one that the sample's end cuts inside quotes is left out."""
    out = list(csv.reader((line + "\n" for line in lines), delimiter=sep, quotechar='"', doublequote=True, strict=False))
    return out[:-1] if len(out) > 1 and "\n".join(lines).count('"') % 2 else out


def score(rows: list[list[str]]) -> tuple[float, int]:
    """Share of records with the most common number of fields, and that number; (0, 1) if nothing is split."""
    widths = Counter(len(r) for r in rows if r)
    width, n = max(widths.items(), key=lambda kv: (kv[1], kv[0]), default=(1, 0))
    return (n / max(1, sum(widths.values())), width) if width > 1 else (0.0, 1)


def guess(lines: list[str]) -> Guess:
    """The guess for a sample of lines, the first of which is the header."""
    best, rows = (0.0, 1), records(lines, ",")
    sep = ","
    for s in DELIMITERS:
        got = records(lines, s)
        if score(got) > best:
            best, sep, rows = score(got), s, got
    rows = [r for r in rows if r]
    if not rows:
        return Guess(sep, False, [], [], 0.0)
    types: list[str | None] = [None] * len(rows[0])
    for r in rows[1:]:
        for i, cell in enumerate(r[:len(types)]):
            types[i] = widen(types[i], cell_type(cell))
    return Guess(sep, any("\n" in c for r in rows for c in r), rows[0], [t or "string" for t in types], best[0])


def sniff(spark: SparkSession, path: str, max_lines: int = MAX_LINES) -> Guess:
    """The guess for a file, from its first ``max_lines`` lines (at most MAX_SAMPLE characters of them); for a folder, of its first file with records."""
    size, lines = 0, []
    files = sorted(spark.read.text(path).inputFiles())
    for file in files[:MAX_FILES]:
        sample = spark.read.text(file).limit(max_lines).collect()
        if len(sample) > 1 or file == files[:MAX_FILES][-1]:
            break
    else:
        return guess([])
    for r in sample:
        size += len(r["value"])
        if size > MAX_SAMPLE and lines:
            break
        lines.append(r["value"])
    return guess(lines)


def typed_cell(c: str, to: str) -> Column:
    """A text cell as its type; what does not parse is missing."""
    cell = F.col(f"`{c}`")
    if to in ("bigint", "double"):
        grouped = cell.rlike(r"^\s*[-+]?\d{1,3}(,\d{3})+(\.\d*)?\s*$")
        return to_number(cell, to) if to == "double" else F.when(grouped, F.regexp_replace(cell, ",", "")).otherwise(F.trim(cell)).try_cast("bigint")
    return cell if to == "string" else F.trim(cell).try_cast(to)
