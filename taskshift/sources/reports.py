"""Reports of cells that could not be read as what their column declares.

A cell that is present and does not parse becomes missing, with a warning in the
source. Here the warning is a count per column and a few of the cells: either
from the read itself (``ReadReport``: an ``observe`` on the text columns, no
second scan) or as a table of its own (``failed_cells``: one aggregate).
A cell that says NaN is missing by rule, not a failure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taskshift.functions.nulls import to_number

#: Failed cells are sampled by hash: the least one of each of so many slots.
SLOTS = 3
SCHEMA = "reader string, column string, type string, cells bigint, failed bigint, sample array<string>"


def is_failed(c: str, to: str) -> Column:
    """A cell that is present, is not NaN, and does not parse as the type ``to``."""
    cell = F.col(f"`{c}`")
    return cell.isNotNull() & to_number(cell, to).isNull() & ~F.lower(F.trim(cell)).isin("nan", "+nan", "-nan")


def _metrics(i: int, c: str, to: str) -> list[Column]:
    cell, bad = F.col(f"`{c}`"), is_failed(c, to)
    slot = F.pmod(F.hash(cell), F.lit(SLOTS))
    return [F.count(cell).alias(f"cells{i}"), F.count_if(bad).alias(f"failed{i}"),
            *[F.min(F.when(bad & (slot == k), cell)).alias(f"bad{i}_{k}") for k in range(SLOTS)]]


def failed_cells(text: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, type, cells, failed, sample for every column in ``types`` of a table of text, from one aggregate."""
    one = text.agg(*[m for i, (c, t) in enumerate(types.items()) for m in _metrics(i, c, t)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"cells{i}").alias("cells"), F.col(f"failed{i}").alias("failed"),
                     F.array_sort(F.array_compact(F.array(*[F.col(f"bad{i}_{k}") for k in range(SLOTS)]))).alias("sample"))
            for i, (c, t) in enumerate(types.items())]
    return one.select(F.inline(F.array(*rows)))


class ReadReport:
    """Failed cells of one or more readers, counted while their tables are first used.

    Hand it to the readers, run what uses their tables, then ask for ``rows``. The
    counts are of the rows that the run read: a plan that reads a table
    twice reports its first run.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, dict[str, str], Observation]] = []

    def watch(self, text: DataFrame, types: dict[str, str], reader: str) -> DataFrame:
        types = {c: t for c, t in types.items() if c in text.columns}
        if not types:
            return text
        seen = Observation(f"{reader}-{uuid.uuid4().hex}")
        self._seen.append((reader, types, seen))
        return text.observe(seen, *[m for i, (c, t) in enumerate(types.items()) for m in _metrics(i, c, t)])

    def rows(self, spark: SparkSession, only_failed: bool = False) -> DataFrame:
        """One row per reader and declared column. Waits until the watched tables have been used."""
        out = []
        for reader, types, seen in self._seen:
            got = seen.get
            for i, (c, t) in enumerate(types.items()):
                bad = sorted(got[f"bad{i}_{k}"] for k in range(SLOTS) if got.get(f"bad{i}_{k}") is not None)
                out.append((reader, c, t, got[f"cells{i}"], got[f"failed{i}"], bad))
        df = spark.createDataFrame(out, SCHEMA)
        return df.where("failed > 0") if only_failed else df
