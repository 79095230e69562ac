"""Wide <-> long reshapes.

* ``to_long``      wide -> long over a metric list, missing cells kept
                   (``DataFrame.unpivot``: an Expand node, no shuffle).
* ``very_wide_to_long``  hundreds of measure columns -> long via one
                   ``inline(array(struct(...)))`` Generate (no shuffle); the
                   caller can fuse a filter / partial aggregate right after it.
* ``to_wide``      long -> wide with an explicit value list, written as one
                   conditional aggregate per (value, measure), so a single
                   hash aggregate (with map-side partial aggregation) does the
                   whole pivot. ``fill`` gives V3 (absent -> 0) vs V1 (NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Wide -> long; NULL cells are kept (as a tidy ``pivot_longer`` does)."""
    return df.unpivot(list(ids), list(values), name_col, value_col)


def very_wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                      name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Wide -> long for very many measure columns of one common type."""
    cells = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(f"`{c}`").alias(value_col)) for c in values])
    return df.select(*ids, F.inline(cells))


def pivot_agg(key: str, value: str, measure: Column, agg=F.max) -> Column:
    """One pivot cell: ``agg(measure)`` over the rows whose key equals ``value``."""
    return agg(F.when(F.col(key) == F.lit(value), measure))


def to_wide(df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str],
            measures: dict[str, str], fill=None, agg=F.max,
            names: dict[str, str] | None = None) -> DataFrame:
    """Long -> wide with explicit key values.

    ``measures`` maps a measure column to the prefix of its wide columns
    ('' for a single measure). ``names`` maps key values to column-name
    stems (default: the value itself). Absent combinations give NULL, or
    ``fill`` when given. Each (ids, key) cell is expected to hold one value;
    ``agg`` (default ``max``, deterministic) decides otherwise.
    """
    names = names or {}
    out = []
    for m, pre in measures.items():
        for v in values:
            stem = names.get(v, v)
            col = pivot_agg(key, v, F.col(m), agg)
            if fill is not None:
                col = F.coalesce(col, F.lit(fill))
            out.append(col.alias(f"{pre}_{stem}" if pre else stem))
    return df.groupBy(*ids).agg(*out)


def split_last(col: str, sep: str = "_") -> tuple[Column, Column]:
    """Split at the last separator: ``mean_rating_human_alpha`` -> (``mean_rating_human``, ``alpha``)."""
    c = F.col(col)
    parts = F.split(c, f"{sep}(?!.*{sep})", 2)
    return parts.getItem(0), F.element_at(parts, 2)
