"""Column naming and selection helpers (resolved at plan time on df.schema)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Fixed display names of the source files, mapped to engine (snake_case) names.
DISPLAY_NAMES = {
    "soc_code": "O*NET-SOC Code",
    "task_id": "Task ID",
    "task": "Task",
    "title": "Title",
    "task_type": "Task Type",
    "soc": "SOC",
    "description": "Description",
    "jobs": "2022 Jobs",
    "avg_hourly_earnings": "Avg. Hourly Earnings",
    "median_hourly_earnings": "Median Hourly Earnings",
    "education": "Typical Entry Level Education",
    "training": "Typical On-The-Job Training",
    "current_year_males": "Current Year Males",
    "current_year_females": "Current Year Females",
    "occupation": "Occupation",
    "area": "Area",
    "area_name": "Area Name",
    "minimal_impact": "minimal impact",
    "more_likely_augmented": "more likely augmented",
    "more_likely_automated": "more likely automated",
}
_STEMS = ("minimal_impact", "more_likely_augmented", "more_likely_automated")
DISPLAY_NAMES.update({f"{kind}_{s}": f"{kind}_{DISPLAY_NAMES[s]}" for kind in ("pct_tasks", "pct_weighted") for s in _STEMS})


def snake(name: str) -> str:
    """``Avg. Hourly Earnings`` -> ``avg_hourly_earnings``; ``O*NET-SOC Code`` -> ``o_net_soc_code``."""
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip()).strip("_").lower()
    return s or "col"


def normalise_names(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rename every column to snake_case once, at load (overrides win)."""
    inv = {v: k for k, v in DISPLAY_NAMES.items()}
    inv.update(overrides or {})
    return df.select(*[df[f"`{c}`"].alias(inv.get(c, snake(c))) for c in df.columns])


def display_names(df: DataFrame) -> DataFrame:
    """Restore display names at a sink."""
    return df.select(*[df[f"`{c}`"].alias(DISPLAY_NAMES.get(c, c)) for c in df.columns])


def display_stem(col: str) -> Column:
    """Category column names held as values, in the categories' own labels."""
    out = F.col(col)
    for s in _STEMS:
        out = F.when(F.col(col) == s, F.lit(DISPLAY_NAMES[s])).otherwise(out)
    return out


def display_demographic(col: str) -> Column:
    """Demographic names held as values, as the source spells them (``males`` -> ``Males``)."""
    return F.initcap(F.regexp_replace(F.col(col), "_", " "))


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Inclusive name range in physical column order (``a:b``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if j < i:
        raise ValueError(f"{last!r} comes before {first!r}")
    return cols[i:j + 1]


def numeric_cols(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns (select by type)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def cols_containing(df: DataFrame, text: str) -> list[str]:
    """Names containing ``text``, case-insensitive (select by substring)."""
    t = text.lower()
    return [c for c in df.columns if t in c.lower()]


def front(df: DataFrame, first: list[str]) -> DataFrame:
    """Move ``first`` to the front and keep every other column after them."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def by_position(df: DataFrame, start: int, stop: int | None = None) -> list[str]:
    """Columns by 1-based inclusive position range (``3:949``)."""
    return df.columns[start - 1:stop]
