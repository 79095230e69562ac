"""Weighted quantiles from a mergeable summary of bounded size.

A summary is a sorted list of values with weights. It is made by packing: sorted
points are joined into runs of at most ``1 / size`` of the total weight,
each standing at its largest value; a point heavier than half of that stands alone, so
it costs no accuracy. Packing moves the weighted rank of any value by at most
``1 / size`` of the total weight, and merging summaries adds no error of its own,
so a value's rank is off by at most ``levels / size``: one level where rows are
summarised, one for each of the two rounds of merging, two more for every later
``merge_sketches`` (``rank_error``; the column ``levels`` counts them).

Tasks summarise ``HELD`` rows at a time; summaries are merged in ``FAN`` groups
first, then into one, so a group with a third of all rows is spread over
FAN tasks, each of which sees summaries alone. Sketch rows of several tables or
days are combined by ``merge_sketches``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SIZE = 1000
#: Groups of summaries in the first round of merging, and rows that are summarised at once.
FAN, HELD = 64, 200_000
_COLUMNS = "xs array<double>, ws array<double>, levels int"


def rank_error(levels: int, size: int = SIZE) -> float:
    """Largest distance of a reported value's weighted rank from the asked one, as a share of the total weight."""
    return levels / size


def pack(x: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points in runs of at most 1 / size of the weight, each at its largest value."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    step = w.sum() / (2 * size)
    before = np.cumsum(w) - w
    # a run starts where its part of the weight does, and around a heavy point
    heavy = w > step
    part = np.floor(before / step) if step > 0 else np.zeros(len(x))
    new = np.ones(len(x), bool)
    new[1:] = (part[1:] != part[:-1]) | heavy[1:] | heavy[:-1]
    first = np.flatnonzero(new)
    return np.maximum.reduceat(x, first), np.add.reduceat(w, first)


def _schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    extra = df.sparkSession.createDataFrame([], _COLUMNS).schema.fields
    return StructType([*[StructField(k, df.schema[k].dataType) for k in keys], *extra])


def weighted_sketch(df: DataFrame, keys: Sequence[str], x: str, w: str, size: int = SIZE) -> DataFrame:
    """One summary per group (a missing key is a group): rows with a missing value or weight, and weights not above 0, are left out."""
    keys = list(keys)
    clean = df.where(F.col(x).isNotNull() & F.col(w).isNotNull() & (F.col(w) > 0) & ~F.isnan(F.col(x).cast("double")))
    clean = clean.select(*keys, F.col(x).cast("double").alias("__x"), F.col(w).cast("double").alias("__w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= HELD:
                yield summaries(pd.concat(held))
                held, n = [], 0
        if n:
            yield summaries(pd.concat(held))

    def summaries(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, g in frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]:
            name = [None if pd.isna(v) else v for v in (k if isinstance(k, tuple) else (k,))]
            rows.append((*name, *pack(g["__x"].to_numpy(), g["__w"].to_numpy(), size), 1))
        return pd.DataFrame(rows, columns=[*keys, "xs", "ws", "levels"])

    return merge_sketches(clean.mapInPandas(run, _schema(clean, keys)), keys, size)


def merge_sketches(rows: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Summaries of one group combined into one: in FAN groups, by the task they came from, then all."""
    keys = list(keys)
    schema = _schema(rows, keys)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        head = [None if pd.isna(frame[k].iloc[0]) else frame[k].iloc[0] for k in keys]
        if len(frame) == 1:
            return frame[[*keys, "xs", "ws", "levels"]]
        xs, ws = pack(np.concatenate(list(frame["xs"])), np.concatenate(list(frame["ws"])), size)
        return pd.DataFrame([(*head, xs, ws, int(frame["levels"].max()) + 1)], columns=[*keys, "xs", "ws", "levels"])

    slot = F.pmod(F.spark_partition_id(), F.lit(FAN))
    some = rows.select(*keys, "xs", "ws", "levels", slot.alias("__slot")).groupBy(*keys, "__slot").applyInPandas(merge, schema)
    return some.groupBy(*keys).applyInPandas(merge, schema)


def quantiles_from_sketch(sketch: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """keys, total weight ``n``, one column per prob: the rule of ``stats.weighted_quantiles`` on the summary's points."""
    keys, probs, names = list(keys), list(probs), list(names)
    schema = StructType([*[StructField(k, sketch.schema[k].dataType) for k in keys],
                         *sketch.sparkSession.createDataFrame([], "n double, levels int, " + ", ".join(f"`{c}` double" for c in names)).schema.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for rec in frame.to_dict("records"):
                xs, cum = np.asarray(rec["xs"], float), np.cumsum(rec["ws"])
                n = float(cum[-1])
                pos = 1 + (n - 1) * np.array(probs)
                low = np.maximum(np.floor(pos), 1)
                value = lambda t: xs[np.minimum(np.searchsorted(cum, t * (1 - 1e-12)), len(xs) - 1)]  # noqa: B023, E731
                frac = pos - np.floor(pos)
                below = value(low)
                q = below + frac * (value(np.minimum(low + 1, n)) - below)           # exactly a value where both are equal
                rows.append((*[rec[k] for k in keys], n, rec["levels"], *q))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return sketch.mapInPandas(run, schema)
