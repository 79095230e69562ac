"""Shares and group statistics attached to rows.

* ``share_within``   x / sum(x) inside a partition (W1). Meant for
                     aggregated rows (a few per partition).
* ``share_of_total`` x / sum(x) over the whole frame (W2). The total is a
                     scalar subquery (one partial+final aggregate), so no
                     row is moved to a single partition and nothing is
                     cross-joined.
* ``attach_group_stats`` group aggregate joined back to every row (W3),
                     instead of a window whose hot partition would land in
                     one task. NULL group keys match each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskshift.functions.nulls import safe_div, sum_skip
from taskshift.operators.joins import join_null_safe


def share_within(df: DataFrame, partition: Sequence[str], measure: str, name: str) -> DataFrame:
    """x / sum(x) inside each partition (for aggregated rows, a few per partition)."""
    return df.withColumn(name, safe_div(F.col(measure), F.sum(measure).over(Window.partitionBy(*partition))))


def total_of(df: DataFrame, measure) -> Column:
    """Whole-frame total as a scalar-subquery Column."""
    m = F.col(measure) if isinstance(measure, str) else measure
    return df.agg(F.sum(m).alias("__total")).scalar()


def share_of_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """x / sum(x) over the whole frame; the total is a scalar subquery."""
    return df.withColumn(name, safe_div(F.col(measure), total_of(df, measure)))


def shares_of_totals(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Several whole-frame shares at once: all totals come from one
    struct-valued scalar subquery (one extra aggregate, not one per measure)."""
    tot = df.agg(F.struct(*[F.sum(m).alias(f"t{i}") for i, m in enumerate(measures)]).alias("t")).scalar()
    return df.withColumns({name: safe_div(F.col(m), tot.getField(f"t{i}"))
                           for i, (m, name) in enumerate(measures.items())})


def threshold_summary(df: DataFrame, flag: Column, flag_name: str,
                      sums: dict[str, str], count_name: str = "count",
                      share_names: dict[str, str] | None = None) -> DataFrame:
    """Split rows by a boolean flag (TRUE / FALSE / missing are three groups),
    count them, sum each measure skipping missing values, and give each
    group's share of the total count and of each measure total."""
    share_names = share_names or {}
    agg = df.groupBy(flag.alias(flag_name)).agg(
        F.count(F.lit(1)).alias(count_name),
        *[sum_skip(src).alias(out) for out, src in sums.items()])
    measures = {count_name: share_names.get(count_name, f"pct_{count_name.lower()}")}
    measures.update({col: share_names.get(col, f"pct_{col}") for col in sums})
    return shares_of_totals(agg, measures)


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                       bounded_groups: bool = False) -> DataFrame:
    """Every row gets its group's aggregates (partial-aggregated, then joined
    back). ``bounded_groups``: the group keys come from a fixed lookup, so the
    stats table is broadcast instead of shuffling rows onto a few keys."""
    stats = df.groupBy(*keys).agg(*aggs)
    return join_null_safe(df, stats, list(keys), "left", broadcast_right=bounded_groups)
