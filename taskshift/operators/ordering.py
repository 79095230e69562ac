"""Order-dependent operators that stay distributed.

A global running total (or a global row number) is usually written as a
window with an empty ``partitionBy()``, which pulls every row into one task.
``prefix_sum`` instead:

1. range-partitions the rows on the (total) sort order, so each partition
   holds one contiguous slice of it and a hot key value is split like any
   other, and stamps each row with its partition id;
2. computes the running total inside each slice (window on the slice id)
   and checkpoints that frame (reliable checkpoint in the cluster's shared
   ``spark.checkpoint.dir``): slice ids and running totals are fixed data,
   sorted once, for all consumers and after an executor loss;
3. adds the total of all earlier slices, taken from a table with one row per
   slice (its size is the partition count, a proven bound, so it is
   broadcast).

The sort order must be total (add unique tie-breakers), which also makes the
result deterministic. It is meant for pre-aggregated frames (distinct values,
occupation rows), not raw fact rows.

Order specs are a column name (ascending, nulls first) or a tuple
``(name, ascending, nulls_last)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskshift.session import cut_lineage

_PID = "__pid"


def _spec(o) -> tuple[str, bool, bool]:
    if isinstance(o, str):
        return o, True, False
    name, asc, nulls_last = o
    return name, bool(asc), bool(nulls_last)


def sort_cols(order: Sequence) -> list[Column]:
    """Order specs -> sort Columns with explicit null placement."""
    out = []
    for name, asc, nl in map(_spec, order):
        c = F.col(name)
        if asc:
            out.append(c.asc_nulls_last() if nl else c.asc_nulls_first())
        else:
            out.append(c.desc_nulls_last() if nl else c.desc_nulls_first())
    return out


def prefix_sum(df: DataFrame, order: Sequence, value, name: str,
               partitions: int | None = None) -> DataFrame:
    """Inclusive running total of ``value`` over a total ``order`` (distributed)."""
    val = F.col(value) if isinstance(value, str) else value
    cols = df.columns
    order_cols = sort_cols(order)
    base = df.withColumn("__v", val)
    # without an explicit count AQE may merge adjacent range partitions to its
    # advisory size; merged slices stay contiguous and in order
    ranged = (base.repartitionByRange(*order_cols) if partitions is None
              else base.repartitionByRange(partitions, *order_cols))
    ranged = ranged.withColumn(_PID, F.spark_partition_id())
    inside = Window.partitionBy(_PID).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = cut_lineage(ranged.withColumn("__local", F.sum("__v").over(inside)))
    earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.groupBy(_PID).agg(F.sum("__v").alias("__ptot"))
               .select(_PID, F.coalesce(F.sum("__ptot").over(earlier), F.lit(0)).alias("__off")))
    return (local.join(F.broadcast(offsets), _PID)
            .select(*cols, (F.col("__off") + F.col("__local")).alias(name)))


def global_row_number(df: DataFrame, order: Sequence, name: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """1-based position in a total order, without a single-partition window."""
    return prefix_sum(df, order, F.lit(1).cast("bigint"), name, partitions)


def rank_within(df: DataFrame, partition: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """Row number inside each partition (use on aggregated, small partitions)."""
    w = Window.partitionBy(*partition).orderBy(*sort_cols(order))
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def stacked_midpoint(df: DataFrame, partition: Sequence[str], order: Sequence, value: str,
                     name: str = "label_pos") -> DataFrame:
    """Midpoint of each segment when values are stacked in ``order`` per partition."""
    w = Window.partitionBy(*partition).orderBy(*sort_cols(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w) - F.col(value) / 2)


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """Preview of the first ``k`` rows of an order (TakeOrderedAndProject)."""
    return df.orderBy(*sort_cols(order)).limit(k)
