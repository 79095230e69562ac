"""Join helpers.

Broadcast policy: only the fixed lookups (sources/lookups.py, 22 and 20
rows) carry an explicit broadcast hint. Data-sized dimensions are joined
plainly; AQE converts a sort-merge join into a broadcast join at run time
when the *measured* shuffle size is under the threshold, and splits skewed
partitions otherwise. Nothing data-sized is broadcast on faith.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from taskshift.operators.audit import Audit
from taskshift.sources.lookups import occ_groups, sectors
from taskshift.functions import codes


def with_major_group(df: DataFrame, code_col: str, audit: Audit | None = None) -> DataFrame:
    """Add ``occ_2`` from a code column and left-join the major-group lookup."""
    coded, groups = df.withColumn("occ_2", codes.major_group(code_col)), occ_groups(df.sparkSession)
    if audit:
        return audit.join(coded, groups, ["occ_2"], "left", "occupation group", right_only=False)
    return coded.join(groups, "occ_2", "left")


def with_sector(df: DataFrame, naics6_col: str, keep_unmatched: bool = False) -> DataFrame:
    """Fold a 6-digit industry code to its sector and attach the sector lookup.

    Unmatched codes are dropped unless ``keep_unmatched`` (left join + not-null
    filter, which Catalyst turns into an inner broadcast join)."""
    spark = df.sparkSession
    out = df.withColumn("naics2_code", codes.sector_code(naics6_col)).join(sectors(spark), "naics2_code", "left")
    return out if keep_unmatched else out.where(F.col("sector").isNotNull())


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   broadcast_right: bool = False) -> DataFrame:
    """Equi-join where NULL keys match each other (group tables carry a NULL group).

    ``broadcast_right`` only when the right side has a proven size bound
    (e.g. one row per label of a fixed lookup); otherwise AQE decides."""
    cond = None
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    if broadcast_right:
        r = F.broadcast(r)
    for k in keys:
        e = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def join_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row accounting for an equi-join, without running the join itself.

    Both sides are reduced to per-key row counts (partial aggregation), the
    two count tables are full-outer joined on the keys, and one global
    aggregate gives: rows on each side, rows matched / unmatched on each
    side, keys duplicated on each side, and the row counts an inner and a
    left join would produce.
    """
    keys = list(keys)
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ln"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rn"))
    both = lc.join(rc, keys, "full")
    ln = F.coalesce(F.col("__ln"), F.lit(0))
    rn = F.coalesce(F.col("__rn"), F.lit(0))
    matched = (ln > 0) & (rn > 0)
    return both.agg(
        F.sum(ln).cast("bigint").alias("left_rows"),
        F.sum(rn).cast("bigint").alias("right_rows"),
        F.coalesce(F.sum(F.when(matched, ln)), F.lit(0)).cast("bigint").alias("left_matched_rows"),
        F.coalesce(F.sum(F.when(rn == 0, ln)), F.lit(0)).cast("bigint").alias("left_only_rows"),
        F.coalesce(F.sum(F.when(matched, rn)), F.lit(0)).cast("bigint").alias("right_matched_rows"),
        F.coalesce(F.sum(F.when(ln == 0, rn)), F.lit(0)).cast("bigint").alias("right_only_rows"),
        F.count(F.when(ln > 1, 1)).alias("left_duplicate_keys"),
        F.count(F.when(rn > 1, 1)).alias("right_duplicate_keys"),
        F.coalesce(F.sum(F.when(matched, ln * rn)), F.lit(0)).cast("bigint").alias("inner_rows"),
        F.coalesce(F.sum(F.when(matched, ln * rn).when(ln > 0, ln)), F.lit(0)).cast("bigint").alias("left_join_rows"),
    )


def audited_filter(df: DataFrame, cond: Column, name: str) -> tuple[DataFrame, Observation]:
    """Filter that also reports rows in / kept / removed once the result is
    computed (``Observation.get`` after an action), without an extra pass."""
    obs = Observation(name)
    kept = F.count(F.when(cond, 1))
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows_in"), kept.alias("rows_kept"),
                          (F.count(F.lit(1)) - kept).alias("rows_removed"))
    return observed.where(cond), obs
