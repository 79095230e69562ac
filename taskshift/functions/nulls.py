"""Missing-value rules as aggregate / scalar Column expressions.

Every aggregate here is algebraic (built from sum / count / bool_or), so
Spark can split it into a partial (map-side) and a final aggregate: a hot
group never has to be gathered in one place before it is reduced.

The policy is chosen per call site, never globally:

* ``mean_skip``   missing values are skipped; all missing -> NULL.
* ``mean_strict`` any missing value makes the result missing.
* ``sum_skip``    missing skipped; all missing -> 0.
* ``sum_strict``  any missing -> missing.
* ``wmean``       weighted mean; rows with missing x are dropped from both
                  sums, a missing weight on a kept row makes the result
                  missing (``null_weight="propagate"``, the default) or is
                  dropped (``"drop"``); zero total weight -> NULL.
* ``sd_strict``   sample standard deviation; one row -> NULL; any missing
                  -> NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    """NaN never survives into comparisons: it becomes NULL."""
    x = _c(x)
    return F.nanvl(x, F.lit(None).cast("double"))


def to_number(x, to: str = "double") -> Column:
    """Text -> number: grouping marks dropped, anything else that is no number (and NaN) -> NULL."""
    x = _c(x)
    grouped = x.rlike(r"^\s*[-+]?\d{1,3}(,\d{3})+(\.\d*)?\s*$")
    plain = F.when(grouped, F.regexp_replace(x, ",", "")).otherwise(x).try_cast(to)
    return nan_to_null(plain) if to == "double" else plain


def safe_div(a, b) -> Column:
    """Division that yields NULL (not an error, not Inf) on a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def mean_skip(x) -> Column:
    """Mean skipping missing values; all missing -> NULL."""
    return F.avg(_c(x))


def mean_strict(x) -> Column:
    """Mean that is missing as soon as one value is missing."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def sum_skip(x) -> Column:
    """Sum skipping missing values; all missing -> 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0).cast("double"))


def sum_strict(x) -> Column:
    """Sum that is missing as soon as one value is missing."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def sd_strict(x) -> Column:
    """Sample standard deviation; one row or any missing value -> NULL."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.stddev_samp(x))


def wmean(x, w, null_weight: str = "propagate") -> Column:
    """Weighted mean with the missing-value rule described in the module doc."""
    x, w = _c(x).cast("double"), _c(w).cast("double")
    kept = x.isNotNull()
    num = F.sum(F.when(kept & (w != 0), x * w))
    if null_weight == "drop":
        den = F.sum(F.when(kept & w.isNotNull(), w))
        return F.try_divide(num, den)
    if null_weight != "propagate":
        raise ValueError(f"null_weight must be 'propagate' or 'drop', not {null_weight!r}")
    den = F.sum(F.when(kept, w))
    bad = F.coalesce(F.bool_or(kept & w.isNull()), F.lit(False))
    return F.when(~bad, F.try_divide(num, den))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice where a missing condition gives a missing result."""
    return F.when(cond, yes).when(~cond, no)


def in_set(x, values) -> Column:
    """Membership that is FALSE (not NULL) for a missing value."""
    return F.coalesce(_c(x).isin(list(values)), F.lit(False))

