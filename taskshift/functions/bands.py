"""Ordered category rules (first matching branch wins; see nulls.py for M-rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskshift.functions.nulls import if_else, in_set, nan_to_null

# ---------------------------------------------------------------------------
# Fixed values from the analysed scripts (labels, thresholds, weights).
# ---------------------------------------------------------------------------
AUTOMATED = "more likely automated"
AUGMENTED = "more likely augmented"
MINIMAL = "minimal impact"
AI_CATEGORIES = [MINIMAL, AUGMENTED, AUTOMATED]
AUTOMATION_THRESHOLD = 0.5
AUGMENTATION_THRESHOLD = 1.0

TASK_WEIGHTS = {"Core": 2.0, "Supplemental": 0.5}
TASK_WEIGHT_DEFAULT = 1.0

WAGE_BANDS = [("<18", None, 18.0), ("18-23", 18.0, 23.0), ("23-37", 23.0, 37.0), ("37+", 37.0, None)]

EDUCATION_BANDS = [
    ("4. Advanced Degree", ["Master's degree", "Doctoral or professional degree"]),
    ("3. Bachelor's or Associate's", ["Bachelor's degree", "Associate's degree"]),
    ("2. Some College", ["High school diploma or equivalent", "Some college, no degree"]),
    ("1. High School or below", ["No formal educational credential", "Postsecondary nondegree award"]),
]
EDUCATION_DEFAULT = "Other"

TRAINING_BANDS = [
    ("Apprenticeship/Internship", ["Apprenticeship", "Internship/residency"]),
    ("Long/Moderate-term Training", ["Long-term on-the-job training", "Moderate-term on-the-job training"]),
    ("Short-term Training", ["Short-term on-the-job training"]),
    ("No On-The-Job Training", ["None"]),
    ("Not Applicable", ["N/A"]),
]
TRAINING_DEFAULT = "Other"
TRAINING_ORDER = ["No On-The-Job Training", "Short-term Training", "Long/Moderate-term Training",
                  "Apprenticeship/Internship", "Not Applicable", "Other"]

GENDER_GROUPS = ["females", "males"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ai_category(automation, gamma, automation_threshold: float = AUTOMATION_THRESHOLD,
                augmentation_threshold: float = AUGMENTATION_THRESHOLD) -> Column:
    """Automated if automation > threshold, else augmented if gamma == threshold, else minimal (NaN is missing)."""
    return (F.when(nan_to_null(_c(automation)) > F.lit(automation_threshold), F.lit(AUTOMATED))
            .when(_c(gamma) == F.lit(augmentation_threshold), F.lit(AUGMENTED))
            .otherwise(F.lit(MINIMAL)))


def task_weight(task_type) -> Column:
    """Core 2, Supplemental 0.5, any other or missing type 1."""
    t = _c(task_type)
    out = F
    for label, wt in TASK_WEIGHTS.items():
        out = out.when(t == label, F.lit(wt))
    return out.otherwise(F.lit(TASK_WEIGHT_DEFAULT))


def has_exposure(beta) -> Column:
    """1 when beta > 0, 0 when not, missing when beta is missing or NaN."""
    return if_else(nan_to_null(_c(beta)) > 0, F.lit(1.0), F.lit(0.0))


def at_least(x, t: float) -> Column:
    """Threshold flag ``x >= t`` (missing or NaN x gives a missing flag)."""
    return nan_to_null(_c(x)) >= F.lit(t)


def wage_band(wage) -> Column:
    """Half-open wage bands; a missing or NaN wage gives a missing band."""
    w = nan_to_null(_c(wage))
    out = F
    for label, lo, hi in WAGE_BANDS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (w >= lo)
        if hi is not None:
            cond = cond & (w < hi)
        out = out.when(cond, F.lit(label))
    return out


def _membership_bands(x, bands, default) -> Column:
    out = F
    for label, members in bands:
        out = out.when(in_set(x, members), F.lit(label))
    return out.otherwise(F.lit(default))


def education_band(education) -> Column:
    """Four entry-education bands; anything else (or missing) is ``Other``."""
    return _membership_bands(education, EDUCATION_BANDS, EDUCATION_DEFAULT)


def training_band(training) -> Column:
    """Five on-the-job training bands; anything else (or missing) is ``Other``."""
    return _membership_bands(training, TRAINING_BANDS, TRAINING_DEFAULT)


def level_order(x, levels) -> Column:
    """1-based position of a label in a fixed level list (NULL if absent)."""
    out = F
    for i, lv in enumerate(levels, start=1):
        out = out.when(_c(x) == lv, F.lit(i))
    return out


def demographic_type(demo) -> Column:
    """``gender`` for the female / male groups, ``race`` otherwise."""
    return F.when(in_set(demo, GENDER_GROUPS), F.lit("gender")).otherwise(F.lit("race"))


def interval_bin(x, breaks: list[Column], include_lowest: bool = False) -> Column:
    """Right-closed interval index (1-based) for ``breaks``; the lowest break is
    excluded unless ``include_lowest``; values outside, and NaN -> NULL."""
    x = nan_to_null(_c(x))
    out = F
    for i in range(len(breaks) - 1):
        lo, hi = breaks[i], breaks[i + 1]
        lower_ok = (x >= lo) if (include_lowest and i == 0) else (x > lo)
        out = out.when(lower_ok & (x <= hi), F.lit(i + 1))
    return out
