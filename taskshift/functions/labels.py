"""Sink-side label formatting (charts and published sheets only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_label(x, accuracy: float = 0.1) -> Column:
    """``0.1234`` -> ``'12.3%'`` with ``accuracy`` in percentage points."""
    c = F.col(x) if isinstance(x, str) else x
    digits = max(0, int(round(-math.log10(accuracy)))) if accuracy < 1 else 0
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", F.round(c * 100, digits)))

