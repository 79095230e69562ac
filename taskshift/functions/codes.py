"""Occupation and industry code rules (string Columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values taken from the analysed scripts: the teacher roll-up target and
# the 2-digit industry codes that are folded into ranges.
POSTSECONDARY_PREFIX = "25-1"
POSTSECONDARY_SOC = "25-1099"
SECTOR_RANGES = [
    (("31", "32", "33"), "31-33"),
    (("44", "45"), "44-45"),
    (("48", "49"), "48-49"),
    (("90",), "92"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix(x, n: int = 2) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(x), 1, n)


def drop_last(x, n: int = 3) -> Column:
    """All but the last ``n`` characters (``11-1011.00`` -> ``11-1011``)."""
    x = _c(x)
    return F.left(x, F.length(x) - F.lit(n))


def suffix_from(x, pos: int) -> Column:
    """Characters from 1-based position ``pos`` to the end."""
    return F.substring(_c(x), pos, 1 << 30)


def major_group(code) -> Column:
    """2-digit major group code, e.g. ``15-1252.00`` -> ``15-0000``."""
    return F.concat(prefix(code, 2), F.lit("-0000"))


def soc6(code) -> Column:
    """Detailed O*NET code -> 6-digit SOC (drop the ``.NN`` suffix)."""
    return drop_last(code, 3)


def soc6_collapsed(code) -> Column:
    """6-digit SOC with every postsecondary-teacher code sent to one SOC."""
    code = _c(code)
    return F.when(code.startswith(POSTSECONDARY_PREFIX), F.lit(POSTSECONDARY_SOC)).otherwise(soc6(code))


def fold_sector(naics6: str) -> str:
    """``sector_code`` of an industry code known at plan time."""
    two = naics6[:2]
    return next((target for members, target in SECTOR_RANGES if two in members), two)


def sector_code(naics6) -> Column:
    """6-digit industry code -> 2-digit sector code with range folding."""
    two = prefix(naics6, 2)
    out = F
    for members, target in SECTOR_RANGES:
        out = out.when(two.isin(*members), F.lit(target))
    return out.otherwise(two)
