"""Column-level helpers (no UDFs: everything stays in whole-stage codegen)."""

from taskshift.functions import bands, codes, columns, nulls  # noqa: F401
