"""taskshift: occupational AI-exposure analytics on Spark DataFrames.

Task-level exposure / automation scores are classified, rolled up to
occupations, and joined with employment, wage, education, demographic,
industry-staffing and metropolitan tables to give weighted summaries,
category shares, rankings and distributions.

Layout
------
functions/  Column-level helpers: missing-value rules, code rules, bands.
operators/  DataFrame-level operators: joins, reshape, shares, ordering, stats.
sources/    Readers, fixed lookups, stand-in inputs, sinks.
plans/      The named result tables (DataFrame -> DataFrame compositions).
streaming/  Incremental (Structured Streaming) form of the row-wise steps.
"""

from taskshift.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
