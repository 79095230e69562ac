"""The named tables the analysis publishes, written through the sink.

Sheet names are the fixed names used by the analysed scripts. Each table is
computed by the result functions in ``exposure`` / ``automation`` and
written (overwrite, one commit for all) under ``out_dir/<sheet>``; nothing passes through the
driver. The occupation tables that several sheets share (mean scores, SOC
scores with employment, category counts) are checkpointed once per run, so the
statement join runs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from taskshift.plans import automation as A
from taskshift.plans import exposure as E
from taskshift.session import cut_lineage
from taskshift.sources.sinks import write_tables

# Sheet names of the published tables.
EXPOSURE_SHEETS = ["gender", "figure 1", "figure 2", "Occupation", "Occupation Groups",
                   "exposure_Metro", "exposure_Industry"]
AUTOMATION_SHEETS = ["automation_mean_score_occupation", "automation_category_occupation", "automation_Metro"]


def published_tables(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sheet name -> result frame, from the domain inputs
    (tasks, task_statements, us_emp, metro_emp, metro_dim, staffing_wide)."""
    tasks, us_emp = inputs["tasks"], inputs["us_emp"]
    score_emp = cut_lineage(E.soc_scores_employment(tasks, us_emp))
    occ = cut_lineage(E.occ_mean_scores(tasks))
    counts = cut_lineage(A.occ_category_counts(A.classify_tasks(tasks, inputs["task_statements"])))
    master = E.master_from_share(score_emp, A.share_from_counts(counts))
    return {
        "gender": E.large_exposed_occupations(score_emp),
        "figure 1": E.group_beta_wage(score_emp),
        "figure 2": E.group_wage_table(score_emp),
        "Occupation": master,
        "Occupation Groups": E.master_score_group(master),
        "exposure_Metro": A.metro_weighted(occ, inputs["metro_emp"], inputs["metro_dim"], A.EXPOSURE_SCORES),
        "exposure_Industry": E.sector_from_means(occ, inputs["staffing_wide"]),
        "automation_mean_score_occupation": A.automation_mean_sd(tasks),
        "automation_category_occupation": A.wide_from_counts(counts),
        "automation_Metro": A.metro_weighted(A.weighted_from_counts(counts), inputs["metro_emp"], inputs["metro_dim"], A.CATEGORY_COLS),
    }


def publish_all(inputs: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                sheets: list[str] | None = None) -> dict[str, str]:
    """Write every (or the listed) published table, all in one commit; returns sheet -> path.

    ``sinks.read_table`` gives a sheet's current version; if one sheet fails, all keep their old one."""
    tables = published_tables(inputs)
    return write_tables({n: tables[n] for n in sheets or list(tables)}, out_dir, fmt=fmt)
