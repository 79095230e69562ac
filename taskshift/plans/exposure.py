"""Exposure scores -> occupations -> employment, wage, education, training,
demographic, sector and metro roll-ups; plus the published master tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.functions import codes
from taskshift.functions.bands import (TRAINING_ORDER, at_least, demographic_type, education_band,
                                       has_exposure, interval_bin, level_order, training_band, wage_band)
from taskshift.functions.columns import by_position, cols_containing, display_demographic, front, numeric_cols
from taskshift.functions.labels import percent_label
from taskshift.functions.nulls import mean_skip, mean_strict, safe_div, sum_strict, to_number, wmean
from taskshift.operators import audit as steps
from taskshift.operators import sketches
from taskshift.operators.audit import Audit
from taskshift.operators.joins import join_null_safe, join_report, with_major_group
from taskshift.operators.reshape import split_last, to_long, very_wide_to_long
from taskshift.operators.shares import threshold_summary
from taskshift.operators.stats import (box_summary, category_order, linear_trend, profile,
                                       weighted_quantiles)
from taskshift.operators.weighted_sketch import quantiles_from_sketch, weighted_sketch
from taskshift.session import checkpoint_dir, cut_lineage
from taskshift.functions.bands import AI_CATEGORIES
from taskshift.plans.automation import (ALL_SCORES, CATEGORY_COLS, EXPOSURE_SCORES, STEMS, metro_weighted,
                                        classify_tasks, occ_category_share, staffing_by_sector)
from taskshift.sources.readers import read_task_statements
from taskshift.sources.reports import failed_cells
from taskshift.sources.sinks import write_table

WAGE = "avg_hourly_earnings"


# -- Q1-Q3 -------------------------------------------------------------------

def table_profile(tasks: DataFrame) -> DataFrame:
    """Column profile of a table."""
    return profile(tasks)


def table_profile_sketch(tasks: DataFrame) -> DataFrame:
    """Column profile of a table from one scan, with stated errors (operators/sketches.py)."""
    return sketches.profile_sketch(tasks)


def profile_sketch_audit(tasks: DataFrame) -> DataFrame:
    """Whether the sketch profile of a table, made in parts and merged, is within its stated errors."""
    return sketches.sketch_audit(tasks)


def occ_task(tasks: DataFrame) -> DataFrame:
    """Task rows (id dropped) with their major group attached."""
    return with_major_group(tasks.drop("task_id"), "soc_code")


def occ_mean_scores(tasks: DataFrame) -> DataFrame:
    """Mean of every numeric score per detailed occupation (missing skipped).

    Aggregated on (code, title) first; the group lookup (a function of the
    code) is attached to the aggregated rows."""
    t = tasks.drop("task_id")
    scores = numeric_cols(t)
    g = t.groupBy("soc_code", "title").agg(*[mean_skip(c).alias(c) for c in scores])
    return with_major_group(g, "soc_code").select("occ_group", "short_name", "soc_code", "title", *scores)


# -- Q4 ----------------------------------------------------------------------

def exposure_box_by_score(tasks: DataFrame) -> DataFrame:
    """Box statistics of each exposure score per (group, score family, type),
    with the groups' chart order (mean over all of a group's values)."""
    occ = cut_lineage(occ_mean_scores(tasks).drop("gpt4_automation"))   # two consumers below
    vals = [c for c in numeric_cols(occ)]
    long = to_long(occ.select("occ_group", *vals), ["occ_group"], vals, "name", "value")
    fam, typ = split_last("name")
    long = long.select("occ_group", fam.alias("name"), typ.alias("type"), "value")
    box = box_summary(long, ["occ_group", "name", "type"], "value", bounded_groups=True)
    order = category_order(long, "occ_group", "value", mean_strict, "group_order")
    return join_null_safe(box, order.withColumnRenamed("order_value", "group_mean"), ["occ_group"], "left",
                          broadcast_right=True)


# -- Q5 ----------------------------------------------------------------------

def group_weighted_scores(tasks: DataFrame, us_emp: DataFrame) -> DataFrame:
    """Group wage and exposure weighted by jobs, over detailed occupations
    (jobs repeat once per detailed code sharing a SOC, as in the source)."""
    occ = occ_mean_scores(tasks).withColumn("soc", codes.soc6("soc_code"))
    j = occ.join(us_emp.select("soc", "jobs", WAGE), "soc")
    metrics = [WAGE] + EXPOSURE_SCORES
    return j.groupBy("short_name").agg(*[wmean(c, "jobs").alias(c) for c in metrics],
                                       sum_strict("jobs").alias("jobs"))


# -- Q6 ----------------------------------------------------------------------

def soc_scores_employment(tasks: DataFrame, us_emp: DataFrame, audit: Audit | None = None) -> DataFrame:
    """Scores averaged to the 6-digit SOC (teacher codes collapsed) *before*
    the employment join, so jobs count once per SOC."""
    t = tasks.select(codes.soc6_collapsed("soc_code").alias("soc"), *ALL_SCORES,
                     has_exposure("gpt4_rubric1_beta").alias("has_exposure"))
    metrics = ALL_SCORES + ["has_exposure"]
    g = steps.into(audit, t, "mean per SOC").groupBy("soc").agg(*[mean_skip(c).alias(c) for c in metrics])
    return steps.join_step(audit, steps.out(audit, g, "mean per SOC"), us_emp, ["soc"], "inner", "national employment")


# -- Q7-Q9 -------------------------------------------------------------------

def threshold_job_share(score_emp: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Occupations and jobs on each side of a beta cutoff (0.5), with shares of the totals."""
    return threshold_summary(score_emp, at_least("gpt4_rubric1_beta", cutoff), "cutoff",
                             {"jobs": "jobs"}, "count", {"count": "pct_count", "jobs": "pct_jobs"})


def threshold_gender_share(score_emp: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """Occupations and male / female jobs on each side of a beta cutoff (0.1), with shares."""
    return threshold_summary(score_emp, at_least("gpt4_rubric1_beta", cutoff), "cutoff",
                             {"male_jobs": "current_year_males", "female_jobs": "current_year_females"},
                             "count", {"count": "pct_count", "male_jobs": "pct_male_jobs",
                                       "female_jobs": "pct_female_jobs"})


def large_exposed_occupations(score_emp: DataFrame, min_jobs: float = 1_000_000,
                              min_beta: float = 0.5) -> DataFrame:
    """Large occupations (jobs >= 1M) with rubric-2 beta >= 0.5, most exposed first."""
    f = score_emp.where((F.col("jobs") >= min_jobs) & (F.col("gpt4_rubric2_beta") >= min_beta))
    f = front(f, ["description", "jobs", "median_hourly_earnings", "has_exposure"])
    return f.orderBy(F.col("has_exposure").desc_nulls_last())


# -- Q10, Q11, Q15 -------------------------------------------------------------

def _with_group_jobs(score_emp: DataFrame, audit: Audit | None = None) -> DataFrame:
    return steps.where_step(audit, with_major_group(score_emp, "soc", audit), F.col("jobs").isNotNull(), "jobs known")


def group_points_ordered(score_emp: DataFrame) -> DataFrame:
    """SOC points by group, with the groups' order by mean beta."""
    s = cut_lineage(_with_group_jobs(score_emp).select("soc", "occ_group", "gpt4_rubric1_beta", "jobs"))
    order = category_order(s, "occ_group", "gpt4_rubric1_beta", mean_strict, "group_order")
    return join_null_safe(s, order.withColumnRenamed("order_value", "group_mean"), ["occ_group"], "left",
                          broadcast_right=True)


def group_beta_wage(score_emp: DataFrame, audit: Audit | None = None) -> DataFrame:
    """Jobs-weighted wage and beta exposure by occupation group."""
    s = steps.into(audit, _with_group_jobs(score_emp, audit), "mean per group")
    return s.groupBy("short_name").agg(wmean(WAGE, "jobs").alias(WAGE),
                                       wmean("gpt4_rubric1_beta", "jobs").alias("gpt4_rubric1_beta"))


def group_wage_table(score_emp: DataFrame) -> DataFrame:
    """Per group: jobs, jobs-weighted wage and beta, and beta's percent label
    (the table behind the wage/exposure chart)."""
    return _group_wage(score_emp).withColumn("beta_label", percent_label("gpt4_rubric1_beta"))


def _group_wage(score_emp: DataFrame) -> DataFrame:
    s = _with_group_jobs(score_emp)
    return s.groupBy("short_name").agg(sum_strict("jobs").alias("jobs"), wmean(WAGE, "jobs").alias(WAGE),
                                       wmean("gpt4_rubric1_beta", "jobs").alias("gpt4_rubric1_beta"))


def group_wage_trend(score_emp: DataFrame) -> DataFrame:
    """Least-squares line of group beta on group wage (one row)."""
    return linear_trend(_group_wage(score_emp), "gpt4_rubric1_beta", WAGE)


# -- Q12 ---------------------------------------------------------------------

def wage_quartile_bins(us_emp: DataFrame) -> DataFrame:
    """Jobs-weighted wage quartiles as right-closed bins (lowest value
    excluded), and the number of SOC rows in each bin (missing bin kept)."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    qs = weighted_quantiles(us_emp, WAGE, "jobs", probs, [f"b{i}" for i in range(len(probs))])
    # one row, materialized once: every reference to the breaks reads it
    qs = cut_lineage(qs.select(F.array(*[f"b{i}" for i in range(len(probs))]).alias("br")))
    br = qs.scalar()
    breaks = [F.element_at(br, i + 1) for i in range(len(probs))]
    binned = us_emp.select(interval_bin(WAGE, breaks).alias("earnings_bin"))
    g = binned.groupBy("earnings_bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select("earnings_bin", F.element_at(br, F.col("earnings_bin")).alias("lower"),
                    F.element_at(br, F.col("earnings_bin") + 1).alias("upper"), "n")


# -- Q13, Q14, Q16, Q17 ----------------------------------------------------------

def _band_scores(score_emp: DataFrame, band, name: str) -> DataFrame:
    s = score_emp.where(F.col("jobs").isNotNull()).withColumn(name, band)
    metrics = [WAGE] + EXPOSURE_SCORES
    return s.groupBy(name).agg(*[wmean(c, "jobs").alias(c) for c in metrics])


def wage_band_summary(score_emp: DataFrame) -> DataFrame:
    """Jobs-weighted wage and exposure scores per wage band."""
    return _band_scores(score_emp, wage_band(WAGE), "earnings_cat")


def wage_band_scores(score_emp: DataFrame) -> DataFrame:
    """Jobs-weighted exposure scores per wage band, long."""
    return to_long(wage_band_summary(score_emp), ["earnings_cat", WAGE], EXPOSURE_SCORES)


def education_band_scores(score_emp: DataFrame) -> DataFrame:
    """Jobs-weighted exposure scores per entry-education band, long."""
    g = _band_scores(score_emp, education_band("education"), "edu_cat")
    return to_long(g, ["edu_cat", WAGE], EXPOSURE_SCORES)


def training_band_scores(score_emp: DataFrame) -> DataFrame:
    """Jobs-weighted exposure scores per training band (with the band order), long."""
    g = _band_scores(score_emp, training_band("training"), "train_cat")
    g = g.withColumn("train_order", level_order("train_cat", TRAINING_ORDER))
    return to_long(g, ["train_cat", "train_order", WAGE], EXPOSURE_SCORES)


# -- Q18 ---------------------------------------------------------------------

def demographic_scores(score_emp: DataFrame) -> DataFrame:
    """Scores weighted by each demographic's share of an occupation's jobs."""
    s = score_emp.where(F.col("jobs").isNotNull())
    demo_cols = cols_containing(s, "current_year")
    metrics = [WAGE] + ALL_SCORES + ["has_exposure"]
    long = to_long(s.select(*demo_cols, "jobs", *metrics), ["jobs", *metrics], demo_cols, "demo", "value")
    long = (long.withColumn("demo", codes.suffix_from("demo", 14))
            .withColumn("type", demographic_type("demo")))
    wt = safe_div("value", "jobs")
    g = long.groupBy("type", "demo").agg(*[wmean(c, wt).alias(c) for c in metrics])
    return g.select("type", display_demographic("demo").alias("demo"), "has_exposure", "gpt4_rubric1_beta")


# -- Q19, Q20 ------------------------------------------------------------------

def staffing_long(staffing_wide: DataFrame) -> DataFrame:
    """Wide staffing matrix -> (occupation, naics6_code, jobs).

    The stray header row is dropped, every industry column (3rd onward) is
    unpivoted in one Generate, and text cells become numbers (NULL when not
    a number)."""
    label = staffing_wide.columns[0]
    industries = by_position(staffing_wide, 3)
    body = staffing_wide.where(F.col(label) != "SOC")
    long = very_wide_to_long(body, [label], industries, "naics6_code", "jobs_text")
    return long.select(F.col(label).alias("occupation"), "naics6_code",
                       to_number("jobs_text").alias("jobs"))


def sector_scores(tasks: DataFrame, staffing_wide: DataFrame) -> DataFrame:
    """Exposure by industry sector, weighted by staffing jobs.

    Staffing is summed to (occupation, sector) before the join, so the join
    carries sectors (20) instead of industries (hundreds) per occupation.
    The weighted mean is unchanged: sum_i x*w_i = x * sum_i w_i."""
    return sector_from_means(occ_mean_scores(tasks), staffing_wide)


def sector_from_means(occ: DataFrame, staffing_wide: DataFrame) -> DataFrame:
    """``sector_scores`` from the occupation means."""
    occ = occ.withColumn("occupation", codes.soc6("soc_code"))
    j = occ.join(staffing_by_sector(staffing_wide), "occupation")
    return j.groupBy("naics2_code", "naics_short_name").agg(*[wmean(c, "jobs").alias(c) for c in EXPOSURE_SCORES])


# -- Q21-Q23 -------------------------------------------------------------------

def metro_scores(tasks: DataFrame, metro_emp: DataFrame, metro_dim: DataFrame) -> DataFrame:
    """Exposure per metro weighted by metro jobs (detailed codes x metro rows), and the metro's jobs."""
    return metro_weighted(occ_mean_scores(tasks), metro_emp, metro_dim, EXPOSURE_SCORES)


def metro_size_scores(by_metro: DataFrame) -> DataFrame:
    """Two-level roll-up: metros (already weighted) -> size class, weighted by metro jobs."""
    g = by_metro.where(F.col("size_class").isNotNull()).groupBy("size_class").agg(
        *[wmean(c, "jobs").alias(c) for c in EXPOSURE_SCORES])
    return to_long(g, ["size_class"], EXPOSURE_SCORES)


def metro_map_table(by_metro: DataFrame, geography: DataFrame) -> DataFrame:
    """Metro exposure joined to the geography dimension for mapping."""
    return by_metro.withColumnRenamed("cbsa_code", "geoid").join(geography, "geoid")


# -- Q24, Q25 ------------------------------------------------------------------

def master_score(score_emp: DataFrame, classified: DataFrame) -> DataFrame:
    """SOC beta and jobs with the mean weighted share of each AI-impact
    category (absent category -> 0 inside the pivot; SOCs without any
    category row stay missing after the left join).

    The per-(SOC, category) mean and the pivot are one conditional aggregate
    keyed by SOC (one shuffle): for each category, the mean over that
    category's rows, missing-propagating, absent -> 0."""
    return master_from_share(score_emp, occ_category_share(classified))


def master_from_share(score_emp: DataFrame, share: DataFrame, audit: Audit | None = None) -> DataFrame:
    """``master_score`` from the occupation category shares."""
    s = steps.into(audit, share, "shares per SOC, wide").select(codes.soc6_collapsed("soc_code").alias("soc"), "ai_cat",
                     F.coalesce(F.col("pct_weighted"), F.lit(0.0)).alias("pct_weighted"))
    cells = []
    for c in AI_CATEGORIES:
        hit = F.col("ai_cat") == F.lit(c)
        x = F.when(hit, F.col("pct_weighted"))
        strict = F.when(F.count(F.when(hit, 1)) == F.count(x), F.avg(x))
        cells.append(F.coalesce(strict, F.lit(0.0)).alias(STEMS[c]))
    wide = steps.out(audit, s.groupBy("soc").agg(*cells), "shares per SOC, wide")
    base = score_emp.select("soc", "description", "jobs", "gpt4_rubric1_beta")
    return steps.join_step(audit, base, wide, ["soc"], "left", "category shares")


def master_score_group(master: DataFrame) -> DataFrame:
    """The master table rolled up to major groups (missing-propagating means, strict job sum)."""
    g = with_major_group(master, "soc")
    metrics = ["gpt4_rubric1_beta"] + CATEGORY_COLS
    return g.groupBy("occ_2", "occ_group").agg(*[mean_strict(c).alias(c) for c in metrics],
                                               sum_strict("jobs").alias("jobs"))


# -- J11 -----------------------------------------------------------------------

def employment_join_report(tasks: DataFrame, us_emp: DataFrame) -> DataFrame:
    """Row accounting of the detailed-occupation x national-employment join."""
    occ = occ_mean_scores(tasks).select(codes.soc6("soc_code").alias("soc"))
    return join_report(occ, us_emp.select("soc"), ["soc"])


def audit_group_beta_wage(tasks: DataFrame, us_emp: DataFrame) -> DataFrame:
    """Rows of every step of the wage and beta table, from the run that makes it."""
    audit = Audit()
    out = group_beta_wage(soc_scores_employment(tasks, us_emp, audit), audit)
    return steps.run_report(steps.out(audit, out, "mean per group"), audit)


def audit_master_score(tasks: DataFrame, task_statements: DataFrame, us_emp: DataFrame) -> DataFrame:
    """Rows of every step of the master table, from the run that makes it."""
    audit = Audit()
    score_emp = soc_scores_employment(tasks, us_emp, audit)
    classified = steps.into(audit, classify_tasks(tasks, task_statements, audit=audit), "category shares per occupation")
    share = steps.out(audit, occ_category_share(classified), "category shares per occupation")
    return steps.run_report(master_from_share(score_emp, share, audit), audit)


# -- failed cells ----------------------------------------------------------------

def staffing_failed_cells(staffing_wide: DataFrame) -> DataFrame:
    """Cells of the staffing matrix, as exported, that are not numbers: per industry column, how many and which."""
    found = failed_cells(staffing_wide, dict.fromkeys(staffing_wide.columns[2:], "double"))
    return found.withColumn("sample", F.array_join("sample", "; "))


# -- weighted quartiles from a summary --------------------------------------------

def wage_quartile_sketch_audit(us_emp: DataFrame, size: int = 200) -> DataFrame:
    """Whether the jobs-weighted wage quartiles of a bounded summary have the weighted ranks they stand for, within its stated error."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    clean = us_emp.where(F.col(WAGE).isNotNull() & (F.col("jobs") > 0))
    made = quantiles_from_sketch(weighted_sketch(us_emp, [], WAGE, "jobs", size), [], probs, [f"q{i}" for i in range(len(probs))])
    made = cut_lineage(made.select("levels", F.posexplode(F.array(*[f"q{i}" for i in range(len(probs))])).alias("i", "q")))     # one row per prob
    one = made.agg(F.collect_list(F.struct("i", "q", "levels")).alias("qs")).scalar()
    rows = clean.select(WAGE, "jobs", F.explode(one).alias("x"))
    below, upto = F.sum(F.when(F.col(WAGE) < F.col("x.q"), F.col("jobs"))), F.sum(F.when(F.col(WAGE) <= F.col("x.q"), F.col("jobs")))
    g = rows.groupBy(F.col("x.i").alias("i"), F.col("x.levels").alias("levels")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("jobs").alias("total"), F.coalesce(below, F.lit(0.0)).alias("below"), F.coalesce(upto, F.lit(0.0)).alias("upto"))
    p = F.get(F.array(*[F.lit(x) for x in probs]), F.col("i"))
    slack = F.col("total") * F.col("levels") / size + 1
    return g.select(p.alias("prob"), "n_rows", "total", ((F.col("below") - slack <= p * F.col("total")) & (p * F.col("total") <= F.col("upto") + slack)).alias("rank_ok"))


# -- delimited text, there and back -------------------------------------------------

def statements_round_trip(task_statements: DataFrame) -> DataFrame:
    """The task statements, written as delimited text by the sink and read again with a guessed delimiter."""
    spark = task_statements.sparkSession
    out = f"{checkpoint_dir(spark).rstrip('/')}/statements-{uuid.uuid4().hex}"
    path = write_table(task_statements, out, "task statements", fmt="csv", sep="|")
    return read_task_statements(spark, path, sep=None).select("soc_code", "task_id", "task", "task_type")
