"""Task -> AI-impact category -> occupation shares, and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.functions import codes
from taskshift.functions.bands import (AI_CATEGORIES, AUGMENTED, AUTOMATED, MINIMAL, ai_category,
                                       demographic_type, task_weight)
from taskshift.functions.columns import by_position, cols_containing, display_demographic, display_stem
from taskshift.functions.nulls import (mean_skip, mean_strict, safe_div, sd_strict, sum_strict, to_number, wmean)
from taskshift.operators.audit import Audit
from taskshift.operators.joins import join_null_safe, with_major_group
from taskshift.operators.ordering import global_row_number, rank_within, stacked_midpoint
from taskshift.operators.reshape import to_long
from taskshift.operators.shares import attach_group_stats, share_within
from taskshift.operators.stats import box_summary, category_order, density_grid, histogram
from taskshift.session import cut_lineage
from taskshift.sources.lookups import SECTORS

EXPOSURE_SCORES = ["mean_rating_human_alpha", "mean_rating_human_beta", "mean_rating_human_gamma",
                   "gpt4_rubric1_alpha", "gpt4_rubric1_beta", "gpt4_rubric1_gamma"]
ALL_SCORES = EXPOSURE_SCORES + ["gpt4_rubric2_beta", "gpt4_automation"]

STEMS = {MINIMAL: "minimal_impact", AUGMENTED: "more_likely_augmented", AUTOMATED: "more_likely_automated"}
CATEGORY_COLS = [STEMS[c] for c in AI_CATEGORIES]
IMPACT_COLS = [STEMS[AUGMENTED], STEMS[AUTOMATED]]   # the non-minimal categories
OCC_KEYS = ["occ_group", "soc_code", "title"]


# -- Q26 ---------------------------------------------------------------------

def classify_tasks(tasks: DataFrame, task_statements: DataFrame,
                   automation_threshold: float = 0.5, augmentation_threshold: float = 1.0, audit: Audit | None = None) -> DataFrame:
    """Attach the task type (left join on code, id and wording; missing keys
    match each other), the AI-impact category and the task weight. Unmatched
    tasks keep a missing type (weight 1)."""
    st = task_statements.select("soc_code", "task_id", "task", "task_type")
    keys = ["soc_code", "task_id", "task"]
    j = audit.join(tasks, st, keys, "left", "task statements", null_safe=True) if audit else join_null_safe(tasks, st, keys, "left")
    return (j.select("soc_code", "title", "task",
                     ai_category("gpt4_automation", "gpt4_rubric1_gamma",
                                 automation_threshold, augmentation_threshold).alias("ai_cat"),
                     "task_type")
            .withColumn("task_weights", task_weight("task_type")))


def task_category(tasks: DataFrame, task_statements: DataFrame) -> DataFrame:
    """Task-level categories, sorted by title then category. Code and wording
    end the order, so that one title's rows are split over several ranges."""
    return classify_tasks(tasks, task_statements).orderBy(
        *[F.col(c).asc_nulls_last() for c in ("title", "ai_cat", "soc_code", "task")])


# -- Q27 / Q29 ---------------------------------------------------------------

def category_count_aggregate(classified: DataFrame) -> DataFrame:
    """(code, title) rows with the task count and weighted count of each
    category: one aggregation (map-side partial, one shuffle on the
    occupation keys) instead of a count per category followed by a window.
    Works unchanged on a streaming frame (see streaming/)."""
    agg = []
    for c in AI_CATEGORIES:
        hit = F.col("ai_cat") == F.lit(c)
        agg.append(F.count(F.when(hit, 1)).alias(f"n_{STEMS[c]}"))
        agg.append(F.sum(F.when(hit, F.col("task_weights"))).alias(f"w_{STEMS[c]}"))
    return classified.groupBy("soc_code", "title").agg(*agg)


def with_category_totals(counts: DataFrame) -> DataFrame:
    """Add per-occupation totals and the major group to category counts."""
    n_all = sum((F.col(f"n_{s}") for s in CATEGORY_COLS), F.lit(0))
    w_all = sum((F.coalesce(F.col(f"w_{s}"), F.lit(0.0)) for s in CATEGORY_COLS), F.lit(0.0))
    return with_major_group(counts.withColumn("n_total", n_all).withColumn("w_total", w_all), "soc_code")


def occ_category_counts(classified: DataFrame) -> DataFrame:
    """One row per occupation with task count and weighted count per category."""
    return with_category_totals(category_count_aggregate(classified))


def share_from_counts(wide: DataFrame) -> DataFrame:
    """Long (occupation, category) shares from ``occ_category_counts`` rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("ai_cat"), F.col(f"n_{STEMS[c]}").alias("n"),
                               F.col(f"w_{STEMS[c]}").alias("n_weighted")) for c in AI_CATEGORIES])
    long = wide.select(*OCC_KEYS, "n_total", "w_total", F.inline(cells)).where(F.col("n") > 0)
    return long.select(*OCC_KEYS, "ai_cat", "n", "n_weighted",
                       safe_div("n", "n_total").alias("pct_tasks"),
                       safe_div("n_weighted", "w_total").alias("pct_weighted"))


def occ_category_share(classified: DataFrame) -> DataFrame:
    """(occupation, category) rows: n, n_weighted, pct_tasks, pct_weighted.
    Shares are within the occupation; absent categories have no row."""
    return share_from_counts(occ_category_counts(classified))


def occ_category_wide(classified: DataFrame) -> DataFrame:
    """Occupation rows with the categories' plain and weighted shares and the
    group's mean automated share, from classified tasks."""
    return wide_from_counts(occ_category_counts(classified))


def wide_from_counts(wide: DataFrame) -> DataFrame:
    """Occupation rows with ``pct_tasks_*`` and ``pct_weighted_*`` per category
    (missing where the occupation has no task of it) plus the occupation
    group's mean automated share (plain and weighted, missing values skipped)."""
    cols = []
    for s in CATEGORY_COLS:
        present = F.col(f"n_{s}") > 0
        cols.append(F.when(present, safe_div(f"n_{s}", "n_total")).alias(f"pct_tasks_{s}"))
    for s in CATEGORY_COLS:
        present = F.col(f"n_{s}") > 0
        cols.append(F.when(present, safe_div(f"w_{s}", "w_total")).alias(f"pct_weighted_{s}"))
    occ = wide.select(*OCC_KEYS, *cols)
    return attach_group_stats(occ, ["occ_group"], [
        mean_skip(f"pct_tasks_{STEMS[AUTOMATED]}").alias("mean_automated"),
        mean_skip(f"pct_weighted_{STEMS[AUTOMATED]}").alias("mean_automated_weighted")], bounded_groups=True)


def occ_weighted_shares(classified: DataFrame) -> DataFrame:
    """Occupation rows with the weighted share of each category (missing when absent)."""
    return weighted_from_counts(occ_category_counts(classified))


def weighted_from_counts(wide: DataFrame) -> DataFrame:
    """The weighted shares from ``occ_category_counts`` rows."""
    return wide.select(*OCC_KEYS, *[F.when(F.col(f"n_{s}") > 0, safe_div(f"w_{s}", "w_total")).alias(s) for s in CATEGORY_COLS])


# -- Q28 / Q30 ---------------------------------------------------------------

def category_by_task_type(classified: DataFrame) -> DataFrame:
    """Share of each category within each task type, with the stacked label position."""
    g = classified.groupBy("task_type", "ai_cat").agg(F.count(F.lit(1)).alias("n"))
    g = share_within(g, ["task_type"], "n", "pct")
    return stacked_midpoint(g, ["task_type"], [("ai_cat", False, True)], "pct", "label_pos")


def occ_automation_rank(classified: DataFrame) -> DataFrame:
    """Occupations ranked by weighted automated share (descending, missing last;
    ties broken by code then title). Distributed rank, no single-partition sort."""
    col = f"pct_weighted_{STEMS[AUTOMATED]}"
    w = occ_weighted_shares(classified).withColumnRenamed(STEMS[AUTOMATED], col)
    ranked = global_row_number(w.select("soc_code", "title", col),
                               [(col, False, True), ("soc_code", True, True), ("title", True, True)], "rank")
    return ranked.select("soc_code", "title", col, "rank")


# -- Q31-Q36 -----------------------------------------------------------------

def share_density(share: DataFrame) -> DataFrame:
    """Kernel density of the weighted category share, per category."""
    return density_grid(share, "ai_cat", "pct_weighted", bounded_facets=True, limits=(0.0, 1.0))


def share_histogram(share: DataFrame, bins: int = 30) -> DataFrame:
    """30-bin histogram of the weighted category share, per category, one shared range."""
    return histogram(share, ["ai_cat"], "pct_weighted", bins)


def share_rank_in_facet(share: DataFrame) -> DataFrame:
    """Mean task share per (category, group) and each group's rank inside its
    category facet (ascending mean, missing last, ties by group name)."""
    means = share.groupBy("ai_cat", "occ_group").agg(mean_strict("pct_tasks").alias("mean_value"))
    return rank_within(means, ["ai_cat"], [("mean_value", True, True), ("occ_group", True, True)],
                       "rank_in_facet")


def share_box_by_group(share: DataFrame) -> DataFrame:
    """Box statistics of the task share per (category, group), with each
    group's order inside its category facet (by mean share)."""
    share = cut_lineage(share)   # read by the box statistics and by the facet order
    box = box_summary(share, ["ai_cat", "occ_group"], "pct_tasks", bounded_groups=True)
    means = share_rank_in_facet(share)
    return join_null_safe(box, means, ["ai_cat", "occ_group"], "left", broadcast_right=True)


def _box_by_group(classified: DataFrame, stem: str) -> DataFrame:
    w = cut_lineage(occ_category_wide(classified))   # read by the box statistics and by the order
    col = f"pct_weighted_{stem}"
    box = box_summary(w, ["occ_group"], col, bounded_groups=True)
    order = category_order(w.withColumn("__m", F.col(col)), "occ_group", "__m", mean_skip, "group_order")
    return join_null_safe(box, order.withColumnRenamed("order_value", "group_mean"), ["occ_group"], "left",
                          broadcast_right=True)


def automated_box_by_group(classified: DataFrame) -> DataFrame:
    """Box statistics of the weighted automated share per group, with the groups' order."""
    return _box_by_group(classified, STEMS[AUTOMATED])


def augmented_box_by_group(classified: DataFrame) -> DataFrame:
    """Box statistics of the weighted augmented share per group, with the groups' order."""
    return _box_by_group(classified, STEMS[AUGMENTED])


def group_category_wide(share: DataFrame) -> DataFrame:
    """Mean task share per group, one column per category (missing when absent)."""
    return share.groupBy("occ_group").agg(*[
        F.avg(F.when(F.col("ai_cat") == c, F.col("pct_tasks"))).alias(STEMS[c]) for c in AI_CATEGORIES])


# -- Q37-Q41 -----------------------------------------------------------------

def _impact_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Non-minimal category columns as rows, named by the categories' own labels."""
    return to_long(wide, ids, IMPACT_COLS).withColumn("name", display_stem("name"))


def category_by_demographic(classified: DataFrame, us_emp: DataFrame) -> DataFrame:
    """Weighted category shares per demographic (weight: the group's share of an occupation's jobs), long, non-minimal categories."""
    w = occ_weighted_shares(classified).withColumn("soc", codes.soc6("soc_code"))
    j = w.join(us_emp, "soc")
    demo_cols = cols_containing(us_emp, "current_year")
    metrics = ["avg_hourly_earnings"] + CATEGORY_COLS
    long = to_long(j.select(*demo_cols, "jobs", *metrics), ["jobs", *metrics], demo_cols, "demo", "value")
    long = (long.withColumn("demo", codes.suffix_from("demo", 14))
            .withColumn("type", demographic_type("demo")))
    wt = safe_div("value", "jobs")
    g = long.groupBy("type", "demo").agg(*[wmean(c, wt).alias(c) for c in metrics])
    g = g.withColumn("demo", display_demographic("demo"))
    return _impact_long(g.select("type", "demo", "avg_hourly_earnings", *IMPACT_COLS), ["type", "demo", "avg_hourly_earnings"])


def staffing_by_sector(staffing_wide: DataFrame) -> DataFrame:
    """Staffing jobs summed to (occupation, sector) before any join; a missing
    cell makes its (occupation, sector) total missing, as it would make any
    weighted mean that uses it missing.

    The sector of an industry column is known from its name, so each row of
    the wide matrix is folded to its sectors in place: one sum per sector, and
    a row per sector instead of one per industry."""
    label = staffing_wide.columns[0]
    by_sector: dict[str, list[str]] = {}
    for c in by_position(staffing_wide, 3):
        by_sector.setdefault(codes.fold_sector(c), []).append(c)
    cells = []
    for code, _, short_name in SECTORS:
        cols = by_sector.get(code)
        if cols:
            total = reduce(lambda a, b: a + b, [to_number(F.col(f"`{c}`")) for c in cols])
            cells.append(F.struct(F.lit(code).alias("naics2_code"), F.lit(short_name).alias("naics_short_name"), total.alias("jobs")))
    body = staffing_wide.where(F.col(label) != "SOC")
    if not cells:
        return body.select(F.col(label).alias("occupation"), F.lit("").alias("naics2_code"), F.lit("").alias("naics_short_name"),
                           F.lit(None).cast("double").alias("jobs")).limit(0)
    s = body.select(F.col(label).alias("occupation"), F.inline(F.array(*cells)))
    return s.groupBy("occupation", "naics2_code", "naics_short_name").agg(sum_strict("jobs").alias("jobs"))


def category_by_sector(classified: DataFrame, staffing_wide: DataFrame) -> DataFrame:
    """Weighted category shares per industry sector (weight: staffing jobs), long, non-minimal categories."""
    w = occ_weighted_shares(classified).withColumn("occupation", codes.soc6("soc_code"))
    j = w.join(staffing_by_sector(staffing_wide), "occupation")
    g = j.groupBy("naics2_code", "naics_short_name").agg(*[wmean(c, "jobs").alias(c) for c in IMPACT_COLS])
    return _impact_long(g, ["naics2_code", "naics_short_name"])


def _code_text(c) -> F.Column:
    """Numeric id -> text without a decimal part (``35620`` not ``35620.0``)."""
    return F.col(c).cast("bigint").cast("string")


def metro_weighted(occ: DataFrame, metro_emp: DataFrame, metro_dim: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metro: means of ``metrics`` over detailed occupations x metro rows,
    weighted by metro jobs, and the jobs.

    Reduced in three steps instead of joining everything first: sums and
    counts per 6-digit SOC, their weighted sums per area (partial sums before
    the shuffle), and only those few rows meet the metro dimension. A missing
    weight on a row with a value makes the mean missing, as in ``wmean``."""
    w, here = F.col("jobs"), F.col("jobs").isNotNull()
    soc = occ.groupBy(codes.soc6("soc_code").alias("occupation")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"s__{c}") for c in metrics], *[F.count(c).alias(f"n__{c}") for c in metrics])
    j = soc.join(metro_emp.select("occupation", "area", "jobs"), "occupation")
    sums = []
    for c in metrics:
        n = F.col(f"n__{c}")
        sums += [F.sum(F.when(w != 0, F.col(f"s__{c}") * w)).alias(f"num__{c}"), F.sum(F.when(n > 0, n * w)).alias(f"den__{c}"),
                 F.coalesce(F.bool_or((n > 0) & ~here), F.lit(False)).alias(f"bad__{c}")]
    by_area = j.groupBy(_code_text("area").alias("cbsa_code")).agg(*sums, F.coalesce(F.sum(F.col("rows") * w), F.lit(0.0)).alias("jobs"))
    # a repeated dimension row repeats the metro's rows: means stay, jobs add up
    dim = metro_dim.groupBy(_code_text("cbsa").alias("cbsa_code"), "cbsa_name", "size_class").agg(F.count(F.lit(1)).alias("__k"))
    means = [F.when(~F.col(f"bad__{c}"), F.try_divide(f"num__{c}", f"den__{c}")).alias(c) for c in metrics]
    return by_area.join(dim, "cbsa_code").select("cbsa_code", "cbsa_name", "size_class", *means, (F.col("jobs") * F.col("__k")).alias("jobs"))


def category_by_metro(classified: DataFrame, metro_emp: DataFrame, metro_dim: DataFrame) -> DataFrame:
    """Weighted category shares per metro (weight: metro jobs) and the metro's jobs."""
    return metro_weighted(occ_weighted_shares(classified), metro_emp, metro_dim, CATEGORY_COLS)


def category_by_metro_size(by_metro: DataFrame) -> DataFrame:
    """Metro category shares rolled up to size class (weighted by metro jobs), long."""
    g = by_metro.where(F.col("size_class").isNotNull()).groupBy("size_class").agg(
        *[wmean(c, "jobs").alias(c) for c in IMPACT_COLS])
    return _impact_long(g, ["size_class"])


def category_map_long(by_metro: DataFrame, geography: DataFrame) -> DataFrame:
    """Metro category shares, long, joined to the geography dimension for mapping."""
    m = by_metro.withColumnRenamed("cbsa_code", "geoid")
    long = _impact_long(m.select("geoid", "cbsa_name", "size_class", "jobs", *IMPACT_COLS), ["geoid", "cbsa_name", "size_class", "jobs"])
    return long.join(geography, "geoid")


# -- Q42-Q47 -----------------------------------------------------------------

def score_disagreement(tasks: DataFrame) -> DataFrame:
    """Tasks rated fully automatable by the model but not exposed by either gamma rating."""
    return tasks.where((F.col("gpt4_automation") == 1) & (F.col("gpt4_rubric1_gamma") == 0)
                       & (F.col("mean_rating_human_gamma") == 0))


def _occ_mean_sd_wide(tasks: DataFrame, scores) -> DataFrame:
    aggs = []
    for s in scores:
        aggs += [mean_strict(s).alias(f"m__{s}"), sd_strict(s).alias(f"s__{s}")]
    g = tasks.groupBy("soc_code", "title").agg(*aggs)
    return with_major_group(g, "soc_code")


def score_mean_sd(tasks: DataFrame, scores=None) -> DataFrame:
    """Mean and sd of each score per occupation (missing-propagating), long.

    Aggregated wide first (one shuffle of partial aggregates), then
    unpivoted: the 8x row expansion happens on occupation rows, not tasks."""
    scores = list(scores or ALL_SCORES)
    w = _occ_mean_sd_wide(tasks, scores)
    cells = F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"m__{s}").alias("mean_rating"),
                               F.col(f"s__{s}").alias("sd_rating")) for s in scores])
    return w.select(*OCC_KEYS, F.inline(cells))


def automation_mean_sd(tasks: DataFrame) -> DataFrame:
    """Mean and sd of the automation score per occupation (missing-propagating)."""
    w = _occ_mean_sd_wide(tasks, ["gpt4_automation"])
    return w.select(*OCC_KEYS, F.col("m__gpt4_automation").alias("mean_rating"),
                    F.col("s__gpt4_automation").alias("sd_rating"))


def automation_rows(tasks: DataFrame) -> DataFrame:
    """The automation rows of ``score_mean_sd`` (filter applied before the unpivot)."""
    return score_mean_sd(tasks, ["gpt4_automation"])


def score_mean_wide(tasks: DataFrame) -> DataFrame:
    """Mean of every score per occupation, one column per score (missing-propagating)."""
    g = tasks.groupBy("soc_code", "title").agg(*[mean_strict(s).alias(s) for s in ALL_SCORES])
    return with_major_group(g, "soc_code").select(*OCC_KEYS, *ALL_SCORES)


def group_score_mean_sd(tasks: DataFrame, score: str = "gpt4_automation") -> DataFrame:
    """Mean and sd of one score per occupation group (missing-propagating)."""
    g = with_major_group(tasks.select("soc_code", score), "soc_code").groupBy("occ_group").agg(
        mean_strict(score).alias("mean_rating"), sd_strict(score).alias("sd_rating"))
    return g.select("occ_group", F.lit(score).alias("name"), "mean_rating", "sd_rating")
