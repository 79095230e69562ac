"""Result tables on a hand-made fixture with the edge rows of FIXTURES.md,
checked against values worked out by hand."""

import math

import pytest

from taskshift.plans import automation as A
from taskshift.plans import exposure as E

SCORE_COLS = ["mean_rating_human_alpha", "mean_rating_human_beta", "mean_rating_human_gamma",
              "gpt4_rubric1_alpha", "gpt4_rubric1_beta", "gpt4_rubric1_gamma", "gpt4_rubric2_beta",
              "gpt4_automation"]
TASK_SCHEMA = "soc_code string, task_id long, task string, title string, " + ", ".join(f"{c} double" for c in SCORE_COLS)


def _task(code, tid, task, title, beta, gamma, auto):
    # alpha/beta/gamma human and rubric2 fixed at simple values; the tested ones vary
    return (code, tid, task, title, 0.5, 0.5, 0.0, 1.0, beta, gamma, 0.5, auto)


@pytest.fixture(scope="module")
def fx(spark):
    tasks = spark.createDataFrame([
        _task("11-3031.00", 1, "plan budgets", "Financial Managers", 1.0, 1.0, 0.75),   # A automated
        _task("11-3031.00", 2, "review reports", "Financial Managers", 0.0, 1.0, 0.5),  # B augmented (0.5 not > 0.5)
        _task("11-3031.01", 3, "manage cash", "Treasurers", 0.5, 0.0, 0.25),            # C minimal
        _task("25-1011.00", 4, "teach classes", "Business Teachers", 0.5, 0.0, 1.0),    # D automated
        _task("25-1022.00", 5, "grade exams", "Math Teachers", None, None, None),       # E minimal, beta missing
        _task("55-1011.00", 6, "lead units", "Officers", 0.0, 0.0, 0.5),                # F minimal, no group row
    ], TASK_SCHEMA)
    statements = spark.createDataFrame([
        ("11-3031.00", 1, "plan budgets", "Core"),
        ("11-3031.00", 2, "review reports", "Supplemental"),
        ("25-1011.00", 4, "teach classes", "Core"),
        ("25-1022.00", 5, "grade exams.", "Core"),       # wording differs -> no match -> weight 1
        ("55-1011.00", 6, "lead units", "Supplemental"),
    ], "soc_code string, task_id long, task string, task_type string")
    us_emp = spark.createDataFrame([
        ("11-3031", "Financial managers", 100.0, 40.0, 38.0, "Bachelor's degree", "None", 40.0, 60.0),
        ("25-1099", "Postsecondary teachers", 300.0, 30.0, 29.0, "Doctoral or professional degree", "N/A", 150.0, 150.0),
        ("25-1011", "Business teachers", 50.0, 20.0, 19.0, "Master's degree", "Internship/residency", 25.0, 25.0),
        ("55-1011", "Officers", None, 17.0, 16.0, None, None, None, None),
    ], "soc string, description string, jobs double, avg_hourly_earnings double, median_hourly_earnings double, "
       "education string, training string, current_year_females double, current_year_males double")
    staffing = spark.createDataFrame([
        ("11-3031", "Financial managers", "10", "20", "5"),
        ("25-1011", "Business teachers", "0", "n/a", "1"),
        ("SOC", "Description", "Manufacturing", "Retail", "Unknown"),
    ], ["occupation_label", "description", "311111", "441111", "991111"])
    metro_emp = spark.createDataFrame([
        ("11-3031", 100, "Big metro", 10.0), ("25-1011", 100, "Big metro", 30.0),
        ("11-3031", 200, "Small metro", 5.0), ("55-1011", 300, "Unlisted metro", 7.0),
    ], "occupation string, area long, area_name string, jobs double")
    metro_dim = spark.createDataFrame([(100, "Big", "Large"), (200, "Small", None)],
                                      "cbsa long, cbsa_name string, size_class string")
    classified = A.classify_tasks(tasks, statements)
    return dict(tasks=tasks, statements=statements, us_emp=us_emp, staffing=staffing, metro_emp=metro_emp,
                metro_dim=metro_dim, classified=classified, score_emp=E.soc_scores_employment(tasks, us_emp))


def test_score_emp_collapse_and_preaggregate(fx):
    r = {x["soc"]: x for x in fx["score_emp"].collect()}
    assert set(r) == {"11-3031", "25-1099", "55-1011"}           # 25-1011 is not reached by collapsed codes
    assert r["11-3031"]["gpt4_rubric1_beta"] == 0.5
    assert math.isclose(r["11-3031"]["has_exposure"], 2 / 3)
    assert r["25-1099"]["gpt4_rubric1_beta"] == 0.5              # missing beta skipped
    assert r["25-1099"]["has_exposure"] == 1.0                    # missing flag skipped
    assert r["25-1099"]["jobs"] == 300.0


def test_threshold_job_share(fx):
    r = {x["cutoff"]: x for x in E.threshold_job_share(fx["score_emp"]).collect()}
    assert r[True]["count"] == 2 and r[True]["jobs"] == 400.0 and r[False]["jobs"] == 0.0
    assert math.isclose(r[True]["pct_count"], 2 / 3) and r[True]["pct_jobs"] == 1.0


def test_group_weighted_scores_fanout_and_null_weight(fx):
    r = {x["short_name"]: x for x in E.group_weighted_scores(fx["tasks"], fx["us_emp"]).collect()}
    assert r["Management"]["gpt4_rubric1_beta"] == 0.5
    assert r["Management"]["jobs"] == 200.0                      # jobs repeat per detailed code
    assert r["Education and Library"]["jobs"] == 50.0            # 25-1011 plain roll-up
    assert r[None]["gpt4_rubric1_beta"] is None                   # 55-: missing jobs on a kept row
    assert r[None]["jobs"] is None


def test_group_beta_wage(fx):
    r = {x["short_name"]: x for x in E.group_beta_wage(fx["score_emp"]).collect()}
    assert r["Management"]["avg_hourly_earnings"] == 40.0
    assert r["Education and Library"]["gpt4_rubric1_beta"] == 0.5
    assert None not in r                                          # 55- row has no jobs: filtered out


def test_task_category(fx):
    r = {x["task"]: x for x in fx["classified"].collect()}
    assert r["plan budgets"]["ai_cat"] == "more likely automated" and r["plan budgets"]["task_weights"] == 2.0
    assert r["review reports"]["ai_cat"] == "more likely augmented" and r["review reports"]["task_weights"] == 0.5
    assert r["manage cash"]["task_type"] is None and r["manage cash"]["task_weights"] == 1.0
    assert r["grade exams"]["task_type"] is None and r["grade exams"]["ai_cat"] == "minimal impact"
    assert r["lead units"]["ai_cat"] == "minimal impact"


def test_occ_category_share_and_wide(fx):
    share = {(x["soc_code"], x["ai_cat"]): x for x in A.occ_category_share(fx["classified"]).collect()}
    a = share[("11-3031.00", "more likely automated")]
    assert (a["n"], a["n_weighted"], a["pct_tasks"], a["pct_weighted"]) == (1, 2.0, 0.5, 0.8)
    assert ("11-3031.00", "minimal impact") not in share          # absent category: no row
    assert share[("55-1011.00", "minimal impact")]["occ_group"] is None
    wide = {x["soc_code"]: x for x in A.occ_category_wide(fx["classified"]).collect()}
    m = wide["11-3031.00"]
    assert m["pct_weighted_more_likely_automated"] == 0.8 and m["pct_weighted_minimal_impact"] is None
    assert m["mean_automated"] == 0.5 and m["mean_automated_weighted"] == 0.8   # .01 has none: skipped
    assert wide["11-3031.01"]["mean_automated"] == 0.5


def test_rank(fx):
    r = {x["soc_code"]: x["rank"] for x in A.occ_automation_rank(fx["classified"]).collect()}
    assert r == {"25-1011.00": 1, "11-3031.00": 2, "11-3031.01": 3, "25-1022.00": 4, "55-1011.00": 5}


def test_master_score_fill_zero_inside_pivot(fx):
    m = {x["soc"]: x for x in E.master_score(fx["score_emp"], fx["classified"]).collect()}
    assert (m["11-3031"]["minimal_impact"], m["11-3031"]["more_likely_augmented"],
            m["11-3031"]["more_likely_automated"]) == (1.0, 0.2, 0.8)
    assert (m["25-1099"]["more_likely_augmented"], m["25-1099"]["more_likely_automated"]) == (0.0, 1.0)
    g = {x["occ_2"]: x for x in E.master_score_group(E.master_score(fx["score_emp"], fx["classified"])).collect()}
    assert g["11-0000"]["jobs"] == 100.0 and g["55-0000"]["occ_group"] is None and g["55-0000"]["jobs"] is None


def test_staffing_long_and_sector(fx):
    long = E.staffing_long(fx["staffing"])
    rows = {(x["occupation"], x["naics6_code"]): x["jobs"] for x in long.collect()}
    assert len(rows) == 6 and rows[("25-1011", "441111")] is None and rows[("11-3031", "311111")] == 10.0
    sec = {x["naics2_code"]: x for x in E.sector_scores(fx["tasks"], fx["staffing"]).collect()}
    assert set(sec) == {"31-33", "44-45"}                        # 99 has no sector: dropped
    assert sec["31-33"]["gpt4_rubric1_beta"] == 0.5               # zero weight adds nothing
    assert sec["44-45"]["gpt4_rubric1_beta"] is None              # non-numeric cell -> missing weight


def test_metro(fx):
    m = {x["cbsa_code"]: x for x in E.metro_scores(fx["tasks"], fx["metro_emp"], fx["metro_dim"]).collect()}
    assert set(m) == {"100", "200"}                              # 300 is absent from the dimension
    assert m["100"]["jobs"] == 50.0 and m["100"]["gpt4_rubric1_beta"] == 0.5
    assert m["200"]["size_class"] is None and m["200"]["jobs"] == 10.0
    size = E.metro_size_scores(E.metro_scores(fx["tasks"], fx["metro_emp"], fx["metro_dim"]))
    got = {(x["size_class"], x["name"]): x["value"] for x in size.collect()}
    assert got[("Large", "gpt4_rubric1_beta")] == 0.5 and len(got) == 6


def test_demographic_scores(fx):
    d = {x["demo"]: x for x in E.demographic_scores(fx["score_emp"]).collect()}
    # weights: share of each SOC's jobs held by the group (jobs filter drops the 55- row)
    # females: 11-3031 0.4, 25-1099 0.5 ; beta 0.5 both -> 0.5 ; has_exposure (2/3*0.4 + 1*0.5) / 0.9
    assert d["Females"]["type"] == "gender" and d["Females"]["gpt4_rubric1_beta"] == 0.5
    assert math.isclose(d["Females"]["has_exposure"], (2 / 3 * 0.4 + 0.5) / 0.9)


def test_wage_bands(fx):
    r = {x["earnings_cat"]: x for x in E.wage_band_summary(fx["score_emp"]).collect()}
    assert set(r) == {"37+", "23-37"}                             # 40 -> 37+, 30 -> 23-37; 55- row dropped (no jobs)


def test_score_mean_sd_strict(fx):
    r = {(x["soc_code"], x["name"]): x for x in A.score_mean_sd(fx["tasks"]).collect()}
    assert r[("11-3031.00", "gpt4_automation")]["mean_rating"] == 0.625
    assert math.isclose(r[("11-3031.00", "gpt4_automation")]["sd_rating"], math.sqrt(0.03125))
    assert r[("11-3031.01", "gpt4_automation")]["sd_rating"] is None   # one task
    assert r[("25-1022.00", "gpt4_automation")]["mean_rating"] is None  # missing value propagates


def test_join_report_counts(fx):
    r = E.employment_join_report(fx["tasks"], fx["us_emp"]).first()
    # detailed codes -> SOC: 11-3031 x2, 25-1011, 25-1022, 55-1011 ; us_emp has 4 SOCs
    assert r["left_rows"] == 5 and r["left_only_rows"] == 1 and r["right_only_rows"] == 1
    assert r["inner_rows"] == 4 and r["left_duplicate_keys"] == 1
