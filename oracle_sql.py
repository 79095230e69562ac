"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the DataFrame code: plain joins, GROUP BY and
window functions over the stand-in tables of ``taskshift.sources.standin``
(its SQL twin), in the most literal form of each rule (e.g. the sector
query joins industries un-aggregated, the rank uses one global
row_number). Double columns are rounded to 6 decimals, as the Spark side is.
"""

from __future__ import annotations

from taskshift.sources.lookups import OCC_GROUPS, SECTORS, values_sql
from taskshift.sources.standin import standin_sql

SCORES = ["mean_rating_human_alpha", "mean_rating_human_beta", "mean_rating_human_gamma",
          "gpt4_rubric1_alpha", "gpt4_rubric1_beta", "gpt4_rubric1_gamma",
          "gpt4_rubric2_beta", "gpt4_automation"]
EXPO = SCORES[:6]
CATS = [("minimal impact", "minimal_impact"), ("more likely augmented", "more_likely_augmented"),
        ("more likely automated", "more_likely_automated")]
IMPACT = ["more_likely_augmented", "more_likely_automated"]
DEMOS = ["females", "males", "white", "black"]
EMP_DOUBLES = ["jobs", "avg_hourly_earnings", "median_hourly_earnings", "current_year_females",
               "current_year_males", "current_year_white", "current_year_black"]


def wm(x: str, w: str) -> str:
    return (f"CASE WHEN coalesce(bool_or(({x}) IS NOT NULL AND ({w}) IS NULL), false) THEN NULL "
            f"ELSE sum(CASE WHEN ({x}) IS NOT NULL AND ({w}) <> 0 THEN ({x}) * ({w}) END) "
            f"/ nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN ({w}) END), 0) END")


def ms(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


def ss(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def sds(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN stddev_samp({x}) END"


def soc6(c: str) -> str:
    return f"left({c}, length({c}) - 3)"


def soc6c(c: str) -> str:
    return f"CASE WHEN starts_with({c}, '25-1') THEN '25-1099' ELSE {soc6(c)} END"


def grp(c: str) -> str:
    return f"substr({c}, 1, 2) || '-0000'"


def sector(c: str) -> str:
    two = f"substr({c}, 1, 2)"
    return (f"CASE WHEN {two} IN ('31', '32', '33') THEN '31-33' WHEN {two} IN ('44', '45') THEN '44-45' "
            f"WHEN {two} IN ('48', '49') THEN '48-49' WHEN {two} = '90' THEN '92' ELSE {two} END")


def unpivot(src: str, ids: list[str], cols: list[str], name="name", value="value") -> str:
    sel = ", ".join(ids)
    pre = f"{sel}, " if ids else ""
    return "\n    UNION ALL ".join(f"SELECT {pre}'{c}' AS {name}, {c} AS {value} FROM {src}" for c in cols)


def unpivot_impact(src: str, ids: list[str]) -> str:
    """The non-minimal categories as rows, under the categories' own labels."""
    pre = f"{', '.join(ids)}, "
    return "\n    UNION ALL ".join(f"SELECT {pre}'{label}' AS name, {stem} AS value FROM {src}" for label, stem in CATS[1:])


BASE = f"""{standin_sql()},
-- not a number is missing
tasks AS (SELECT * REPLACE ({', '.join(f"CASE WHEN NOT isnan({s}) THEN {s} END AS {s}" for s in SCORES)}) FROM tasks_given),
occ_groups AS (SELECT * FROM {values_sql(OCC_GROUPS, ['occ_2', 'occ_group', 'short_name'])}),
sectors AS (SELECT * FROM {values_sql(SECTORS, ['naics2_code', 'sector', 'naics_short_name'])}),
occ_mean AS (
    SELECT g.occ_group, g.short_name, a.*
    FROM (SELECT soc_code, title, {', '.join(f'avg({s}) AS {s}' for s in SCORES)}
          FROM tasks GROUP BY soc_code, title) a
    LEFT JOIN occ_groups g ON g.occ_2 = {grp('a.soc_code')}
),
score_emp AS (
    SELECT a.*, e.description, e.jobs, e.avg_hourly_earnings, e.median_hourly_earnings, e.education,
      e.training, e.current_year_females, e.current_year_males, e.current_year_white, e.current_year_black
    FROM (SELECT {soc6c('soc_code')} AS soc, {', '.join(f'avg({s}) AS {s}' for s in SCORES)},
            avg(CASE WHEN gpt4_rubric1_beta > 0 THEN CAST(1 AS DOUBLE)
                     WHEN NOT (gpt4_rubric1_beta > 0) THEN CAST(0 AS DOUBLE) END) AS has_exposure
          FROM tasks GROUP BY 1) a
    JOIN us_emp e ON e.soc = a.soc
),
classified AS (
    SELECT t.soc_code, t.title, t.task,
      CASE WHEN t.gpt4_automation > 0.5 THEN 'more likely automated'
           WHEN t.gpt4_rubric1_gamma = 1 THEN 'more likely augmented'
           ELSE 'minimal impact' END AS ai_cat,
      s.task_type,
      CASE WHEN s.task_type = 'Core' THEN CAST(2 AS DOUBLE) WHEN s.task_type = 'Supplemental' THEN CAST(0.5 AS DOUBLE)
           ELSE CAST(1 AS DOUBLE) END AS task_weights
    FROM tasks t LEFT JOIN task_statements s
      ON s.soc_code IS NOT DISTINCT FROM t.soc_code AND s.task_id IS NOT DISTINCT FROM t.task_id
        AND s.task IS NOT DISTINCT FROM t.task
),
share AS (
    SELECT g.occ_group, c.soc_code, c.title, c.ai_cat, c.n, c.n_weighted,
      c.n / sum(c.n) OVER (PARTITION BY c.soc_code, c.title) AS pct_tasks,
      c.n_weighted / sum(c.n_weighted) OVER (PARTITION BY c.soc_code, c.title) AS pct_weighted
    FROM (SELECT soc_code, title, ai_cat, count(*) AS n, sum(task_weights) AS n_weighted
          FROM classified GROUP BY 1, 2, 3) c
    LEFT JOIN occ_groups g ON g.occ_2 = {grp('c.soc_code')}
),
occ_wide AS (
    SELECT occ_group, soc_code, title,
      {', '.join(f"max(CASE WHEN ai_cat = '{c}' THEN pct_tasks END) AS pct_tasks_{s}" for c, s in CATS)},
      {', '.join(f"max(CASE WHEN ai_cat = '{c}' THEN pct_weighted END) AS pct_weighted_{s}" for c, s in CATS)}
    FROM share GROUP BY occ_group, soc_code, title
),
occ_w AS (
    SELECT occ_group, soc_code, title, {', '.join(f'pct_weighted_{s} AS {s}' for _, s in CATS)} FROM occ_wide
),
staffing_long AS (
    SELECT occupation, naics6_code, jobs, {sector('naics6_code')} AS naics2_code FROM staffing_long_src
),
metro_j AS (
    SELECT me.occupation, me.area, me.jobs, CAST(me.area AS VARCHAR) AS cbsa_code, d.cbsa_name, d.size_class
    FROM metro_emp me JOIN metro_dim d ON CAST(d.cbsa AS VARCHAR) = CAST(me.area AS VARCHAR)
),
msa AS (
    SELECT m.cbsa_code, m.cbsa_name, m.size_class, {', '.join(f'{wm("o." + s, "m.jobs")} AS {s}' for s in EXPO)},
      coalesce(sum(m.jobs), 0) AS jobs
    FROM occ_mean o JOIN metro_j m ON m.occupation = {soc6('o.soc_code')}
    GROUP BY 1, 2, 3
),
msa_cat AS (
    SELECT m.cbsa_code, m.cbsa_name, m.size_class, {', '.join(f'{wm("o." + s, "m.jobs")} AS {s}' for _, s in CATS)},
      coalesce(sum(m.jobs), 0) AS jobs
    FROM occ_w o JOIN metro_j m ON m.occupation = {soc6('o.soc_code')}
    GROUP BY 1, 2, 3
),
master AS (
    SELECT se.soc, se.description, se.jobs, se.gpt4_rubric1_beta,
      {', '.join(f'w.{s}' for _, s in CATS)}
    FROM score_emp se LEFT JOIN (
      SELECT soc, {', '.join(f"coalesce(max(CASE WHEN ai_cat = '{c}' THEN m END), 0) AS {s}" for c, s in CATS)}
      FROM (SELECT {soc6c('soc_code')} AS soc, ai_cat, {ms('coalesce(pct_weighted, 0)')} AS m
            FROM share GROUP BY 1, 2) per
      GROUP BY soc) w ON w.soc = se.soc
)"""


def q(ctes: str, final: str, doubles: list[str]) -> str:
    extra = f",\n{ctes}" if ctes.strip() else ""
    rep = ""
    if doubles:
        rep = " REPLACE (" + ", ".join(f"round({d}, 6) AS {d}" for d in doubles) + ")"
    return f"WITH {BASE}{extra},\n__final AS (\n{final}\n)\nSELECT *{rep} FROM __final"


def box_sql(src: str, keys: list[str], x: str) -> str:
    """Type-7 quartiles, 1.5 IQR whiskers and outlier count per group."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM f.{c}" for c in keys)
    fk = ", ".join(f"f.{c}" for c in keys)
    inside = f"s.{x} >= f.lf AND s.{x} <= f.hf"
    return f"""(SELECT {fk}, f.n,
        least(f.lower, min(CASE WHEN {inside} THEN s.{x} END)) AS ymin, f.lower, f.middle, f.upper,
        greatest(f.upper, max(CASE WHEN {inside} THEN s.{x} END)) AS ymax,
        count(CASE WHEN NOT ({inside}) THEN 1 END) AS n_outliers,
        f.middle - 1.58 * (f.upper - f.lower) / sqrt(CAST(f.n AS DOUBLE)) AS notchlower,
        f.middle + 1.58 * (f.upper - f.lower) / sqrt(CAST(f.n AS DOUBLE)) AS notchupper
      FROM (SELECT *, lower - 1.5 * (upper - lower) AS lf, upper + 1.5 * (upper - lower) AS hf
            FROM (SELECT {k}, count({x}) AS n, quantile_cont({x}, 0.25) AS lower,
                    quantile_cont({x}, 0.5) AS middle, quantile_cont({x}, 0.75) AS upper
                  FROM {src} WHERE {x} IS NOT NULL GROUP BY {k}) qq) f
      JOIN {src} s ON {on}
      WHERE s.{x} IS NOT NULL
      GROUP BY {fk}, f.n, f.lower, f.middle, f.upper)"""


BOX_D = ["ymin", "lower", "middle", "upper", "ymax", "notchlower", "notchupper"]
ORACLE: dict[str, str] = {}

# -- exposure ------------------------------------------------------------------

def _profile_sql(src: str, num: list[str], txt: list[str], times: list[str]) -> tuple[str, str]:
    """CTEs and final SELECT of a column profile."""
    union = lambda cols, cast: "\n    UNION ALL ".join(f"SELECT '{c}' AS skim_variable, {cast.format(c)} AS v FROM {src}" for c in cols)
    ctes = [f"tot AS (SELECT count(*) AS total FROM {src})"]
    rate = "count(*) - count(v) AS n_missing, (max(total) - (count(*) - count(v))) / max(total) AS complete_rate"
    stats, lens = "NULL AS mean, NULL AS sd, NULL AS p0, NULL AS p25, NULL AS p50, NULL AS p75, NULL AS p100", \
        "CAST(NULL AS BIGINT) AS min_len, CAST(NULL AS BIGINT) AS max_len, CAST(NULL AS BIGINT) AS n_empty, CAST(NULL AS BIGINT) AS n_whitespace"
    flags = "CAST(NULL AS BIGINT) AS n_true, CAST(NULL AS BIGINT) AS n_false"
    dates = "CAST(NULL AS VARCHAR) AS first_at, CAST(NULL AS VARCHAR) AS middle_at, CAST(NULL AS VARCHAR) AS last_at"
    parts = []
    none = "CAST(NULL AS VARCHAR)"
    if num:
        ctes.append(f"nl AS ({union(num, 'CAST({} AS DOUBLE)')})")
        ctes.append("""nb AS (SELECT skim_variable, CASE WHEN hi <= lo THEN 4 ELSE greatest(1, least(8, ceil((v - lo) / (hi - lo) * 8))) END AS bin
    FROM (SELECT *, min(v) OVER (PARTITION BY skim_variable) AS lo, max(v) OVER (PARTITION BY skim_variable) AS hi FROM nl WHERE v IS NOT NULL)),
nh AS (SELECT skim_variable AS hv, string_agg(substr('▁▂▃▅▆▇', greatest(1, (6 * c + most - 1) // most)::INTEGER, 1), '' ORDER BY k) AS hist
    FROM (SELECT *, max(c) OVER (PARTITION BY skim_variable) AS most FROM (SELECT n.skim_variable, k, count(b.bin) AS c
        FROM (SELECT DISTINCT skim_variable FROM nb) n CROSS JOIN range(1, 9) r(k) LEFT JOIN nb b ON b.skim_variable = n.skim_variable AND b.bin = k GROUP BY 1, 2)) GROUP BY 1)""")
        parts.append(f"""SELECT 'numeric' AS skim_type, skim_variable, {rate}, avg(v) AS mean, stddev_samp(v) AS sd,
      quantile_cont(v, 0.0) AS p0, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
      quantile_cont(v, 1.0) AS p100, CAST(NULL AS BIGINT) AS n_unique, {lens}, {flags}, {dates}, max(hist) AS hist, {none} AS top_counts
    FROM tot, nl LEFT JOIN nh ON hv = skim_variable GROUP BY skim_variable""")
    if txt:
        ctes.append(f"tl AS ({union(txt, '{}')})")
        ctes.append("""tt AS (SELECT skim_variable AS tv, string_agg(v || ': ' || c, ', ' ORDER BY c DESC, v) AS top FROM (SELECT skim_variable, v, count(*) AS c FROM tl
    WHERE v IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY skim_variable ORDER BY count(*) DESC, v) <= 4) GROUP BY 1)""")
        parts.append(f"""SELECT 'character' AS skim_type, skim_variable, {rate}, {stats}, count(DISTINCT v) AS n_unique,
      min(length(v)) AS min_len, max(length(v)) AS max_len, count(CASE WHEN v = '' THEN 1 END) AS n_empty,
      count(CASE WHEN regexp_full_match(v, '[ \t\n\r\f]+') THEN 1 END) AS n_whitespace, {flags}, {dates}, {none} AS hist, coalesce(max(top), '') AS top_counts
    FROM tot, tl LEFT JOIN tt ON tv = skim_variable GROUP BY skim_variable""")
    if times:
        ctes.append(f"dl AS ({union(times, '{}')})")
        at = "strftime({}, '%Y-%m-%d %H:%M:%S')"
        parts.append(f"""SELECT 'date' AS skim_type, skim_variable, {rate}, {stats}, count(DISTINCT v) AS n_unique, {lens}, {flags},
      {at.format('min(v)')} AS first_at, {at.format('quantile_disc(v, 0.5)')} AS middle_at, {at.format('max(v)')} AS last_at, {none} AS hist, {none} AS top_counts
    FROM dl, tot GROUP BY skim_variable""")
    return ",\n".join(ctes), "\n    UNION ALL ".join(parts)


_PROFILE_D = ["complete_rate", "mean", "sd", "p0", "p25", "p50", "p75", "p100"]
ORACLE["table_profile"] = q(*_profile_sql("tasks", ["task_id"] + SCORES, ["soc_code", "task", "title"], []), _PROFILE_D)
ORACLE["orders_profile"] = q(*_profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"],
                                           ["o_orderdate"]), _PROFILE_D)
# the sketches' errors are within their bounds: exact figures, and TRUE
_audit = lambda sql: f"""SELECT skim_variable, skim_type, n_missing, n_unique, p0, p100, CASE WHEN n_unique IS NOT NULL THEN true END AS distinct_ok,
    CASE WHEN skim_type = 'numeric' THEN true END AS rank_ok, true AS exact_ok FROM ({sql})"""  # noqa: E731
_ctes, _rows = _profile_sql("tasks", ["task_id"] + SCORES, ["soc_code", "task", "title"], [])
ORACLE["profile_sketch_audit"] = q(_ctes, _audit(_rows), ["p0", "p100"])

ORACLE["occ_task"] = q("", f"""
    SELECT t.soc_code, t.task, t.title, {', '.join('t.' + s for s in SCORES)}, {grp('t.soc_code')} AS occ_2,
      g.occ_group, g.short_name
    FROM tasks t LEFT JOIN occ_groups g ON g.occ_2 = {grp('t.soc_code')}""", SCORES)

ORACLE["occ_mean_scores"] = q("", "SELECT * FROM occ_mean", SCORES)

_box_long = "\n    UNION ALL ".join(
    f"SELECT occ_group, '{s.rsplit('_', 1)[0]}' AS name, '{s.rsplit('_', 1)[1]}' AS type, {s} AS value FROM occ_mean"
    for s in SCORES if s != "gpt4_automation")
ORACLE["exposure_box_by_score"] = q(f"""
bl AS ({_box_long}),
ord AS (SELECT occ_group, {ms('value')} AS group_mean FROM bl GROUP BY occ_group),
ord2 AS (SELECT *, row_number() OVER (ORDER BY group_mean ASC NULLS LAST, occ_group ASC NULLS LAST) AS group_order FROM ord)""",
    f"""SELECT b.*, o.group_mean, o.group_order
    FROM {box_sql('bl', ['occ_group', 'name', 'type'], 'value')} b
    LEFT JOIN ord2 o ON o.occ_group IS NOT DISTINCT FROM b.occ_group""", BOX_D + ["group_mean"])

_gws = ", ".join([f'{wm("e.avg_hourly_earnings", "e.jobs")} AS avg_hourly_earnings']
                 + [f'{wm("o." + s, "e.jobs")} AS {s}' for s in EXPO])
ORACLE["group_weighted_scores"] = q("", f"""
    SELECT o.short_name, {_gws}, {ss('e.jobs')} AS jobs
    FROM occ_mean o JOIN us_emp e ON e.soc = {soc6('o.soc_code')}
    GROUP BY o.short_name""", ["avg_hourly_earnings"] + EXPO + ["jobs"])

ORACLE["soc_scores_employment"] = q("", "SELECT * FROM score_emp", SCORES + ["has_exposure"] + EMP_DOUBLES)

ORACLE["threshold_job_share"] = q("""
tg AS (SELECT gpt4_rubric1_beta >= 0.5 AS cutoff, count(*) AS count, coalesce(sum(jobs), 0) AS jobs
       FROM score_emp GROUP BY 1)""", """
    SELECT cutoff, count, jobs, count / sum(count) OVER () AS pct_count, jobs / sum(jobs) OVER () AS pct_jobs FROM tg""",
    ["jobs", "pct_count", "pct_jobs"])

ORACLE["threshold_gender_share"] = q("""
tg AS (SELECT gpt4_rubric1_beta >= 0.1 AS cutoff, count(*) AS count,
         coalesce(sum(current_year_males), 0) AS male_jobs, coalesce(sum(current_year_females), 0) AS female_jobs
       FROM score_emp GROUP BY 1)""", """
    SELECT cutoff, count, male_jobs, female_jobs, count / sum(count) OVER () AS pct_count,
      male_jobs / sum(male_jobs) OVER () AS pct_male_jobs, female_jobs / sum(female_jobs) OVER () AS pct_female_jobs
    FROM tg""", ["male_jobs", "female_jobs", "pct_count", "pct_male_jobs", "pct_female_jobs"])

ORACLE["large_exposed_occupations"] = q("", """
    SELECT * FROM score_emp WHERE jobs >= 1000000 AND gpt4_rubric2_beta >= 0.5""",
    SCORES + ["has_exposure"] + EMP_DOUBLES)

_sg = f"""sg AS (
    SELECT se.*, g.occ_group, g.short_name FROM score_emp se
    LEFT JOIN occ_groups g ON g.occ_2 = {grp('se.soc')} WHERE se.jobs IS NOT NULL)"""

ORACLE["group_points_ordered"] = q(f"""{_sg},
po AS (SELECT occ_group, {ms('gpt4_rubric1_beta')} AS group_mean FROM sg GROUP BY occ_group),
po2 AS (SELECT *, row_number() OVER (ORDER BY group_mean ASC NULLS LAST, occ_group ASC NULLS LAST) AS group_order FROM po)""",
    """SELECT sg.soc, sg.occ_group, sg.gpt4_rubric1_beta, sg.jobs, po2.group_mean, po2.group_order
    FROM sg LEFT JOIN po2 ON po2.occ_group IS NOT DISTINCT FROM sg.occ_group""",
    ["gpt4_rubric1_beta", "jobs", "group_mean"])

ORACLE["group_beta_wage"] = q(_sg, f"""
    SELECT short_name, {wm('avg_hourly_earnings', 'jobs')} AS avg_hourly_earnings,
      {wm('gpt4_rubric1_beta', 'jobs')} AS gpt4_rubric1_beta
    FROM sg GROUP BY short_name""", ["avg_hourly_earnings", "gpt4_rubric1_beta"])

_gwt = f"""{_sg},
gwt AS (SELECT short_name, {ss('jobs')} AS jobs, {wm('avg_hourly_earnings', 'jobs')} AS avg_hourly_earnings,
          {wm('gpt4_rubric1_beta', 'jobs')} AS gpt4_rubric1_beta FROM sg GROUP BY short_name)"""
ORACLE["group_wage_table"] = q(_gwt, """
    SELECT *, CASE WHEN gpt4_rubric1_beta IS NOT NULL THEN printf('%.1f%%', round(gpt4_rubric1_beta * 100, 1)) END AS beta_label FROM gwt""", ["jobs", "avg_hourly_earnings", "gpt4_rubric1_beta"])
ORACLE["group_wage_trend"] = q(_gwt, """
    SELECT regr_slope(gpt4_rubric1_beta, avg_hourly_earnings) AS slope,
      regr_intercept(gpt4_rubric1_beta, avg_hourly_earnings) AS intercept,
      regr_r2(gpt4_rubric1_beta, avg_hourly_earnings) AS r2,
      CAST(regr_count(gpt4_rubric1_beta, avg_hourly_earnings) AS BIGINT) AS n
    FROM gwt""", ["slope", "intercept", "r2"])

ORACLE["wage_quartile_bins"] = q("""
wd AS (SELECT avg_hourly_earnings AS x, sum(jobs) AS c FROM us_emp
       WHERE avg_hourly_earnings IS NOT NULL AND jobs IS NOT NULL AND jobs > 0 GROUP BY 1),
wc AS (SELECT x, sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(c) OVER () AS n FROM wd),
wp AS (SELECT i, CAST(i AS DOUBLE) / 4 AS p FROM range(5) t(i)),
wt AS (SELECT i, pos, greatest(floor(pos), 1) AS low, least(greatest(floor(pos), 1) + 1, n) AS high, pos - floor(pos) AS frac
       FROM (SELECT i, 1 + (n - 1) * p AS pos, n FROM wp, (SELECT max(n) AS n FROM wc) nn) a),
wq AS (SELECT i, (1 - frac) * (SELECT min(x) FROM wc WHERE cum >= low) + frac * (SELECT min(x) FROM wc WHERE cum >= high) AS b
       FROM wt),
br AS (SELECT max(CASE WHEN i = 0 THEN b END) AS b0, max(CASE WHEN i = 1 THEN b END) AS b1,
         max(CASE WHEN i = 2 THEN b END) AS b2, max(CASE WHEN i = 3 THEN b END) AS b3,
         max(CASE WHEN i = 4 THEN b END) AS b4 FROM wq),
wb AS (SELECT CASE WHEN x > b0 AND x <= b1 THEN 1 WHEN x > b1 AND x <= b2 THEN 2 WHEN x > b2 AND x <= b3 THEN 3
                   WHEN x > b3 AND x <= b4 THEN 4 END AS earnings_bin, b0, b1, b2, b3, b4
       FROM (SELECT avg_hourly_earnings AS x FROM us_emp) u, br)""", """
    SELECT earnings_bin,
      CASE earnings_bin WHEN 1 THEN max(b0) WHEN 2 THEN max(b1) WHEN 3 THEN max(b2) WHEN 4 THEN max(b3) END AS lower,
      CASE earnings_bin WHEN 1 THEN max(b1) WHEN 2 THEN max(b2) WHEN 3 THEN max(b3) WHEN 4 THEN max(b4) END AS upper,
      count(*) AS n
    FROM wb GROUP BY earnings_bin""", ["lower", "upper"])


def _band_sql(case: str, name: str) -> str:
    return f"""bs AS (SELECT *, {case} AS {name} FROM score_emp WHERE jobs IS NOT NULL),
bg AS (SELECT {name}, {', '.join(f'{wm(s, "jobs")} AS {s}' for s in ['avg_hourly_earnings'] + EXPO)}
       FROM bs GROUP BY {name})"""


_wage_case = ("CASE WHEN avg_hourly_earnings < 18 THEN '<18' "
              "WHEN avg_hourly_earnings >= 18 AND avg_hourly_earnings < 23 THEN '18-23' "
              "WHEN avg_hourly_earnings >= 23 AND avg_hourly_earnings < 37 THEN '23-37' "
              "WHEN avg_hourly_earnings >= 37 THEN '37+' END")
ORACLE["wage_band_summary"] = q(_band_sql(_wage_case, "earnings_cat"), "SELECT * FROM bg",
                                ["avg_hourly_earnings"] + EXPO)
ORACLE["wage_band_scores"] = q(_band_sql(_wage_case, "earnings_cat"),
                               unpivot("bg", ["earnings_cat", "avg_hourly_earnings"], EXPO),
                               ["avg_hourly_earnings", "value"])

_edu_case = ("CASE WHEN education IN ('Master''s degree', 'Doctoral or professional degree') THEN '4. Advanced Degree' "
             "WHEN education IN ('Bachelor''s degree', 'Associate''s degree') THEN '3. Bachelor''s or Associate''s' "
             "WHEN education IN ('High school diploma or equivalent', 'Some college, no degree') THEN '2. Some College' "
             "WHEN education IN ('No formal educational credential', 'Postsecondary nondegree award') "
             "THEN '1. High School or below' ELSE 'Other' END")
ORACLE["education_band_scores"] = q(_band_sql(_edu_case, "edu_cat"),
                                    unpivot("bg", ["edu_cat", "avg_hourly_earnings"], EXPO),
                                    ["avg_hourly_earnings", "value"])

_train_case = ("CASE WHEN training IN ('Apprenticeship', 'Internship/residency') THEN 'Apprenticeship/Internship' "
               "WHEN training IN ('Long-term on-the-job training', 'Moderate-term on-the-job training') "
               "THEN 'Long/Moderate-term Training' "
               "WHEN training = 'Short-term on-the-job training' THEN 'Short-term Training' "
               "WHEN training = 'None' THEN 'No On-The-Job Training' "
               "WHEN training = 'N/A' THEN 'Not Applicable' ELSE 'Other' END")
_train_order = ("CASE train_cat WHEN 'No On-The-Job Training' THEN 1 WHEN 'Short-term Training' THEN 2 "
                "WHEN 'Long/Moderate-term Training' THEN 3 WHEN 'Apprenticeship/Internship' THEN 4 "
                "WHEN 'Not Applicable' THEN 5 WHEN 'Other' THEN 6 END")
ORACLE["training_band_scores"] = q(_band_sql(_train_case, "train_cat") + f""",
bo AS (SELECT *, {_train_order} AS train_order FROM bg)""",
    unpivot("bo", ["train_cat", "train_order", "avg_hourly_earnings"], EXPO), ["avg_hourly_earnings", "value"])

_demo_union = "\n    UNION ALL ".join(
    f"SELECT '{d}' AS demo, current_year_{d} AS value, * FROM ds" for d in DEMOS)
ORACLE["demographic_scores"] = q(f"""
ds AS (SELECT * FROM score_emp WHERE jobs IS NOT NULL),
dl AS ({_demo_union})""", f"""
    SELECT CASE WHEN demo IN ('females', 'males') THEN 'gender' ELSE 'race' END AS type, upper(demo[1]) || demo[2:] AS demo,
      {wm('has_exposure', 'value / nullif(jobs, 0)')} AS has_exposure,
      {wm('gpt4_rubric1_beta', 'value / nullif(jobs, 0)')} AS gpt4_rubric1_beta
    FROM dl GROUP BY 1, 2""", ["has_exposure", "gpt4_rubric1_beta"])

ORACLE["staffing_long"] = q("", "SELECT occupation, naics6_code, jobs FROM staffing_long_src", ["jobs"])

ORACLE["sector_scores"] = q("", f"""
    SELECT sl.naics2_code, sc.naics_short_name, {', '.join(f'{wm("o." + s, "sl.jobs")} AS {s}' for s in EXPO)}
    FROM occ_mean o JOIN staffing_long sl ON sl.occupation = {soc6('o.soc_code')}
    JOIN sectors sc ON sc.naics2_code = sl.naics2_code
    GROUP BY 1, 2""", EXPO)

ORACLE["metro_scores"] = q("", "SELECT * FROM msa", EXPO + ["jobs"])
ORACLE["metro_size_scores"] = q(f"""
mz AS (SELECT size_class, {', '.join(f'{wm(s, "jobs")} AS {s}' for s in EXPO)}
       FROM msa WHERE size_class IS NOT NULL GROUP BY size_class)""", unpivot("mz", ["size_class"], EXPO), ["value"])
ORACLE["metro_map_table"] = q("", f"""
    SELECT m.cbsa_code AS geoid, m.cbsa_name, m.size_class, {', '.join('m.' + s for s in EXPO)}, m.jobs,
      g.geo_name, g.lon, g.lat
    FROM msa m JOIN geography g ON g.geoid = m.cbsa_code""", EXPO + ["jobs", "lon", "lat"])

ORACLE["master_score"] = q("", "SELECT * FROM master",
                           ["jobs", "gpt4_rubric1_beta"] + [s for _, s in CATS])
ORACLE["master_score_group"] = q("", f"""
    SELECT {grp('m.soc')} AS occ_2, g.occ_group, {ms('m.gpt4_rubric1_beta')} AS gpt4_rubric1_beta,
      {', '.join(f'{ms("m." + s)} AS {s}' for _, s in CATS)}, {ss('m.jobs')} AS jobs
    FROM master m LEFT JOIN occ_groups g ON g.occ_2 = {grp('m.soc')}
    GROUP BY 1, 2""", ["gpt4_rubric1_beta", "jobs"] + [s for _, s in CATS])

ORACLE["employment_join_report"] = q(f"""
jl AS (SELECT {soc6('soc_code')} AS soc, count(*) AS ln FROM occ_mean GROUP BY 1),
jr AS (SELECT soc, count(*) AS rn FROM us_emp GROUP BY 1),
jb AS (SELECT coalesce(jl.ln, 0) AS ln, coalesce(jr.rn, 0) AS rn FROM jl FULL OUTER JOIN jr ON jl.soc = jr.soc)""", """
    SELECT CAST(sum(ln) AS BIGINT) AS left_rows, CAST(sum(rn) AS BIGINT) AS right_rows,
      CAST(coalesce(sum(CASE WHEN ln > 0 AND rn > 0 THEN ln END), 0) AS BIGINT) AS left_matched_rows,
      CAST(coalesce(sum(CASE WHEN rn = 0 THEN ln END), 0) AS BIGINT) AS left_only_rows,
      CAST(coalesce(sum(CASE WHEN ln > 0 AND rn > 0 THEN rn END), 0) AS BIGINT) AS right_matched_rows,
      CAST(coalesce(sum(CASE WHEN ln = 0 THEN rn END), 0) AS BIGINT) AS right_only_rows,
      count(CASE WHEN ln > 1 THEN 1 END) AS left_duplicate_keys,
      count(CASE WHEN rn > 1 THEN 1 END) AS right_duplicate_keys,
      CAST(coalesce(sum(CASE WHEN ln > 0 AND rn > 0 THEN ln * rn END), 0) AS BIGINT) AS inner_rows,
      CAST(coalesce(sum(CASE WHEN ln > 0 AND rn > 0 THEN ln * rn WHEN ln > 0 THEN ln END), 0) AS BIGINT) AS left_join_rows
    FROM jb""", [])

# -- automation ----------------------------------------------------------------

ORACLE["task_category"] = q("", "SELECT * FROM classified", ["task_weights"])
ORACLE["occ_category_share"] = q("", "SELECT * FROM share", ["n_weighted", "pct_tasks", "pct_weighted"])
ORACLE["category_by_task_type"] = q("""
tt AS (SELECT task_type, ai_cat, count(*) AS n FROM classified GROUP BY 1, 2),
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY task_type) AS pct FROM tt)""", """
    SELECT *, sum(pct) OVER (PARTITION BY task_type ORDER BY ai_cat DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - pct / 2 AS label_pos
    FROM tp""", ["pct", "label_pos"])

_wide_d = [f"pct_tasks_{s}" for _, s in CATS] + [f"pct_weighted_{s}" for _, s in CATS]
ORACLE["occ_category_wide"] = q("", """
    SELECT *, avg(pct_tasks_more_likely_automated) OVER (PARTITION BY occ_group) AS mean_automated,
      avg(pct_weighted_more_likely_automated) OVER (PARTITION BY occ_group) AS mean_automated_weighted
    FROM occ_wide""", _wide_d + ["mean_automated", "mean_automated_weighted"])

ORACLE["occ_automation_rank"] = q("", """
    SELECT soc_code, title, pct_weighted_more_likely_automated,
      row_number() OVER (ORDER BY pct_weighted_more_likely_automated DESC NULLS LAST,
                         soc_code ASC NULLS LAST, title ASC NULLS LAST) AS rank
    FROM occ_wide""", ["pct_weighted_more_likely_automated"])

ORACLE["share_histogram"] = q("""
hr AS (SELECT min(pct_weighted) AS lo, max(pct_weighted) AS hi FROM share WHERE pct_weighted IS NOT NULL),
hw AS (SELECT lo, CASE WHEN hi <= lo THEN CAST(0.1 AS DOUBLE) ELSE (hi - lo) / 29 END AS width,
         CASE WHEN hi <= lo THEN 1 ELSE 30 END AS nbins FROM hr),
hb AS (SELECT ai_cat,
         CAST(CASE WHEN nbins = 1 THEN 0
                   ELSE greatest(ceil((pct_weighted - (lo - width / 2)) / width - 1e-8) - 1, 0) END AS INTEGER) AS bin
       FROM share, hw WHERE pct_weighted IS NOT NULL),
hc AS (SELECT ai_cat, bin, count(*) AS count FROM hb GROUP BY ai_cat, bin),
hall AS (SELECT f.ai_cat, CAST(g.bin AS INTEGER) AS bin
         FROM (SELECT DISTINCT ai_cat FROM hb) f, hw, range(30) g(bin) WHERE g.bin < hw.nbins)""", """
    SELECT a.ai_cat, a.bin, hw.lo + a.bin * hw.width AS x,
      hw.lo + a.bin * hw.width - hw.width / 2 AS xmin, hw.lo + a.bin * hw.width + hw.width / 2 AS xmax,
      CAST(coalesce(c.count, 0) AS BIGINT) AS count
    FROM hall a CROSS JOIN hw LEFT JOIN hc c ON c.ai_cat = a.ai_cat AND c.bin = a.bin""", ["x", "xmin", "xmax"])

ORACLE["share_density"] = q("""
dv AS (SELECT ai_cat, pct_weighted AS x FROM share WHERE pct_weighted BETWEEN 0 AND 1),
dst AS (SELECT ai_cat, count(*) AS n, min(x) AS mn, max(x) AS mx, stddev_samp(x) AS sd,
          quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM dv GROUP BY ai_cat),
dbw AS (SELECT ai_cat, n, mn, mx,
          CAST(0.9 AS DOUBLE) * (CASE WHEN least(sd, (q3 - q1) / CAST(1.34 AS DOUBLE)) > 0
                                      THEN least(sd, (q3 - q1) / CAST(1.34 AS DOUBLE))
                                      WHEN sd > 0 THEN sd ELSE CAST(1 AS DOUBLE) END)
            * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw FROM dst),
djoint AS (SELECT avg(CASE WHEN n > 1 THEN bw END) AS bw, min(mn) AS lo, max(mx) AS hi FROM dbw),
dpar AS (SELECT d.ai_cat, d.n, j.bw, j.lo - 3 * j.bw AS g_lo, (j.hi - j.lo + 2 * 3 * j.bw) / 511 AS g_step,
           j.lo - 7 * j.bw AS b_lo, (j.hi - j.lo + 2 * 7 * j.bw) / 511 AS b_step
         FROM dbw d, djoint j),
dpos AS (SELECT v.ai_cat, (v.x - p.b_lo) / p.b_step AS pos FROM dv v JOIN dpar p ON p.ai_cat = v.ai_cat),
dcell AS (SELECT ai_cat, CAST(floor(pos) AS BIGINT) AS i, 1 - (pos - floor(pos)) AS m FROM dpos
          UNION ALL SELECT ai_cat, CAST(floor(pos) AS BIGINT) + 1, pos - floor(pos) FROM dpos),
dmass AS (SELECT ai_cat, i, sum(m) AS m FROM dcell WHERE i >= 0 AND i < 512 GROUP BY ai_cat, i),
-- the convolution of the binned masses, summed out on the same grid
dconv AS (SELECT p.ai_cat, g.i, sum(d.m * exp(-0.5 * ((g.i - d.i) * p.b_step / p.bw) * ((g.i - d.i) * p.b_step / p.bw)))
            / (p.n * p.bw * sqrt(2 * pi())) AS y
          FROM dpar p, range(512) g(i), dmass d WHERE d.ai_cat = p.ai_cat GROUP BY p.ai_cat, g.i, p.n, p.bw),
dgrid AS (SELECT p.ai_cat, g.i, p.g_lo + p.g_step * g.i AS x, (p.g_lo + p.g_step * g.i - p.b_lo) / p.b_step AS at_pos
          FROM dpar p, range(512) g(i))""", """
    SELECT g.ai_cat, g.i, g.x, a.y + (g.at_pos - floor(g.at_pos)) * (b.y - a.y) AS density
    FROM dgrid g JOIN dconv a ON a.ai_cat = g.ai_cat AND a.i = CAST(floor(g.at_pos) AS BIGINT)
    JOIN dconv b ON b.ai_cat = g.ai_cat AND b.i = CAST(floor(g.at_pos) AS BIGINT) + 1""", ["x", "density"])

ORACLE["share_box_by_group"] = q(f"""
sm AS (SELECT ai_cat, occ_group, {ms('pct_tasks')} AS mean_value FROM share GROUP BY 1, 2),
sm2 AS (SELECT *, row_number() OVER (PARTITION BY ai_cat ORDER BY mean_value ASC NULLS LAST,
                                      occ_group ASC NULLS LAST) AS rank_in_facet FROM sm)""", f"""
    SELECT b.*, sm2.mean_value, sm2.rank_in_facet
    FROM {box_sql('share', ['ai_cat', 'occ_group'], 'pct_tasks')} b
    LEFT JOIN sm2 ON sm2.ai_cat = b.ai_cat AND sm2.occ_group IS NOT DISTINCT FROM b.occ_group""",
    BOX_D + ["mean_value"])


ORACLE["share_rank_in_facet"] = q(f"""
rm AS (SELECT ai_cat, occ_group, {ms('pct_tasks')} AS mean_value FROM share GROUP BY 1, 2)""", """
    SELECT *, row_number() OVER (PARTITION BY ai_cat ORDER BY mean_value ASC NULLS LAST,
                                 occ_group ASC NULLS LAST) AS rank_in_facet
    FROM rm""", ["mean_value"])


def _box_group(stem: str) -> str:
    col = f"pct_weighted_{stem}"
    return q(f"""
go AS (SELECT occ_group, avg({col}) AS group_mean FROM occ_wide GROUP BY occ_group),
go2 AS (SELECT *, row_number() OVER (ORDER BY group_mean ASC NULLS LAST, occ_group ASC NULLS LAST) AS group_order
        FROM go)""", f"""
    SELECT b.*, go2.group_mean, go2.group_order
    FROM {box_sql('occ_wide', ['occ_group'], col)} b
    LEFT JOIN go2 ON go2.occ_group IS NOT DISTINCT FROM b.occ_group""", BOX_D + ["group_mean"])


ORACLE["automated_box_by_group"] = _box_group("more_likely_automated")
ORACLE["augmented_box_by_group"] = _box_group("more_likely_augmented")

ORACLE["group_category_wide"] = q("", f"""
    SELECT occ_group, {', '.join(f"avg(CASE WHEN ai_cat = '{c}' THEN pct_tasks END) AS {s}" for c, s in CATS)}
    FROM share GROUP BY occ_group""", [s for _, s in CATS])

_cdemo_union = "\n    UNION ALL ".join(
    f"SELECT '{d}' AS demo, current_year_{d} AS value, jobs, avg_hourly_earnings, "
    f"{', '.join(s for _, s in CATS)} FROM cj" for d in DEMOS)
ORACLE["category_by_demographic"] = q(f"""
cj AS (SELECT e.*, {', '.join('w.' + s for _, s in CATS)} FROM occ_w w JOIN us_emp e ON e.soc = {soc6('w.soc_code')}),
cl AS ({_cdemo_union}),
cg AS (SELECT CASE WHEN demo IN ('females', 'males') THEN 'gender' ELSE 'race' END AS type, upper(demo[1]) || demo[2:] AS demo,
         {', '.join(f'{wm(s, "value / nullif(jobs, 0)")} AS {s}' for s in ['avg_hourly_earnings'] + IMPACT)}
       FROM cl GROUP BY 1, 2)""", unpivot_impact("cg", ["type", "demo", "avg_hourly_earnings"]),
    ["avg_hourly_earnings", "value"])

ORACLE["category_by_sector"] = q(f"""
cs AS (SELECT sl.naics2_code, sc.naics_short_name, {', '.join(f'{wm("w." + s, "sl.jobs")} AS {s}' for s in IMPACT)}
       FROM occ_w w JOIN staffing_long sl ON sl.occupation = {soc6('w.soc_code')}
       JOIN sectors sc ON sc.naics2_code = sl.naics2_code
       GROUP BY 1, 2)""", unpivot_impact("cs", ["naics2_code", "naics_short_name"]), ["value"])

ORACLE["category_by_metro"] = q("", "SELECT * FROM msa_cat", [s for _, s in CATS] + ["jobs"])
ORACLE["category_by_metro_size"] = q(f"""
cz AS (SELECT size_class, {', '.join(f'{wm(s, "jobs")} AS {s}' for s in IMPACT)}
       FROM msa_cat WHERE size_class IS NOT NULL GROUP BY size_class)""", unpivot_impact("cz", ["size_class"]),
    ["value"])
ORACLE["category_map_long"] = q(f"""
cm AS (SELECT cbsa_code AS geoid, cbsa_name, size_class, jobs, {', '.join(IMPACT)} FROM msa_cat),
cml AS ({unpivot_impact('cm', ['geoid', 'cbsa_name', 'size_class', 'jobs'])})""", """
    SELECT cml.*, g.geo_name, g.lon, g.lat FROM cml JOIN geography g ON g.geoid = cml.geoid""",
    ["jobs", "value", "lon", "lat"])

ORACLE["score_disagreement"] = q("", """
    SELECT * FROM tasks WHERE gpt4_automation = 1 AND gpt4_rubric1_gamma = 0 AND mean_rating_human_gamma = 0""",
    SCORES)

_occ_join = f"FROM tasks t LEFT JOIN occ_groups g ON g.occ_2 = {grp('t.soc_code')}"
ORACLE["automation_mean_sd"] = q("", f"""
    SELECT g.occ_group, t.soc_code, t.title, {ms('t.gpt4_automation')} AS mean_rating,
      {sds('t.gpt4_automation')} AS sd_rating
    {_occ_join} GROUP BY g.occ_group, t.soc_code, t.title""", ["mean_rating", "sd_rating"])

ORACLE["score_mean_sd"] = q("", "\n    UNION ALL ".join(f"""
    SELECT g.occ_group, t.soc_code, t.title, '{s}' AS name, {ms('t.' + s)} AS mean_rating, {sds('t.' + s)} AS sd_rating
    {_occ_join} GROUP BY g.occ_group, t.soc_code, t.title""" for s in SCORES), ["mean_rating", "sd_rating"])

ORACLE["automation_rows"] = q("", f"""
    SELECT g.occ_group, t.soc_code, t.title, 'gpt4_automation' AS name, {ms('t.gpt4_automation')} AS mean_rating,
      {sds('t.gpt4_automation')} AS sd_rating
    {_occ_join} GROUP BY g.occ_group, t.soc_code, t.title""", ["mean_rating", "sd_rating"])

ORACLE["score_mean_wide"] = q("", f"""
    SELECT g.occ_group, t.soc_code, t.title, {', '.join(f'{ms("t." + s)} AS {s}' for s in SCORES)}
    {_occ_join} GROUP BY g.occ_group, t.soc_code, t.title""", SCORES)

ORACLE["group_score_mean_sd"] = q("", f"""
    SELECT g.occ_group, 'gpt4_automation' AS name, {ms('t.gpt4_automation')} AS mean_rating,
      {sds('t.gpt4_automation')} AS sd_rating
    {_occ_join} GROUP BY g.occ_group""", ["mean_rating", "sd_rating"])

# -- audits: every step counted on its own -------------------------------------------------

_N = "CAST(NULL AS BIGINT)"


def _step(k: int, name: str, kind: str, rows_in, right=_N, matched=_N, unmatched=_N, right_only=_N, dropped=_N, rows_out=_N) -> str:
    cells = zip((rows_in, right, matched, unmatched, right_only, dropped, rows_out), ("rows_in", "rows_right", "matched", "unmatched", "right_only", "dropped", "rows_out"))
    return f"SELECT {k} AS step, '{name}' AS name, '{kind}' AS kind, " + ", ".join(f"{c if c == _N else f'CAST(({c}) AS BIGINT)'} AS {n}" for c, n in cells)


_count = "SELECT count(*) FROM {}".format
_soc_steps = [
    _step(1, "mean per SOC", "group", _count("tasks"), rows_out=_count("au_soc")),
    _step(2, "national employment", "inner join", _count("au_soc"), _count("us_emp"), _count("score_emp"),
          _count("au_soc WHERE soc NOT IN (SELECT soc FROM us_emp)"), _count("us_emp WHERE soc NOT IN (SELECT soc FROM au_soc)"),
          _count("au_soc WHERE soc NOT IN (SELECT soc FROM us_emp)"), _count("score_emp"))]
_au_soc = f"au_soc AS (SELECT DISTINCT {soc6c('soc_code')} AS soc FROM tasks)"
ORACLE["audit_group_beta_wage"] = q(f"""{_au_soc},
au_sg AS (SELECT se.*, g.occ_2 IS NOT NULL AS known, g.short_name FROM score_emp se LEFT JOIN occ_groups g ON g.occ_2 = {grp('se.soc')})""", "\n    UNION ALL ".join([
    *_soc_steps,
    _step(3, "occupation group", "left join", _count("score_emp"), _count("occ_groups"), _count("au_sg WHERE known"), _count("au_sg WHERE NOT known"),
          dropped="0", rows_out=_count("au_sg")),
    _step(4, "jobs known", "filter", _count("au_sg"), dropped=_count("au_sg WHERE jobs IS NULL"), rows_out=_count("au_sg WHERE jobs IS NOT NULL")),
    _step(5, "mean per group", "group", _count("au_sg WHERE jobs IS NOT NULL"), rows_out=_count("(SELECT DISTINCT short_name FROM au_sg WHERE jobs IS NOT NULL)"))]), [])
ORACLE["audit_master_score"] = q(f"""{_au_soc},
au_st AS (SELECT s.soc_code IS NOT NULL AS known FROM tasks t LEFT JOIN task_statements s
    ON s.soc_code IS NOT DISTINCT FROM t.soc_code AND s.task_id IS NOT DISTINCT FROM t.task_id AND s.task IS NOT DISTINCT FROM t.task),
au_wide AS (SELECT DISTINCT {soc6c('soc_code')} AS soc FROM share)""", "\n    UNION ALL ".join([
    *_soc_steps,
    _step(3, "task statements", "left join", _count("tasks"), _count("task_statements"), _count("au_st WHERE known"), _count("au_st WHERE NOT known"),
          _count("(SELECT s.* FROM task_statements s WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE s.soc_code IS NOT DISTINCT FROM t.soc_code AND s.task_id IS NOT DISTINCT FROM t.task_id AND s.task IS NOT DISTINCT FROM t.task))"),
          "0", _count("au_st")),
    _step(4, "category shares per occupation", "group", _count("classified"), rows_out=_count("share")),
    _step(5, "shares per SOC, wide", "group", _count("share"), rows_out=_count("au_wide")),
    _step(6, "category shares", "left join", _count("score_emp"), _count("au_wide"), _count("score_emp WHERE soc IN (SELECT soc FROM au_wide)"),
          _count("score_emp WHERE soc NOT IN (SELECT soc FROM au_wide)"), _count("au_wide WHERE soc NOT IN (SELECT soc FROM score_emp)"), "0", _count("score_emp"))]), [])

# -- failed cells: every cell of the exported matrix, its stray header row included ----------

ORACLE["staffing_failed_cells"] = q("""
cells AS (SELECT naics6_code AS industry, CAST(jobs AS VARCHAR) AS cell FROM staffing_long_src
          UNION ALL SELECT DISTINCT naics6_code, 'Industry ' || naics6_code FROM staffing_long_src)""", """
    SELECT industry AS "column", 'double' AS "type", count(cell) AS cells, count(CASE WHEN try_cast(cell AS DOUBLE) IS NULL THEN 1 END) AS failed,
      string_agg(CASE WHEN try_cast(cell AS DOUBLE) IS NULL THEN cell END, '; ') AS sample
    FROM cells GROUP BY industry""", [])

# -- written as delimited text by the sink, read again with a guessed delimiter ----------------

ORACLE["statements_round_trip"] = q("", "SELECT soc_code, task_id, task, task_type FROM task_statements", [])

# -- weighted quartiles of a summary: their weighted ranks are within the stated error ---------

ORACLE["wage_quartile_sketch_audit"] = q("", """
    SELECT p AS prob, (SELECT count(*) FROM us_emp WHERE avg_hourly_earnings IS NOT NULL AND jobs > 0) AS n_rows,
      (SELECT sum(jobs) FROM us_emp WHERE avg_hourly_earnings IS NOT NULL AND jobs > 0) AS total, true AS rank_ok
    FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.25), (0.5), (0.75), (1.0)) v(p)""", ["prob", "total"])
