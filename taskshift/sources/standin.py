"""Stand-in domain inputs built from the driver's test tables.

The real inputs (task ratings, national and metro employment, the staffing
matrix, the metro JSON) are not shipped. These builders only *reshape* the
test tables (lineitem, part, supplier, nation, region) into the domain
schemas of FIXTURES.md so that every result table can run, and grow, on
them. They do none of the result tables' work: the jobs in ``plans/`` read
these frames exactly as they would read the real files and rely on nothing
about how the rows were made.

Each builder has an SQL twin (``standin_sql``) so the DuckDB oracle starts
from identical inputs. Scores are multiples of 1/4 (as the real ratings
are), so sums are exact and both engines agree to the last bit.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edge rows are produced by these fixed rules (see FIXTURES.md section 3).
NULL_ALPHA_EVERY = 97        # l_orderkey % 97 == 0 -> human alpha missing
NULL_BETA_EVERY = 13         # l_orderkey % 13 == 0 -> rubric1 beta missing
NAN_BETA_EVERY = 19          # l_orderkey % 19 == 0 -> rubric1 beta not a number
NAN_AUTOMATION_EVERY = 37    # l_orderkey % 37 == 0 -> automation score not a number
NULL_TASK_EVERY = 41         # l_orderkey % 41 == 0 -> wording missing, in the ratings and in the statements
REWORDED_STATEMENT_EVERY = 10    # l_orderkey % 10 == 0 -> statement wording differs (no match)
UNLISTED_METRO_EVERY = 12        # n_nationkey % 12 == 11 -> metro code not in the employment data
UNMAPPED_GEO_EVERY = 5           # n_nationkey % 5 == 4 -> geography id not among the metros
CODE_SHIFT = 1000
NULL_WAGE_EVERY = 113        # p_partkey % 113 == 0 -> wage missing
JOBS_UNIT = 25000

EDUCATION_LEVELS = [
    "No formal educational credential", "High school diploma or equivalent",
    "Some college, no degree", "Postsecondary nondegree award", "Associate's degree",
    "Bachelor's degree", "Master's degree", "Doctoral or professional degree",
    "Unknown credential",
]
TRAINING_LEVELS = [
    "None", "Short-term on-the-job training", "Moderate-term on-the-job training",
    "Long-term on-the-job training", "Apprenticeship", "Internship/residency", "N/A",
    "Unlisted training",
]
INDUSTRY_PREFIXES = ["11", "21", "22", "23", "31", "32", "33", "42", "44", "45", "48", "49",
                     "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "90", "99"]
INDUSTRY_CODES = [p + "1100" for p in INDUSTRY_PREFIXES]
DEMOGRAPHIC_COLUMNS = ["current_year_females", "current_year_males",
                       "current_year_white", "current_year_black"]
TEACHER_SOC_ROW_KEY = 1


_READS: dict[tuple[int, str], DataFrame] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table as a DataFrame; the (lazy, immutable) frame is reused
    within a session so its file listing and footers are read once."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (id(spark), path)
    hit = _READS.get(key)
    if hit is None or hit.sparkSession is not spark:
        hit = _READS[key] = spark.read.parquet(path)
    return hit


def occ_code(k: Column) -> Column:
    """Stand-in occupation code for an integer key: ``NN-D`` + 8-digit key."""
    return F.concat((F.lit(11) + F.lit(2) * (k % 23)).cast("string"), F.lit("-"),
                    (F.lit(1) + k % 9).cast("string"), F.lpad(k.cast("string"), 8, "0"))


def _quarters(x: Column, mod: int = 5, den: int = 4) -> Column:
    return (x % mod).cast("double") / den


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in task ratings: one row per lineitem (code from part key + line number)."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus")
    # the occupation code depends on the part only: built once per part row
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", occ_code(F.col("p_partkey")).alias("pcode"))
    j = li.join(p, li.l_partkey == p.p_partkey)
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    q = F.col("l_quantity").cast("int")
    ok = F.col("l_orderkey")
    return j.select(
        F.concat(F.col("pcode"), F.lit("."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("soc_code"),
        ok.alias("task_id"),
        F.when(ok % NULL_TASK_EVERY != 0, F.concat(F.col("p_name"), F.lit(" / "), F.col("l_linestatus"))).alias("task"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(ok % NULL_ALPHA_EVERY != 0, _quarters(q)).alias("mean_rating_human_alpha"),
        _quarters(q + d).alias("mean_rating_human_beta"),
        _quarters(q + t).alias("mean_rating_human_gamma"),
        (d % 2).cast("double").alias("gpt4_rubric1_alpha"),
        F.when(ok % NAN_BETA_EVERY == 0, F.lit(float("nan"))).when(ok % NULL_BETA_EVERY != 0, _quarters(d, 3, 2)).alias("gpt4_rubric1_beta"),
        (t % 2).cast("double").alias("gpt4_rubric1_gamma"),
        _quarters(d + t, 3, 2).alias("gpt4_rubric2_beta"),
        F.when(ok % NAN_AUTOMATION_EVERY == 0, F.lit(float("nan"))).otherwise(_quarters(q * 3 + t)).alias("gpt4_automation"),
    )


def task_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in task statements: distinct (code, id, wording) with a type; some tasks left out."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag")
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", occ_code(F.col("p_partkey")).alias("pcode"))
    j = li.join(p, li.l_partkey == p.p_partkey)
    reworded = F.when(F.col("l_orderkey") % REWORDED_STATEMENT_EVERY == 0, F.lit(".")).otherwise(F.lit(""))
    keyed = j.select(
        F.concat(F.col("pcode"), F.lit("."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("soc_code"),
        F.col("l_orderkey").alias("task_id"),
        F.when(F.col("l_orderkey") % NULL_TASK_EVERY != 0,
               F.concat(F.col("p_name"), F.lit(" / "), F.col("l_linestatus"), reworded)).alias("task"),
        "l_returnflag")
    # least return flag of the task's rows (A < N < R), as a small integer so
    # the aggregation is hash-based
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(
        F.col("l_returnflag") == "R", 3)
    flag = F.min(code)
    return keyed.groupBy("soc_code", "task_id", "task").agg(
        F.when(flag == 1, "Core").when(flag == 3, "Supplemental").alias("task_type"))


def _pick(idx_sql: str, values: list[str]) -> Column:
    """The label at position ``idx_sql`` (an SQL expression) of a fixed list."""
    return F.expr(_pick_sql(idx_sql, values))


def _us_emp_cols(k: Column, soc: Column, description: Column, jobs_missing: bool = False) -> list[Column]:
    jobs = F.lit(None).cast("double") if jobs_missing else (F.col("p_size") * JOBS_UNIT).cast("double")
    r = F.round(F.col("p_retailprice") * 10).cast("bigint") - 9000
    return [
        soc.alias("soc"),
        description.alias("description"),
        jobs.alias("jobs"),
        F.when(k % NULL_WAGE_EVERY != 0, (r % 200).cast("double") / 4).alias("avg_hourly_earnings"),
        ((r % 160).cast("double") / 4).alias("median_hourly_earnings"),
        _pick("p_partkey % 9", EDUCATION_LEVELS).alias("education"),
        _pick("p_partkey % 8", TRAINING_LEVELS).alias("training"),
        (jobs * (k % 5).cast("double") / 4).alias("current_year_females"),
        (jobs - jobs * (k % 5).cast("double") / 4).alias("current_year_males"),
        (jobs * (k % 3 + 1).cast("double") / 4).alias("current_year_white"),
        (jobs * (k % 3).cast("double") / 8).alias("current_year_black"),
    ]


def us_emp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in national employment: one row per part, plus the collapsed teacher SOC."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.select(*_us_emp_cols(k, occ_code(k), F.col("p_name")))
    teacher = p.where(k == TEACHER_SOC_ROW_KEY).select(
        *_us_emp_cols(k, F.lit("25-1099"), F.lit("Postsecondary Teachers"), jobs_missing=True))
    return base.unionByName(teacher)


def metro_emp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in metro employment: quantity per (occupation, supplier nation)."""
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return (j.groupBy(occ_code(F.col("l_partkey")).alias("occupation"),
                      F.col("s_nationkey").cast("bigint").alias("area"))
            .agg(F.sum("l_quantity").alias("jobs"))
            .select("occupation", "area", F.concat(F.lit("Area "), F.col("area").cast("string")).alias("area_name"), "jobs"))


def metro_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in metro dimension from nation and region (two nations left out, one NULL size class)."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    k = F.col("n_nationkey").cast("bigint")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.when(k % UNLISTED_METRO_EVERY == UNLISTED_METRO_EVERY - 1, k + CODE_SHIFT).otherwise(k).alias("cbsa"),
                    F.col("n_name").alias("cbsa_name"),
                    F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("size_class")))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in geography dimension (id, name, coordinates) from nation."""
    n = _t(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    return n.select(
        F.when(k % UNMAPPED_GEO_EVERY == UNMAPPED_GEO_EVERY - 1, k + CODE_SHIFT).otherwise(k).cast("string").alias("geoid"),
        F.col("n_name").alias("geo_name"),
        (F.lit(-120.0) + F.col("n_nationkey") * 2).cast("double").alias("lon"),
        (F.lit(30.0) + F.col("n_regionkey")).cast("double").alias("lat"))


def staffing_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide staffing matrix: label, description, one text column per industry,
    plus the stray header row the real export carries."""
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    ind = F.element_at(F.array(*[F.lit(c) for c in INDUSTRY_CODES]), (F.col("l_suppkey") % len(INDUSTRY_CODES) + 1).cast("int"))
    cells = li.select(occ_code(F.col("l_partkey")).alias("occupation_label"), ind.alias("naics6"), "l_quantity")
    wide = cells.groupBy("occupation_label").agg(
        *[F.sum(F.when(F.col("naics6") == c, F.col("l_quantity"))).alias(c) for c in INDUSTRY_CODES])
    body = wide.select("occupation_label",
                       F.concat(F.lit("Occupation "), F.col("occupation_label")).alias("description"),
                       *[F.coalesce(F.col(c), F.lit(0.0)).cast("string").alias(c) for c in INDUSTRY_CODES])
    header = spark.range(1).select(F.lit("SOC").alias("occupation_label"), F.lit("Description").alias("description"),
                                   *[F.lit(f"Industry {c}").alias(c) for c in INDUSTRY_CODES])
    return body.unionByName(header)


# ---------------------------------------------------------------------------
# SQL twin (DuckDB dialect) of the builders above, as WITH-clause entries.
# ---------------------------------------------------------------------------

def _code_sql(k: str) -> str:
    return (f"(CAST(11 + 2 * ({k} % 23) AS VARCHAR) || '-' || CAST(1 + {k} % 9 AS VARCHAR) "
            f"|| lpad(CAST({k} AS VARCHAR), 8, '0'))")


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _pick_sql(idx: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def _us_emp_sql(soc: str, desc: str, jobs_missing: bool = False) -> str:
    jobs = "CAST(NULL AS DOUBLE)" if jobs_missing else f"CAST(p_size * {JOBS_UNIT} AS DOUBLE)"
    r = "(CAST(round(p_retailprice * 10) AS BIGINT) - 9000)"
    return f"""SELECT {soc} AS soc, {desc} AS description, {jobs} AS jobs,
      CASE WHEN p_partkey % {NULL_WAGE_EVERY} <> 0 THEN CAST({r} % 200 AS DOUBLE) / 4 END AS avg_hourly_earnings,
      CAST({r} % 160 AS DOUBLE) / 4 AS median_hourly_earnings,
      {_pick_sql('p_partkey % 9', EDUCATION_LEVELS)} AS education,
      {_pick_sql('p_partkey % 8', TRAINING_LEVELS)} AS training,
      {jobs} * CAST(p_partkey % 5 AS DOUBLE) / 4 AS current_year_females,
      {jobs} - {jobs} * CAST(p_partkey % 5 AS DOUBLE) / 4 AS current_year_males,
      {jobs} * CAST(p_partkey % 3 + 1 AS DOUBLE) / 4 AS current_year_white,
      {jobs} * CAST(p_partkey % 3 AS DOUBLE) / 8 AS current_year_black
    FROM part"""


def standin_sql() -> str:
    """WITH-clause entries (no leading WITH) defining the stand-in tables."""
    soc_code = (f"({_code_sql('l_partkey')} || '.' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0'))")
    d = "CAST(round(l_discount * 100) AS INTEGER)"
    t = "CAST(round(l_tax * 100) AS INTEGER)"
    q = "CAST(l_quantity AS INTEGER)"
    ind_list = "[" + ", ".join(_q(c) for c in INDUSTRY_CODES) + "]"
    ind_values = ", ".join(f"({_q(c)})" for c in INDUSTRY_CODES)
    return f"""
tasks_given AS (
    SELECT {soc_code} AS soc_code, l_orderkey AS task_id,
      CASE WHEN l_orderkey % {NULL_TASK_EVERY} <> 0 THEN p_name || ' / ' || l_linestatus END AS task,
      p_name || ' ' || CAST(l_linenumber AS VARCHAR) AS title,
      CASE WHEN l_orderkey % {NULL_ALPHA_EVERY} <> 0 THEN CAST({q} % 5 AS DOUBLE) / 4 END AS mean_rating_human_alpha,
      CAST(({q} + {d}) % 5 AS DOUBLE) / 4 AS mean_rating_human_beta,
      CAST(({q} + {t}) % 5 AS DOUBLE) / 4 AS mean_rating_human_gamma,
      CAST({d} % 2 AS DOUBLE) AS gpt4_rubric1_alpha,
      CASE WHEN l_orderkey % {NAN_BETA_EVERY} = 0 THEN CAST('NaN' AS DOUBLE)
           WHEN l_orderkey % {NULL_BETA_EVERY} <> 0 THEN CAST({d} % 3 AS DOUBLE) / 2 END AS gpt4_rubric1_beta,
      CAST({t} % 2 AS DOUBLE) AS gpt4_rubric1_gamma,
      CAST(({d} + {t}) % 3 AS DOUBLE) / 2 AS gpt4_rubric2_beta,
      CASE WHEN l_orderkey % {NAN_AUTOMATION_EVERY} = 0 THEN CAST('NaN' AS DOUBLE)
           ELSE CAST(({q} * 3 + {t}) % 5 AS DOUBLE) / 4 END AS gpt4_automation
    FROM lineitem JOIN part ON l_partkey = p_partkey
),
task_statements AS (
    SELECT soc_code, task_id, task,
      CASE min(l_returnflag) WHEN 'A' THEN 'Core' WHEN 'R' THEN 'Supplemental' END AS task_type
    FROM (SELECT {soc_code} AS soc_code, l_orderkey AS task_id,
            CASE WHEN l_orderkey % {NULL_TASK_EVERY} <> 0 THEN p_name || ' / ' || l_linestatus
              || CASE WHEN l_orderkey % {REWORDED_STATEMENT_EVERY} = 0 THEN '.' ELSE '' END END AS task,
            l_returnflag
          FROM lineitem JOIN part ON l_partkey = p_partkey) s
    GROUP BY soc_code, task_id, task
),
us_emp AS (
    {_us_emp_sql(_code_sql('p_partkey'), 'p_name')}
    UNION ALL
    {_us_emp_sql("'25-1099'", "'Postsecondary Teachers'", jobs_missing=True)} WHERE p_partkey = {TEACHER_SOC_ROW_KEY}
),
metro_emp AS (
    SELECT {_code_sql('l_partkey')} AS occupation, CAST(s_nationkey AS BIGINT) AS area,
      'Area ' || CAST(s_nationkey AS VARCHAR) AS area_name, sum(l_quantity) AS jobs
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2, 3
),
metro_dim AS (
    SELECT CASE WHEN n_nationkey % {UNLISTED_METRO_EVERY} = {UNLISTED_METRO_EVERY - 1}
                THEN CAST(n_nationkey AS BIGINT) + {CODE_SHIFT} ELSE CAST(n_nationkey AS BIGINT) END AS cbsa,
      n_name AS cbsa_name, CASE WHEN r_name <> 'AFRICA' THEN r_name END AS size_class
    FROM nation JOIN region ON n_regionkey = r_regionkey
),
geography AS (
    SELECT CAST(CASE WHEN n_nationkey % {UNMAPPED_GEO_EVERY} = {UNMAPPED_GEO_EVERY - 1}
                     THEN CAST(n_nationkey AS BIGINT) + {CODE_SHIFT} ELSE CAST(n_nationkey AS BIGINT) END AS VARCHAR) AS geoid,
      n_name AS geo_name, CAST(-120.0 + n_nationkey * 2 AS DOUBLE) AS lon, CAST(30.0 + n_regionkey AS DOUBLE) AS lat
    FROM nation
),
staffing_cells AS (
    SELECT {_code_sql('l_partkey')} AS occupation,
      {ind_list}[CAST(l_suppkey % {len(INDUSTRY_CODES)} AS INTEGER) + 1] AS naics6_code,
      sum(l_quantity) AS jobs
    FROM lineitem GROUP BY 1, 2
),
staffing_long_src AS (
    SELECT o.occupation, i.naics6_code, coalesce(c.jobs, 0.0) AS jobs
    FROM (SELECT DISTINCT {_code_sql('l_partkey')} AS occupation FROM lineitem) o
    CROSS JOIN (VALUES {ind_values}) AS i(naics6_code)
    LEFT JOIN staffing_cells c ON c.occupation = o.occupation AND c.naics6_code = i.naics6_code
)"""
