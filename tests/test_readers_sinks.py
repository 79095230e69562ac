"""Source readers and sinks on small files written to a scratch folder."""

import json
import os
import tempfile

from taskshift.sources import readers, sinks
from taskshift.plans import exposure as E


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_tasks_csv_names_types_missing(spark):
    d = tempfile.mkdtemp(prefix="taskshift-read-")
    p = _write(os.path.join(d, "ratings.csv"),
               "O*NET-SOC Code,Task ID,Task,Title,gpt4_rubric1_beta,gpt4_automation\n"
               '11-1011.00,8823,"Direct, plan ""budgets""",Chief Executives,0.5,NA\n'
               "11-1011.00,8824,Approve,Chief Executives,,0.75\n")
    df = readers.read_tasks(spark, p)
    assert df.columns == ["soc_code", "task_id", "task", "title", "gpt4_rubric1_beta", "gpt4_automation"]
    rows = df.orderBy("task_id").collect()
    assert rows[0]["task"] == 'Direct, plan "budgets"'
    assert rows[0]["gpt4_automation"] is None and rows[1]["gpt4_rubric1_beta"] is None
    assert dict(df.dtypes)["task_id"] == "bigint" and dict(df.dtypes)["gpt4_automation"] == "double"


def test_read_statements_tsv_and_us_emp_labels(spark):
    d = tempfile.mkdtemp(prefix="taskshift-read-")
    p = _write(os.path.join(d, "stat.txt"), "O*NET-SOC Code\tTask ID\tTask\tTask Type\n11-1011.00\t8823\tDirect\tCore\n")
    st = readers.read_task_statements(spark, p)
    assert st.columns == ["soc_code", "task_id", "task", "task_type"] and st.first()["task_type"] == "Core"
    q = _write(os.path.join(d, "emp.csv"),
               "SOC,Description,2022 Jobs,Avg. Hourly Earnings,Typical On-The-Job Training,Current Year Males\n"
               "11-1011,Chief Executives,1000,99.5,None,600\n15-1252,Developers,NA,60,N/A,\n")
    emp = readers.read_us_emp(spark, q)
    assert emp.columns == ["soc", "description", "jobs", "avg_hourly_earnings", "training", "current_year_males"]
    r = {x["soc"]: x for x in emp.collect()}
    assert r["11-1011"]["training"] == "None" and r["15-1252"]["training"] == "N/A"   # labels, not missing
    assert r["15-1252"]["jobs"] is None and r["11-1011"]["jobs"] == 1000.0


def test_read_staffing_then_long(spark):
    d = tempfile.mkdtemp(prefix="taskshift-read-")
    p = _write(os.path.join(d, "staff.csv"),
               "2022 Jobs,Occupation,111110,311110\nSOC,Description,Crop,Food\n11-1011,CEO,12.5,<10\n")
    long = E.staffing_long(readers.read_staffing(spark, p))
    got = {x["naics6_code"]: x["jobs"] for x in long.collect()}
    assert got == {"111110": 12.5, "311110": None}


def test_read_metro_json(spark):
    d = tempfile.mkdtemp(prefix="taskshift-read-")
    p = _write(os.path.join(d, "meta.json"), json.dumps(
        {"title": "x", "geos": [{"cbsa": 35620, "cbsa_name": "New York", "size_class": "Very large"},
                                {"cbsa": 10180, "cbsa_name": "Abilene", "size_class": None}]}))
    g = readers.read_metro_json(spark, p)
    r = {x["cbsa"]: x for x in g.collect()}
    assert r[35620]["cbsa_name"] == "New York" and r[10180]["size_class"] is None


def test_write_table_display_names(spark):
    out = tempfile.mkdtemp(prefix="taskshift-sink-")
    df = spark.createDataFrame([("11-1011", 10.0)], "soc string, jobs double")
    p = sinks.write_table(df, out, "figure 1", fmt="csv")
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["SOC", "2022 Jobs"]
    p2 = sinks.write_table(df, out, "exposure_Metro")
    assert spark.read.parquet(p2).count() == 1


def test_category_columns_get_their_labels_in_csv(spark):
    out = tempfile.mkdtemp(prefix="taskshift-sink-")
    df = spark.createDataFrame([(0.5, 0.25)], "pct_tasks_more_likely_automated double, pct_weighted_minimal_impact double")
    back = spark.read.option("header", True).csv(sinks.write_table(df, out, "automation_category_occupation", fmt="csv"))
    assert back.columns == ["pct_tasks_more likely automated", "pct_weighted_minimal impact"]


def test_percent_label(spark):
    from taskshift.functions.labels import percent_label
    df = spark.createDataFrame([(0.1234,), (None,)], "p double")
    r = [tuple(x) for x in df.select(percent_label("p").alias("a"), percent_label("p", 1).alias("b")).collect()]
    assert r == [("12.3%", "12%"), (None, None)]


def test_nan_and_grouping_marks(spark):
    d = tempfile.mkdtemp(prefix="taskshift-intake-")
    with open(f"{d}/emp.csv", "w") as f:
        f.write('SOC,2022 Jobs,Avg. Hourly Earnings\n11-1011,"1,234,567",NaN\n11-1012,"12,34",12.5\n11-1013,-7,"2,000.5"\n')
    r = {x["soc"]: (x["jobs"], x["avg_hourly_earnings"]) for x in readers.read_us_emp(spark, f"{d}/emp.csv").collect()}
    assert r == {"11-1011": (1234567.0, None), "11-1012": (None, 12.5), "11-1013": (-7.0, 2000.5)}
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, n int")
    assert [tuple(x) for x in readers.intake(df).collect()] == [(None, 1), (2.0, None)]


def _inputs(spark, sf="/root/testdata/sf0.001"):
    from taskshift.sources import standin as S
    names = ("tasks", "task_statements", "us_emp", "metro_emp", "metro_dim", "staffing_wide")
    return {n: readers.intake(getattr(S, n)(spark, sf)) for n in names}


def test_publish_all(spark):
    from taskshift.plans.publish import AUTOMATION_SHEETS, EXPOSURE_SHEETS, publish_all
    out = tempfile.mkdtemp(prefix="taskshift-publish-")
    paths = publish_all(_inputs(spark), out, sheets=["figure 1", "automation_Metro"])
    assert set(paths) == {"figure 1", "automation_Metro"}
    assert spark.read.parquet(paths["figure 1"]).count() > 0
    assert len(EXPOSURE_SHEETS) + len(AUTOMATION_SHEETS) == 10


def test_publish_every_sheet(spark):
    from taskshift.plans.publish import AUTOMATION_SHEETS, EXPOSURE_SHEETS, publish_all
    out = tempfile.mkdtemp(prefix="taskshift-publish-all-")
    paths = publish_all(_inputs(spark), out)
    assert set(paths) == set(EXPOSURE_SHEETS + AUTOMATION_SHEETS)
    for p in paths.values():
        assert spark.read.parquet(p).count() > 0


def test_preview_is_sorted_top_n(spark):
    from pyspark.sql import functions as F
    from taskshift.operators.ordering import top_k
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v"))
    got = [r["v"] for r in top_k(df, [("v", False, True)], 5).collect()]
    assert got == [99, 98, 97, 96, 95]
    got = [r["v"] for r in sinks.preview(df, [F.col("v").asc()], 3).collect()]
    assert got == [0, 1, 2]
