"""Properties from the test plan: bounds, shares summing to one, invariance
under repartitioning. Small example budgets: every example runs Spark."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskshift.functions.nulls import wmean
from taskshift.operators.ordering import global_row_number
from taskshift.plans import automation as A
from taskshift.sources import standin as S

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]),
                          st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)),
                          st.floats(0, 50, allow_nan=False)), min_size=1, max_size=40)


@SETTINGS
@given(rows)
def test_wmean_between_min_and_max(spark, data):
    df = spark.createDataFrame(data, "g string, x double, w double")
    out = df.groupBy("g").agg(wmean("x", "w").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    for r in out:
        if r["m"] is not None:
            assert r["lo"] - 1e-9 <= r["m"] <= r["hi"] + 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.floats(0, 1, allow_nan=False)), min_size=1, max_size=60),
       st.integers(1, 6))
def test_rank_is_a_permutation_under_any_partitioning(spark, data, parts):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id long, k long, v double")
    r = global_row_number(df, [("v", False, True), ("id", True, False)], "rank", partitions=parts)
    got = sorted(x["rank"] for x in r.collect())
    assert got == list(range(1, len(data) + 1))
    exp = sorted(range(len(data)), key=lambda i: (-data[i][1], i))
    by_id = {x["id"]: x["rank"] for x in r.collect()}
    assert [by_id[i] for i in exp] == list(range(1, len(data) + 1))


def test_shares_sum_to_one_and_repartition_invariance(spark):
    tasks = S.tasks(spark, "/root/testdata/sf0.001")
    stmts = S.task_statements(spark, "/root/testdata/sf0.001")
    share = A.occ_category_share(A.classify_tasks(tasks, stmts))
    sums = share.groupBy("soc_code", "title").agg(F.sum("pct_tasks").alias("t"), F.sum("pct_weighted").alias("w"))
    assert sums.where((F.abs(F.col("t") - 1) > 1e-9) | (F.abs(F.col("w") - 1) > 1e-9)).count() == 0
    again = A.occ_category_share(A.classify_tasks(tasks.repartition(7), stmts.repartition(3)))
    key = ["soc_code", "title", "ai_cat", "n", "n_weighted", "pct_tasks", "pct_weighted"]
    a = sorted(tuple(r) for r in share.select(*key).collect())
    b = sorted(tuple(r) for r in again.select(*key).collect())
    assert a == b
