"""Physical-plan properties that matter at scale."""

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_broadcast(spark):
    plan = _plan(queries()["group_beta_wage"](spark, SF))
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = _plan(queries()["score_disagreement"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rank_has_no_single_partition_exchange_over_rows(spark):
    from pyspark.sql import functions as F
    from taskshift.operators.ordering import global_row_number
    df = spark.range(10000).select((F.col("id") % 97).alias("v"), "id")
    out = global_row_number(df, [("v", False, True), ("id", True, False)], "rank", partitions=8)
    lines = [ln for ln in out._jdf.queryExecution().executedPlan().toString().splitlines() if ln.strip()]
    singles = [i for i, ln in enumerate(lines) if "SinglePartition" in ln]
    assert singles, "offsets window expected"
    for i in singles:   # only the per-slice totals (keyed by slice id) pass through one partition
        assert "HashAggregate(keys=[__pid" in lines[i + 1]
    assert out.agg(F.max("rank")).first()[0] == 10000


def _no_broadcast(spark, name):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return _plan(queries()[name](spark, SF))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_metros_are_summed_before_the_dimension(spark):
    for name in ("metro_scores", "category_by_metro"):
        lines = _no_broadcast(spark, name).splitlines()
        join = next(i for i, ln in enumerate(lines) if "SortMergeJoin [cbsa_code" in ln)
        depth = lines[join].index("SortMergeJoin")
        below = [ln for ln in lines[join + 1:] if len(ln) - len(ln.lstrip(" :+-*()0123456789")) > depth]
        # the join's left side is the aggregate by area, and the employment join lies under it
        first = next(i for i, ln in enumerate(below) if "HashAggregate(keys=[" in ln)
        assert "cbsa_code" in below[first]
        assert any("SortMergeJoin [occupation" in ln for ln in below[first:])


def test_sectors_are_folded_without_a_row_per_industry(spark):
    from taskshift.sources import standin as S
    for name in ("sector_scores", "category_by_sector"):
        plan = _plan(queries()[name](spark, SF))
        assert "naics6_code" not in plan and "Generate inline" in plan
    assert len(S.INDUSTRY_CODES) > 20


def test_missing_task_text_matches_missing_task_text(spark):
    from taskshift.plans.automation import classify_tasks
    t = spark.createDataFrame([("11-1011.00", 1, None, "a", 0.0, 0.0)],
                              "soc_code string, task_id bigint, task string, title string, gpt4_automation double, gpt4_rubric1_gamma double")
    s = spark.createDataFrame([("11-1011.00", 1, None, "Core")], "soc_code string, task_id bigint, task string, task_type string")
    r = classify_tasks(t, s).first()
    assert (r["task_type"], r["task_weights"]) == ("Core", 2.0)


def test_rank_reads_tasks_and_statements_once_each(spark):
    """Read from the plan that builds the ranked rows: lineitem once for tasks, once for statements."""
    from taskshift.plans import automation as A
    from taskshift.sources import standin as S
    w = A.occ_weighted_shares(A.classify_tasks(S.tasks(spark, SF), S.task_statements(spark, SF)))
    plan = _plan(w)
    assert plan.count("lineitem.parquet") == 2


def test_one_value_window_per_quantile_table(spark):
    from pyspark.sql import functions as F
    from taskshift.operators.stats import group_quantiles
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 31 % 997).cast("double").alias("x"))
    plan = _plan(group_quantiles(df, ["g"], "x", [0.25, 0.5]))
    # the running sums are checkpointed, so only the window over the slice totals is left
    assert all("__ptot" in ln for ln in plan.splitlines() if "Window [" in ln)


def test_profile_has_a_row_for_every_type(spark):
    import datetime
    from decimal import Decimal

    from taskshift.operators.stats import profile
    day, at = datetime.date(2024, 2, 1), datetime.datetime(2024, 2, 1, 10)
    df = spark.createDataFrame([(Decimal("1.5"), True, day, 3, "a", 7, at, [1]), (None, False, None, 5, "", 9, at, None)],
                               "d decimal(5,2), b boolean, day date, t tinyint, s string, l bigint, at timestamp, arr array<int>")
    p = {r["skim_variable"]: r for r in profile(df).collect()}
    assert set(p) == set(df.columns)
    assert (p["d"]["skim_type"], p["d"]["mean"], p["d"]["n_missing"]) == ("numeric", 1.5, 1)
    assert (p["t"]["p50"], p["l"]["sd"]) == (4.0, 2 ** 0.5)
    assert (p["b"]["n_true"], p["b"]["n_false"], p["b"]["mean"]) == (1, 1, 0.5)
    assert (p["day"]["first_at"], p["day"]["n_unique"]) == ("2024-02-01", 1) and p["at"]["last_at"] == "2024-02-01 10:00:00"
    assert (p["arr"]["skim_type"], p["arr"]["n_missing"], p["s"]["n_empty"]) == ("other", 1, 1)
    q = {r["skim_variable"]: r for r in profile(df, approx=["l"]).collect()}
    assert (q["l"]["p0"], q["l"]["p100"], q["l"]["mean"]) == (7.0, 9.0, 8.0)
    assert [r["skim_variable"] for r in profile(spark.createDataFrame([], "b boolean")).collect()] == ["b"]


def test_checkpoint_folder_is_shared_or_refused():
    import pytest

    from taskshift import session

    class Conf:
        get = staticmethod(lambda key, default=None: default)
        set = staticmethod(lambda key, value: None)

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), Conf

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session("local-cluster[2,1,1024]"))
    assert session.checkpoint_dir(Session("local[2]"))
