"""Missing-value rules (M1-M17) on tiny literal frames."""

import math

from pyspark.sql import functions as F

from taskshift.functions.nulls import (if_else, in_set, mean_skip, mean_strict, nan_to_null, safe_div,
                                       sd_strict, sum_skip, sum_strict, wmean)

SCHEMA = "g string, x double, w double"


def _agg(spark, data, *cols):
    df = spark.createDataFrame(data, SCHEMA)
    return {r["g"]: r for r in df.groupBy("g").agg(*cols).collect()}


def test_means_and_sums(spark):
    data = [("a", 1.0, 1.0), ("a", None, 1.0), ("a", 3.0, 1.0),
            ("b", None, 1.0), ("b", None, 2.0),
            ("c", 2.0, 1.0), ("c", 4.0, 1.0)]
    r = _agg(spark, data, mean_skip("x").alias("ms"), mean_strict("x").alias("mt"),
             sum_skip("x").alias("ss"), sum_strict("x").alias("st"))
    assert r["a"]["ms"] == 2.0 and r["a"]["mt"] is None
    assert r["a"]["ss"] == 4.0 and r["a"]["st"] is None
    assert r["b"]["ms"] is None and r["b"]["ss"] == 0.0      # all missing: mean NULL, sum 0
    assert r["c"]["mt"] == 3.0 and r["c"]["st"] == 6.0


def test_wmean_rules(spark):
    data = [
        ("plain", 1.0, 1.0), ("plain", 3.0, 3.0),                 # (1 + 9) / 4
        ("xnull", None, 5.0), ("xnull", 2.0, 1.0),                # missing x dropped from both sums
        ("wnull", 1.0, None), ("wnull", 2.0, 1.0),                # missing weight on kept row -> NULL
        ("wnull_xnull", None, None), ("wnull_xnull", 2.0, 1.0),   # missing weight on dropped row is fine
        ("zero", 1.0, 0.0), ("zero", 2.0, 0.0),                   # zero total weight -> NULL
        ("allx", None, 1.0),
    ]
    r = _agg(spark, data, wmean("x", "w").alias("wm"), wmean("x", "w", "drop").alias("wd"))
    assert r["plain"]["wm"] == 2.5
    assert r["xnull"]["wm"] == 2.0
    assert r["wnull"]["wm"] is None and r["wnull"]["wd"] == 2.0
    assert r["wnull_xnull"]["wm"] == 2.0
    assert r["zero"]["wm"] is None
    assert r["allx"]["wm"] is None


def test_wmean_equal_weights_is_mean(spark):
    data = [("g", float(i), 3.0) for i in range(10)]
    r = _agg(spark, data, wmean("x", "w").alias("wm"), mean_skip("x").alias("m"))
    assert math.isclose(r["g"]["wm"], r["g"]["m"])


def test_sd_strict(spark):
    data = [("one", 1.0, 1.0), ("two", 1.0, 1.0), ("two", 3.0, 1.0), ("miss", 1.0, 1.0), ("miss", None, 1.0)]
    r = _agg(spark, data, sd_strict("x").alias("sd"))
    assert r["one"]["sd"] is None                       # one row: no sample sd
    assert math.isclose(r["two"]["sd"], math.sqrt(2.0))
    assert r["miss"]["sd"] is None                      # any missing -> missing


def test_scalar_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 2.0), (float("nan"), 1.0)], "a double, b double")
    out = df.select(
        safe_div("a", "b").alias("d"),
        if_else(F.col("a") > 0, F.lit(1), F.lit(0)).alias("ie"),
        in_set("a", [1.0]).alias("inn"),
        nan_to_null("a").alias("nn")).collect()
    assert [r["d"] for r in out][:3] == [None, None, None]   # x/0 and NULL/x are missing
    assert [r["ie"] for r in out][:3] == [0, 1, None]        # missing condition -> missing
    assert [r["inn"] for r in out][:3] == [False, True, False]
    assert out[3]["nn"] is None
