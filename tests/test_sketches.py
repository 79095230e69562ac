"""Sketch profiles against exact ones: stated errors, merging, one scan."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskshift.operators import sketches, stats


@pytest.fixture(scope="module")
def table(spark):
    """Skewed numbers, nearly unique texts, few texts, dates, flags, NaN and missing values, and a name with a dot."""
    rng = random.Random(8)
    day = datetime.date(2020, 1, 1)
    rows = [(rng.paretovariate(1.2), float("nan") if i % 50 == 0 else rng.randrange(4) / 4, f"id-{rng.randrange(30_000)}", rng.choice(["a", "a", "b", "", " ", None]),
             None if i % 9 == 0 else day + datetime.timedelta(days=rng.randrange(500)), rng.random() < 0.3, i, i % 3) for i in range(20_000)]
    return spark.createDataFrame(rows, "`x.y` double, few double, id string, t string, d date, flag boolean, n long, part int").repartition(7).cache()


def quartiles_off(values, got):
    """Largest distance, as a share of the rows, of a reported quartile from its rank."""
    v = np.sort(np.array(values, dtype=float))
    out = []
    for p, g in zip((0.25, 0.5, 0.75), got):
        below, upto = np.searchsorted(v, g, "left") / len(v), np.searchsorted(v, g, "right") / len(v)
        out.append(max(0.0, below - p, p - upto))
    return max(out)


def check(spark, table, got):
    exact = {r["skim_variable"]: r for r in stats.profile(table.select(*[F.nanvl(f"`{c}`", F.lit(None).cast("double")).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in table.dtypes])).collect()}
    got = {r["skim_variable"]: r for r in got.collect()}
    assert set(got) == set(exact)
    for c, e in exact.items():
        g = got[c]
        for f in ("skim_type", "n_missing", "complete_rate", "p0", "p100", "min_len", "max_len", "n_empty", "n_whitespace", "n_true", "n_false", "first_at", "last_at"):
            assert g[f] == e[f], (c, f)
        for f in ("mean", "sd"):
            assert g[f] == pytest.approx(e[f], rel=1e-9) if e[f] is not None else g[f] is None, (c, f)
        if e["n_unique"] is not None:
            assert abs(g["n_unique"] - e["n_unique"]) <= 4 * sketches.distinct_error() * e["n_unique"], c
        if e["skim_type"] == "numeric":
            values = [r[0] for r in table.where(f"not isnan(`{c}`)").select(f"`{c}`").collect()]
            assert quartiles_off(values, (g["p25"], g["p50"], g["p75"])) <= sketches.rank_error() + 1 / len(values), c
            assert len(g["hist"]) == stats.HIST_BINS
    assert got["t"]["top_counts"] == exact["t"]["top_counts"]
    assert got["few"]["hist"] == exact["few"]["hist"]


def test_sketch_profile_within_its_errors(spark, table):
    check(spark, table, sketches.profile_sketch(table))


def test_merged_parts_give_the_profile_of_the_whole(spark, table):
    """Sketches of parts, written and read again, then merged."""
    parts = sketches.column_sketches(table.withColumn("cut", F.col("n") % 5), ["cut"])
    assert parts.count() == 5 * len(table.columns)
    check(spark, table, sketches.profile_from_sketches(sketches.merge_sketches(parts)))
    by = sketches.profile_from_sketches(sketches.merge_sketches(parts, ["cut"]), ["cut"])
    counts = {r["cut"]: r["n_true"] for r in by.where("skim_variable = 'flag'").collect()}
    assert counts == {r["k"]: r["c"] for r in table.groupBy((F.col("n") % 5).alias("k")).agg(F.count_if("flag").alias("c")).collect()}


def test_one_scan_and_no_exchange_of_values(spark):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("t"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    plan = sketches.profile_sketch(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan and plan.count("Range (") == 1


def test_sketches_of_empty_and_textless_tables(spark):
    empty = sketches.profile_sketch(spark.createDataFrame([], "a double, b string, c date, d binary")).collect()
    assert [(r["n_missing"], r["p50"], r["hist"]) for r in empty] == [(0, None, None)] * 4
    assert [r["skim_type"] for r in empty] == ["numeric", "character", "date", "other"]
    one = spark.createDataFrame([(3.0, None), (3.0, None)], "a double, b double")
    got = {r["skim_variable"]: r for r in sketches.profile_from_sketches(sketches.merge_sketches(sketches.column_sketches(one))).collect()}
    assert (got["a"]["p50"], got["a"]["sd"], got["a"]["hist"]) == (3.0, 0.0, "▁▁▁▇▁▁▁▁") and got["b"]["mean"] is None and got["b"]["hist"] is None


def test_audit_flags(table):
    rows = sketches.sketch_audit(table.drop("few")).collect()
    assert all(r["exact_ok"] for r in rows) and all(r["rank_ok"] for r in rows if r["skim_type"] == "numeric")
    assert all(r["distinct_ok"] for r in rows if r["n_unique"] is not None)
    rough = sketches.sketch_audit(table.select("id", "n"), lg=4, k=8).collect()
    assert len(rough) == 2
