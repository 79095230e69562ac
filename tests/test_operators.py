"""Operators against brute force on small inputs."""

import math
import random

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from taskshift.operators.joins import join_null_safe, join_report
from taskshift.operators.ordering import global_row_number, prefix_sum, stacked_midpoint
from taskshift.operators.reshape import split_last, to_long, to_wide, very_wide_to_long
from taskshift.operators.shares import attach_group_stats, share_of_total, share_within, threshold_summary
from taskshift.operators.stats import (box_summary, density_grid, group_quantiles, histogram, linear_trend,
                                       profile, weighted_quantiles)


def test_to_long_keeps_nulls_and_to_wide_roundtrip(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "id string, x double, y double")
    long = to_long(df, ["id"], ["x", "y"])
    assert long.count() == 4                                  # the NULL cell is kept
    wide = to_wide(long, ["id"], "name", ["x", "y"], {"value": ""})
    assert sorted(map(tuple, wide.select("id", "x", "y").collect())) == [("a", 1.0, None), ("b", 2.0, 3.0)]


def test_to_wide_fill_vs_missing(spark):
    df = spark.createDataFrame([("a", "k1", 1.0), ("b", "k2", 2.0)], "id string, k string, v double")
    nofill = {r["id"]: r for r in to_wide(df, ["id"], "k", ["k1", "k2"], {"v": "p"}).collect()}
    fill = {r["id"]: r for r in to_wide(df, ["id"], "k", ["k1", "k2"], {"v": "p"}, fill=0.0).collect()}
    assert nofill["a"]["p_k2"] is None and fill["a"]["p_k2"] == 0.0


def test_very_wide_to_long(spark):
    cols = [f"c{i:03d}" for i in range(300)]
    df = spark.createDataFrame([("r1", *[str(i) for i in range(300)])], ["id", *cols])
    long = very_wide_to_long(df, ["id"], cols, "k", "v")
    assert long.count() == 300
    assert long.where(F.col("k") == "c123").first()["v"] == "123"


def test_split_last(spark):
    df = spark.createDataFrame([("mean_rating_human_alpha",), ("gpt4_rubric1_beta",)], "name string")
    a, b = split_last("name")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("mean_rating_human", "alpha"), ("gpt4_rubric1", "beta")]


def test_prefix_sum_and_rank_match_pandas(spark):
    random.seed(7)
    data = [(i, random.choice([None, 1.0, 2.0, 3.0, 4.0]), random.randint(1, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v double, w long")
    got = prefix_sum(df, [("v", False, True), ("id", True, False)], "w", "cum", partitions=7).toPandas()
    pdf = pd.DataFrame(data, columns=["id", "v", "w"])
    pdf["vkey"] = pdf["v"].fillna(-1e9)
    pdf = pdf.sort_values(["vkey", "id"], ascending=[False, True])
    pdf["cum"] = pdf["w"].cumsum()
    m = got.merge(pdf[["id", "cum"]], on="id", suffixes=("", "_exp"))
    assert (m["cum"] == m["cum_exp"]).all() and len(m) == 500
    rk = global_row_number(df, [("v", False, True), ("id", True, False)], "rank", partitions=5).toPandas()
    pdf["rank"] = range(1, 501)
    m = rk.merge(pdf[["id", "rank"]], on="id", suffixes=("", "_exp"))
    assert (m["rank"] == m["rank_exp"]).all()


def test_prefix_sum_hot_key_is_split(spark):
    # one value holds a third of the rows: the range partitioning still splits it
    data = [(i, 1.0 if i % 3 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, v double")
    got = global_row_number(df, [("v", True, False), ("id", True, False)], "rank", partitions=6)
    assert got.agg(F.max("rank")).first()[0] == 3000
    assert got.select("rank").distinct().count() == 3000


def test_group_quantiles_match_numpy(spark):
    random.seed(3)
    data = [(random.choice(["a", "b", None]), random.choice([None, round(random.random(), 3)])) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    pdf = pd.DataFrame(data, columns=["g", "x"]).dropna(subset=["x"])
    for g, sub in pdf.groupby(pdf["g"].fillna("<null>")):
        key = None if g == "<null>" else g
        exp = np.quantile(sub["x"].to_numpy(), [0.0, 0.25, 0.5, 0.9, 1.0])   # linear = type 7
        r = got[key]
        assert r["n"] == len(sub)
        for name, e in zip(["q0", "q0_25", "q0_5", "q0_9", "q1"], exp):
            assert math.isclose(r[name], e, abs_tol=1e-12)


def _hmisc_like(x, w, probs):
    """Frequency-weighted quantile as described in weighted_quantiles' docstring."""
    df = pd.DataFrame({"x": x, "w": w}).dropna()
    df = df[df.w > 0].groupby("x", as_index=False)["w"].sum().sort_values("x")
    cum, vals, n = df["w"].cumsum().to_numpy(), df["x"].to_numpy(), df["w"].sum()
    def v(t):
        return vals[np.argmax(cum >= t)]
    out = []
    for p in probs:
        pos = 1 + (n - 1) * p
        low = max(math.floor(pos), 1)
        high = min(low + 1, n)
        frac = pos - math.floor(pos)
        out.append((1 - frac) * v(low) + frac * v(high))
    return out


def test_weighted_quantiles_match_reference_rule(spark):
    random.seed(11)
    data = [(float(random.randint(0, 50)), random.choice([None, 0.0, 1.0, 2.0, 5.0])) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, w double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = weighted_quantiles(df, "x", "w", probs).first()
    exp = _hmisc_like([d[0] for d in data], [d[1] for d in data], probs)
    assert [round(got[i], 9) for i in range(5)] == [round(e, 9) for e in exp]


def test_box_summary_whiskers_and_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals] + [("g", None)], "k string, x double")
    r = box_summary(df, ["k"], "x").first()
    q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    assert (r["lower"], r["middle"], r["upper"]) == (q1, med, q3)
    assert r["ymin"] == 1.0 and r["ymax"] == 8.0 and r["n_outliers"] == 1 and r["n"] == 9


def test_histogram_chart_bins(spark):
    # range [0, 1], 11 bins -> width 0.1, centres 0, 0.1, ..., 1.0; right-closed bins
    data = [("a", 0.0), ("a", 0.05), ("a", 0.5), ("b", 1.0), ("b", 0.96), ("b", 0.25)]
    df = spark.createDataFrame(data, "f string, x double")
    out = histogram(df, ["f"], "x", 11).collect()
    assert len(out) == 22                                   # every bin of every facet
    got = {(r["f"], r["bin"]): r["count"] for r in out if r["count"] > 0}
    # 0.05 sits on the boundary between bins 0 and 1 -> lower bin; 0.25 -> bin 2; 0.96 -> bin 10
    assert got == {("a", 0): 2, ("a", 5): 1, ("b", 2): 1, ("b", 10): 2}
    r = [x for x in out if x["f"] == "a" and x["bin"] == 5][0]
    assert math.isclose(r["x"], 0.5) and math.isclose(r["xmin"], 0.45) and math.isclose(r["xmax"], 0.55)


def test_density_grid_matches_direct_kde(spark):
    random.seed(5)
    xs = [random.random() for _ in range(300)]
    df = spark.createDataFrame([("c", x) for x in xs], "f string, x double")
    got = density_grid(df, "f", "x", grid=256).toPandas().sort_values("i")
    a = np.array(xs)
    q1, q3 = np.quantile(a, [0.25, 0.75])
    bw = 0.9 * min(a.std(ddof=1), (q3 - q1) / 1.34) * len(a) ** -0.2
    gx = got["x"].to_numpy()
    direct = np.exp(-0.5 * ((gx[:, None] - a[None, :]) / bw) ** 2).sum(axis=1) / (len(a) * bw * math.sqrt(2 * math.pi))
    assert np.max(np.abs(direct - got["density"].to_numpy())) < 0.02 * direct.max()
    assert abs(np.trapezoid(got["density"].to_numpy(), gx) - 1.0) < 0.01


def test_shares_and_group_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 4.0)], "g string, v double")
    sw = {(r["g"], r["v"]): r["s"] for r in share_within(df, ["g"], "v", "s").collect()}
    assert sw[("a", 1.0)] == 0.25 and sw[(None, 4.0)] == 1.0
    st = [r["s"] for r in share_of_total(df, "v", "s").orderBy("v").collect()]
    assert st == [0.125, 0.375, 0.5]
    gs = {r["v"]: r["m"] for r in attach_group_stats(df, ["g"], [F.avg("v").alias("m")]).collect()}
    assert gs == {1.0: 2.0, 3.0: 2.0, 4.0: 4.0}       # NULL group matched to itself


def test_threshold_summary_counts_add_up(spark):
    df = spark.createDataFrame([(0.6, 10.0), (0.4, 20.0), (None, 30.0), (0.9, None)], "b double, j double")
    out = threshold_summary(df, F.col("b") >= 0.5, "cutoff", {"jobs": "j"}).collect()
    by = {r["cutoff"]: r for r in out}
    assert by[True]["count"] == 2 and by[True]["jobs"] == 10.0
    assert by[None]["count"] == 1 and by[False]["jobs"] == 20.0
    assert math.isclose(sum(r["pct_count"] for r in out), 1.0)
    assert math.isclose(sum(r["pct_jobs"] for r in out), 1.0)


def test_join_report(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "k string")
    r = join_report(left, right, ["k"]).first()
    assert (r["left_rows"], r["right_rows"]) == (4, 4)
    assert (r["left_matched_rows"], r["left_only_rows"]) == (3, 1)
    assert (r["right_matched_rows"], r["right_only_rows"]) == (3, 1)
    assert (r["left_duplicate_keys"], r["right_duplicate_keys"]) == (1, 1)
    assert r["inner_rows"] == left.join(right, "k").count()
    assert r["left_join_rows"] == left.join(right, "k", "left").count()


def test_join_null_safe(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert sorted(tuple(r) for r in join_null_safe(a, b, ["k"]).select("a", "b").collect()) == [(1, 10), (2, 20)]


def test_stacked_midpoint_and_trend(spark):
    df = spark.createDataFrame([("t", "a", 0.2), ("t", "b", 0.8)], "p string, c string, v double")
    got = {r["c"]: r["m"] for r in stacked_midpoint(df, ["p"], [("c", False, True)], "v", "m").collect()}
    assert math.isclose(got["b"], 0.4) and math.isclose(got["a"], 0.9)
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    r = linear_trend(line, "y", "x").first()
    assert math.isclose(r["slope"], 2.0) and math.isclose(r["intercept"], 1.0) and math.isclose(r["r2"], 1.0)


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "ab"), (None, ""), (3.0, None)], "x double, s string")
    p = {r["skim_variable"]: r for r in profile(df).collect()}
    assert p["x"]["n_missing"] == 1 and p["x"]["mean"] == 2.0 and p["x"]["p50"] == 2.0
    assert math.isclose(p["x"]["complete_rate"], 2 / 3)
    assert p["s"]["n_missing"] == 1 and p["s"]["n_empty"] == 1 and p["s"]["max_len"] == 2 and p["s"]["n_unique"] == 2


def test_approx_box_close_to_exact(spark):
    data = [("g", float(i % 97)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, x double")
    ex = box_summary(df, ["k"], "x").first()
    ap = box_summary(df, ["k"], "x", approx=True).first()
    assert ap["n"] == ex["n"] == 2000 and ap["n_outliers"] == ex["n_outliers"] == 0
    for c in ("lower", "middle", "upper"):
        assert abs(ap[c] - ex[c]) <= 1.0


def test_audited_filter(spark):
    from taskshift.operators.joins import audited_filter
    df = spark.range(100)
    out, obs = audited_filter(df, F.col("id") % 4 == 0, "keep_quarters")
    assert out.count() == 25
    assert obs.get == {"rows_in": 100, "rows_kept": 25, "rows_removed": 75}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "g string, x double, w double")
    assert global_row_number(df, [("x", True, False)], "rank").count() == 0
    assert group_quantiles(df, ["g"], "x", [0.5]).count() == 0
    assert box_summary(df, ["g"], "x").count() == 0
    assert histogram(df, ["g"], "x").count() == 0
    r = weighted_quantiles(df, "x", "w", [0.0, 1.0]).collect()
    assert len(r) == 1 and r[0][0] is None


def test_profile_histogram_and_top_counts(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.integers(0, 50, 400)] + [None, 49.0, 0.0]
    t = [["pear", "fig", "", "kiwi", "plum", None][i % 6] if i % 7 else "pear" for i in range(len(x))]
    df = spark.createDataFrame([(a, b, 5.0, None) for a, b in zip(x, t)], "x double, t string, one double, none double")
    p = {r["skim_variable"]: r for r in profile(df).collect()}
    v = np.array([a for a in x if a is not None])
    # published rule: bins of equal width, closed on the right, the lowest value in the first; bars by sixths of the highest
    bins = np.maximum(1, np.ceil((v - v.min()) / (v.max() - v.min()) * 8)).astype(int)
    counts = [int((bins == k + 1).sum()) for k in range(8)]
    assert p["x"]["hist"] == "".join("▁▂▃▅▆▇"[max(1, -(-6 * c // max(counts))) - 1] for c in counts)
    assert p["one"]["hist"] == "▁▁▁▇▁▁▁▁" and p["none"]["hist"] is None and p["t"]["hist"] is None
    top = sorted(Counter(b for b in t if b is not None).items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    assert p["t"]["top_counts"] == ", ".join(f"{k}: {n}" for k, n in top) and p["x"]["top_counts"] is None
