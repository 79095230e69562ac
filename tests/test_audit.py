"""Row accounting of whole runs, and the weighted summary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskshift.operators import audit as A
from taskshift.operators import weighted_sketch as W
from taskshift.operators.stats import gaussian_convolution, weighted_quantiles


def test_steps_of_a_chain(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, x string").repartition(3)
    right = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30), (7, 70)], "k int, y int")
    audit = A.Audit()
    kept = audit.where(left, F.col("x") != "e", "not e")
    inner = audit.join(kept, right, ["k"], "inner", "inner")
    outer = audit.join(inner.select("k", "x"), right, ["k"], "left", "null-safe", null_safe=True)
    out = audit.out(audit.into(outer, "per x").groupBy("x").agg(F.count("*").alias("n")), "per x")
    assert {r["x"]: r["n"] for r in out.collect()} == {"a": 4, "b": 4, "c": 1}
    got = [tuple(r)[1:] for r in audit.report(spark).orderBy("step").collect()]
    assert got == [("not e", "filter", 5, None, None, None, None, 1, 4), ("inner", "inner join", 4, 5, 5, 1, 2, 1, 5),
                   ("null-safe", "left join", 5, 5, 9, 0, 2, 0, 9), ("per x", "group", 9, None, None, None, None, None, 3)]


def test_audited_joins_are_the_plain_joins(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([None, *range(6)]), i) for i in range(40)], "k int, `a.b` int")
    right = spark.createDataFrame([(rng.choice([None, *range(3, 9)]), f"y{i}") for i in range(25)], "k int, y string")
    for how in ("inner", "left"):
        for only in (True, False):
            got = A.Audit().join(left, right, ["k"], how, "s", right_only=only)
            want = left.join(right, "k", how).select("k", "`a.b`", "y")
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    with pytest.raises(ValueError):
        A.Audit().join(left, right, ["k"], "full", "s")


def test_results_do_not_change_with_an_audit(spark):
    from taskshift.plans import exposure as E
    from taskshift.sources import standin as S
    from taskshift.sources.readers import intake
    sf = "/root/testdata/sf0.001"
    tasks, emp = intake(S.tasks(spark, sf)), S.us_emp(spark, sf)
    plain = E.group_beta_wage(E.soc_scores_employment(tasks, emp))
    audit = A.Audit()
    seen = E.group_beta_wage(E.soc_scores_employment(tasks, emp, audit), audit)
    key = lambda r: repr(r[0])
    for a, b in zip(sorted(map(tuple, plain.collect()), key=key), sorted(map(tuple, seen.collect()), key=key)):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    assert [r["name"] for r in audit.report(spark).orderBy("step").collect()] == ["mean per SOC", "national employment", "occupation group", "jobs known", "mean per group"]


# -- weighted summaries ---------------------------------------------------------------

def worst_rank(x, w, qs, probs):
    """Largest distance of a value's weighted rank from the asked one, as a share of all weight."""
    x, w = np.asarray(x), np.asarray(w)
    out = 0.0
    for q, p in zip(qs, probs):
        below, upto = w[x < q].sum() / w.sum(), w[x <= q].sum() / w.sum()
        out = max(out, below - p, p - upto)
    return out


@pytest.mark.parametrize("kind", ["even", "skewed", "one heavy", "ties"])
def test_weighted_summary_within_its_error(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=n) if kind != "ties" else rng.integers(0, 9, n).astype(float)
    w = {"even": np.ones(n), "ties": np.ones(n), "skewed": rng.pareto(0.8, n) + 0.01, "one heavy": np.where(np.arange(n) == 77, 1e7, 1.0)}[kind]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)] + [(None, 5.0), (1.0, None), (2.0, 0.0), (3.0, -1.0), (float("nan"), 2.0)], "x double, w double").repartition(6)
    probs, size = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], 100
    monkeypatch.setattr(W, "HELD", 300)
    row = W.quantiles_from_sketch(W.weighted_sketch(df, [], "x", "w", size), [], probs, [f"q{i}" for i in range(7)]).first()
    assert row["n"] == pytest.approx(w.sum()) and row["levels"] <= 3
    assert worst_rank(x, w, [row[f"q{i}"] for i in range(7)], probs) <= W.rank_error(row["levels"], size) + 1 / w.sum()


def test_weighted_summaries_by_group_merge(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else None, float(v), float(u)) for i, (v, u) in enumerate(zip(rng.exponential(size=4000), rng.pareto(1.1, 4000) + 0.1))]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    parts = [W.weighted_sketch(df.where(F.pmod(F.xxhash64("x"), F.lit(2)) == k), ["g"], "x", "w", 200) for k in (0, 1)]
    made = W.merge_sketches(parts[0].union(parts[1]), ["g"], 200)
    got = {r["g"]: r for r in W.quantiles_from_sketch(made, ["g"], [0.5], ["m"]).collect()}
    assert set(got) == {"a", None}
    for g, r in got.items():
        x, w = zip(*[(v, u) for k, v, u in rows if k == g])
        assert worst_rank(x, w, [r["m"]], [0.5]) <= W.rank_error(r["levels"], 200) + 1 / sum(w)


def test_weighted_quantiles_take_a_sketch_on_request(spark):
    df = spark.createDataFrame([(float(i), 10.0) for i in range(1, 101)], "x double, w double")
    exact, rough = (weighted_quantiles(df, "x", "w", [0.25, 0.5], ["a", "b"], sketch=s).first() for s in (None, 1000))
    assert exact["a"] == rough["a"] and exact["b"] == rough["b"]                  # few points: nothing is packed
    assert [tuple(r) for r in weighted_quantiles(df.limit(0), "x", "w", [0.5], ["m"], sketch=50).collect()] == [(None,)]


def test_packing_is_bounded_and_keeps_the_weight():
    rng = np.random.default_rng(9)
    for w in (np.ones(5000), rng.pareto(0.7, 5000), np.r_[np.ones(4999), 1e6]):
        x = rng.normal(size=5000)
        px, pw = W.pack(x, w, 50)
        assert len(px) <= 4 * 50 + 2 and pw.sum() == pytest.approx(w.sum()) and (np.diff(px) >= 0).all()


def test_convolution_is_the_sum_of_kernels():
    rng = np.random.default_rng(2)
    m = rng.random(64)
    step, bw = 0.1, 0.35
    at = step * np.arange(64)
    direct = (m[None, :] * np.exp(-0.5 * ((at[:, None] - at[None, :]) / bw) ** 2)).sum(axis=1) / (bw * np.sqrt(2 * np.pi))
    assert np.abs(gaussian_convolution(m, step, bw) - direct).max() < 1e-12 * direct.max()
