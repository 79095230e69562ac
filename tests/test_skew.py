"""A hot occupation holding a third of all task rows: results stay exact."""

from pyspark.sql import functions as F

from taskshift.plans import automation as A
from taskshift.sources import standin as S

SF = "/root/testdata/sf0.001"


def test_hot_occupation(spark):
    tasks = S.tasks(spark, SF)
    stmts = S.task_statements(spark, SF)
    hot = "11-100000000.01"
    # every third task row is moved to one occupation code (statements follow,
    # so the join key stays matched): a third of all rows on one key
    move = (F.col("task_id") % 3 == 0)
    skewed = tasks.withColumn("soc_code", F.when(move, F.lit(hot)).otherwise(F.col("soc_code")))
    smt = stmts.join(tasks.select("soc_code", "task_id", "task").distinct(), ["soc_code", "task_id", "task"], "left_semi")
    smt = smt.withColumn("soc_code", F.when(F.col("task_id") % 3 == 0, F.lit(hot)).otherwise(F.col("soc_code")))
    smt = smt.dropDuplicates(["soc_code", "task_id", "task"])
    classified = A.classify_tasks(skewed, smt)
    share = A.occ_category_share(classified).toPandas()
    # brute force with pandas on the same inputs
    t = skewed.toPandas()
    s = smt.toPandas()
    m = t.merge(s, on=["soc_code", "task_id", "task"], how="left")
    m["ai_cat"] = [
        "more likely automated" if (a == a and a > 0.5) else ("more likely augmented" if g == 1 else "minimal impact")
        for a, g in zip(m["gpt4_automation"], m["gpt4_rubric1_gamma"])]
    m["w"] = m["task_type"].map({"Core": 2.0, "Supplemental": 0.5}).fillna(1.0)
    g = m.groupby(["soc_code", "title", "ai_cat"]).agg(n=("w", "size"), nw=("w", "sum")).reset_index()
    g["pct_tasks"] = g["n"] / g.groupby(["soc_code", "title"])["n"].transform("sum")
    g["pct_weighted"] = g["nw"] / g.groupby(["soc_code", "title"])["nw"].transform("sum")
    assert (share["soc_code"] == hot).sum() > 0
    got = share.set_index(["soc_code", "title", "ai_cat"]).sort_index()
    exp = g.set_index(["soc_code", "title", "ai_cat"]).sort_index()
    assert len(got) == len(exp)
    assert (got["n"].to_numpy() == exp["n"].to_numpy()).all()
    assert ((got["pct_weighted"] - exp["pct_weighted"]).abs() < 1e-12).all()
    hot_rows = int(exp.loc[hot]["n"].sum())
    assert hot_rows >= 0.3 * len(t)              # the hot key really holds about a third of the rows
    rank = A.occ_automation_rank(classified).toPandas()
    assert sorted(rank["rank"]) == list(range(1, len(rank) + 1))
