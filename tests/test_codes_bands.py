"""Code rules and category rules (R1-R10, C1-C15)."""

from pyspark.sql import functions as F

from taskshift.functions import bands, codes


def test_codes(spark):
    df = spark.createDataFrame([("11-3031.01",), ("25-1011.00",), ("55-1234.00",)], "c string")
    out = df.select(codes.major_group("c").alias("g"), codes.soc6("c").alias("s"),
                    codes.soc6_collapsed("c").alias("sc"), codes.suffix_from(F.lit("Current Year Males"), 14).alias("sx")).collect()
    assert [r["g"] for r in out] == ["11-0000", "25-0000", "55-0000"]
    assert [r["s"] for r in out] == ["11-3031", "25-1011", "55-1234"]
    assert [r["sc"] for r in out] == ["11-3031", "25-1099", "55-1234"]
    assert out[0]["sx"] == "Males"


def test_sector_code(spark):
    vals = ["311111", "321111", "331111", "441111", "451111", "481111", "491111", "901111", "541111", "991111"]
    df = spark.createDataFrame([(v,) for v in vals], "n string")
    got = [r[0] for r in df.select(codes.sector_code("n")).collect()]
    assert got == ["31-33", "31-33", "31-33", "44-45", "44-45", "48-49", "48-49", "92", "54", "99"]


def test_ai_category_order_and_strictness(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.75, 1.0), (0.5, 0.0), (None, 1.0), (None, None), (1.0, None)],
                               "a double, g double")
    got = [r[0] for r in df.select(bands.ai_category("a", "g")).collect()]
    assert got == [bands.AUGMENTED, bands.AUTOMATED, bands.MINIMAL, bands.AUGMENTED, bands.MINIMAL, bands.AUTOMATED]


def test_task_weight_and_exposure(spark):
    df = spark.createDataFrame([("Core", 0.5), ("Supplemental", 0.0), (None, None), ("Other", 1.0)], "t string, b double")
    out = df.select(bands.task_weight("t").alias("w"), bands.has_exposure("b").alias("h")).collect()
    assert [r["w"] for r in out] == [2.0, 0.5, 1.0, 1.0]
    assert [r["h"] for r in out] == [1.0, 0.0, None, 1.0]


def test_wage_education_training_bands(spark):
    df = spark.createDataFrame([(17.99,), (18.0,), (23.0,), (36.99,), (37.0,), (None,)], "w double")
    assert [r[0] for r in df.select(bands.wage_band("w")).collect()] == ["<18", "18-23", "23-37", "23-37", "37+", None]
    e = spark.createDataFrame([("Master's degree",), ("Some college, no degree",), (None,), ("x",)], "e string")
    assert [r[0] for r in e.select(bands.education_band("e")).collect()] == [
        "4. Advanced Degree", "2. Some College", "Other", "Other"]
    t = spark.createDataFrame([("None",), ("N/A",), ("Apprenticeship",), (None,)], "t string")
    got = t.select(bands.training_band("t").alias("b"))
    got = got.select("b", bands.level_order("b", bands.TRAINING_ORDER).alias("o")).collect()
    assert [(r["b"], r["o"]) for r in got] == [("No On-The-Job Training", 1), ("Not Applicable", 5),
                                               ("Apprenticeship/Internship", 4), ("Other", 6)]


def test_interval_bin_right_closed_lowest_excluded(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,), (2.0,), (3.0,), (None,)], "x double")
    br = [F.lit(0.0), F.lit(1.0), F.lit(2.0)]
    got = [r[0] for r in df.select(bands.interval_bin("x", br)).collect()]
    assert got == [None, 1, 1, 2, 2, None, None]
    got = [r[0] for r in df.select(bands.interval_bin("x", br, include_lowest=True)).collect()]
    assert got[0] == 1


def test_column_selectors_and_names(spark):
    from taskshift.functions import columns as C
    df = spark.createDataFrame([("a", 1.0, 2, "x", 3.0)], ["O*NET-SOC Code", "Avg. Hourly Earnings", "2022 Jobs",
                                                          "Current Year Males", "gpt4_automation"])
    n = C.normalise_names(df)
    assert n.columns == ["soc_code", "avg_hourly_earnings", "jobs", "current_year_males", "gpt4_automation"]
    assert C.snake("Typical On-The-Job Training") == "typical_on_the_job_training"
    assert C.cols_between(n, "avg_hourly_earnings", "current_year_males") == ["avg_hourly_earnings", "jobs",
                                                                              "current_year_males"]
    assert C.numeric_cols(n) == ["avg_hourly_earnings", "jobs", "gpt4_automation"]
    assert C.cols_containing(n, "CURRENT") == ["current_year_males"]
    assert C.front(n, ["jobs"]).columns[:2] == ["jobs", "soc_code"]
    assert C.by_position(n, 3) == ["jobs", "current_year_males", "gpt4_automation"]
    assert C.display_names(n.select("soc_code", "jobs")).columns == ["O*NET-SOC Code", "2022 Jobs"]


def test_nan_is_missing_in_every_comparison(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 1.0), (2, nan, 0.0), (3, 0.9, 1.0), (4, None, 1.0)], "k int, a double, g double")
    got = {r["k"]: r for r in df.select(
        "k", bands.ai_category("a", "g").alias("cat"), bands.has_exposure("a").alias("exposed"), bands.at_least("a", 0.5).alias("flag"),
        bands.wage_band("a").alias("wage"), bands.interval_bin("a", [F.lit(0.0), F.lit(1.0), F.lit(9.0)]).alias("bin")).collect()}
    assert [got[k]["cat"] for k in (1, 2, 3, 4)] == [bands.AUGMENTED, bands.MINIMAL, bands.AUTOMATED, bands.AUGMENTED]
    for name in ("exposed", "flag", "wage", "bin"):
        assert [got[k][name] is None for k in (1, 2, 3, 4)] == [True, True, False, True], name
