"""Failed-cell reports, delimiter and type guesses, atomic sinks."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from taskshift.sources import readers, reports, sinks, sniff


def put(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


# -- failed cells ------------------------------------------------------------------

def test_reader_reports_failed_cells_from_its_own_run(spark, tmp_path):
    p = put(tmp_path / "emp.csv", "SOC,Description,2022 Jobs,Avg. Hourly Earnings,Current Year Males\n"
            "11-1011,a,1000,99.5,1\n11-1012,b,n/a,NaN,2\n11-1013,c,\"1,234\",<10,x1\n11-1014,d,NA,<10,x2\n11-1015,e,*,12.5,\n")
    report = readers.ReadReport()
    df = readers.read_us_emp(spark, p, report)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    assert sorted((r["soc"], r["jobs"]) for r in df.collect()) == [("11-1011", 1000.0), ("11-1012", None), ("11-1013", 1234.0), ("11-1014", None), ("11-1015", None)]
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(jobs)
    got = {r["column"]: (r["type"], r["cells"], r["failed"], r["sample"]) for r in report.rows(spark).collect()}
    assert ran <= 1 and got == {"jobs": ("double", 4, 2, ["*", "n/a"]), "avg_hourly_earnings": ("double", 5, 2, ["<10"]),
                                "current_year_males": ("double", 4, 2, got["current_year_males"][3])}
    assert set(got["current_year_males"][3]) <= {"x1", "x2"} and got["current_year_males"][3]
    assert {r["column"] for r in report.rows(spark, only_failed=True).collect()} == set(got)


def test_every_reader_takes_a_report(spark, tmp_path):
    report = readers.ReadReport()
    for name, read, text in (("t", readers.read_tasks, "O*NET-SOC Code,Task ID,Task,gpt4_automation\n1,x,a,0.5\n2,7,b,high\n"),
                             ("s", readers.read_task_statements, "O*NET-SOC Code\tTask ID\tTask\n1\tseven\ta\n"),
                             ("m", readers.read_metro_emp, "Occupation,Area,Jobs\n1,10,2\n1,ten,3\n"),
                             ("w", readers.read_staffing, "2022 Jobs,Occupation,111110\nSOC,Description,Crop\n1,a,2.5\n")):
        read(spark, put(tmp_path / f"{name}.csv", text), report=report).collect()
    got = {(r["reader"], r["column"]): (r["cells"], r["failed"]) for r in report.rows(spark).collect()}
    assert got == {("tasks", "task_id"): (2, 1), ("tasks", "gpt4_automation"): (2, 1), ("task_statements", "task_id"): (1, 1),
                   ("metro_emp", "area"): (2, 1), ("metro_emp", "jobs"): (2, 0), ("staffing", "111110"): (2, 1)}


def test_failed_cells_table(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", None), (None, "7"), ("nan", "8,000"), ("1e3", "y"), ("one", "x")], "a string, `b.c` string")
    got = {r["column"]: r for r in reports.failed_cells(df, {"a": "double", "b.c": "bigint"}).collect()}
    assert (got["a"]["cells"], got["a"]["failed"], got["a"]["sample"]) == (5, 1, ["one"])
    assert (got["b.c"]["cells"], got["b.c"]["failed"], got["b.c"]["sample"]) == (5, 3, ["x", "y"])
    assert [r["failed"] for r in reports.failed_cells(df.limit(0), {"a": "double"}).collect()] == [0]


# -- guesses -----------------------------------------------------------------------

@pytest.mark.parametrize("sep", ["\t", ",", ";", "|"])
def test_delimiter_and_types_are_guessed(spark, tmp_path, sep):
    cells = [["code", "n", "x", "when", "at", "ok", "note"], ["007", "1", "1.5", "2020-01-31", "2020-01-31 10:00:00", "TRUE", "a, b; c | d"],
             ["008", '"1,234"', "2", "NA", "2020-02-01", "false", '"two\nlines, and ""quotes"""'], ["009", "", "1e3", "2021-12-01", "NA", "", "tab\there"]]
    quote = lambda c: c if c.startswith('"') or not any(s in c for s in "\t,;|") else f'"{c}"'
    p = put(tmp_path / "any.txt", "".join(sep.join(quote(c) for c in row) + "\n" for row in cells))
    g = sniff.sniff(spark, p)
    assert (g.sep, g.multiline, g.agreement) == (sep, True, 1.0)
    assert dict(zip(g.columns, g.types)) == {"code": "string", "n": "bigint", "x": "double", "when": "date", "at": "timestamp", "ok": "boolean", "note": "string"}
    df = readers.read_delimited(spark, p)
    assert dict(df.dtypes) == {"code": "string", "n": "bigint", "x": "double", "when": "date", "at": "timestamp", "ok": "boolean", "note": "string"}
    rows = {r["code"]: r for r in df.collect()}
    assert (rows["008"]["n"], rows["009"]["n"], rows["009"]["x"], rows["008"]["when"]) == (1234, None, 1000.0, None)
    assert rows["008"]["note"] == 'two\nlines, and "quotes"' and rows["007"]["note"] == "a, b; c | d"


def test_guess_of_odd_samples():
    assert sniff.guess([]).columns == [] and sniff.guess(["one column", "more text"]).types == ["string"]
    # commas in prose do not beat a tab in every line
    g = sniff.guess(["id\ttext", "1\ta, b, c", "2\td", "3\te, f"])
    assert (g.sep, g.types) == ("\t", ["bigint", "string"])
    # ragged lines: the delimiter most records agree on
    assert sniff.guess(["a;b;c", "1;2;3", "1;2", "4;5;6"]).sep == ";"
    # a sample that ends inside quotes
    assert sniff.guess(["a,b", "1,x", '2,"cut off']).types == ["bigint", "string"]
    order = [None, "bigint", "double", "date", "timestamp", "boolean", "string"]
    for a in order:
        for b in order:
            assert sniff.widen(a, b) == sniff.widen(b, a) and sniff.widen(a, sniff.widen(a, b)) == sniff.widen(a, b)


def test_declared_types_win_and_failures_are_reported(spark, tmp_path):
    p = put(tmp_path / "late.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(50)) + "50,late\n")
    report = readers.ReadReport()
    df = readers.read_delimited(spark, p, max_lines=20, report=report)
    assert dict(df.dtypes) == {"id": "bigint", "v": "bigint"} and df.where("v is null").count() == 1
    got = {r["column"]: (r["failed"], r["sample"]) for r in report.rows(spark).collect()}
    assert got["v"] == (1, ["late"])
    assert dict(readers.read_delimited(spark, p, {"v": "string"}).dtypes)["v"] == "string"


# -- atomic sinks --------------------------------------------------------------------

def test_a_failing_write_leaves_the_old_version(spark, tmp_path):
    out = str(tmp_path)
    old = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
    sinks.write_tables({"one": old, "figure 1": old}, out)
    broken = spark.range(5, numPartitions=5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        sinks.write_tables({"one": old.limit(1), "figure 1": broken}, out)
    assert sinks.read_table(spark, out, "one").count() == 5 and sinks.read_table(spark, out, "figure 1").count() == 5
    assert len(os.listdir(f"{out}/one")) == 1 and len(os.listdir(f"{out}/figure_1")) == 1          # nothing of the attempt stays
    sinks.write_table(old.limit(2), out, "one")
    assert sinks.read_table(spark, out, "one").count() == 2 and sinks.read_table(spark, out, "figure 1").count() == 5
    assert sinks.table_names(spark, out) == ["figure 1", "one"]
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, out, "two")


def test_readers_see_whole_versions_and_old_ones_go(spark, tmp_path):
    out = str(tmp_path)
    for n in (3, 4, 5):
        sinks.write_table(spark.range(n), out, "t")
    before = sinks.read_table(spark, out, "t")
    sinks.write_table(spark.range(6), out, "t")
    assert before.count() == 5                                             # a reader that had begun
    assert sinks.read_table(spark, out, "t").count() == 6 and len(os.listdir(f"{out}/t")) == 2
    # a commit whose writer died half-way does not count, and the next one follows it
    last = max(f for f in os.listdir(f"{out}/_commits") if f.endswith(".json"))
    put(f"{out}/_commits/{int(last[:-5]) + 1:012d}.json", '{"tables": {"t": ')
    assert sinks.read_table(spark, out, "t").count() == 6
    sinks.write_table(spark.range(7), out, "t", fmt="csv", sep=";")
    assert sinks.read_table(spark, out, "t").count() == 7


def test_writers_at_once_lose_no_table(spark, tmp_path):
    out, errors = str(tmp_path), []

    def write(k):
        try:
            sinks.write_table(spark.range(k), out, f"t{k}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [sinks.read_table(spark, out, f"t{k}").count() for k in range(1, 5)] == [1, 2, 3, 4]
