"""Readers for the real source files.

Headers carry display names (``O*NET-SOC Code``, ``2022 Jobs``...). Every file
is read as text with no schema inference, names are normalised to
snake_case once, and declared columns are then cast by name (``try_cast``:
an unparsable cell becomes NULL, as a failed numeric parse does in the
source; a grouping mark inside a number, as in ``1,234,567``, is dropped; NaN
becomes NULL). ``NA`` and empty cells are missing; ``None`` and ``N/A`` stay text
because the training levels use them as labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskshift.functions.columns import normalise_names
from taskshift.functions.nulls import nan_to_null, to_number
from taskshift.sources.reports import ReadReport
from taskshift.sources.sniff import MAX_LINES, sniff, typed_cell

TASK_TYPES = {"task_id": "bigint", "mean_rating_human_alpha": "double", "mean_rating_human_beta": "double",
              "mean_rating_human_gamma": "double", "gpt4_rubric1_alpha": "double", "gpt4_rubric1_beta": "double",
              "gpt4_rubric1_gamma": "double", "gpt4_rubric2_alpha": "double", "gpt4_rubric2_beta": "double",
              "gpt4_rubric2_gamma": "double", "gpt4_automation": "double"}
STATEMENT_TYPES = {"task_id": "bigint"}
US_EMP_TYPES = {"jobs": "double", "avg_hourly_earnings": "double", "median_hourly_earnings": "double"}
METRO_EMP_TYPES = {"area": "bigint", "jobs": "double"}


def _text(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Header + text columns. ``multiline`` only for files with quoted line
    breaks: it makes each file a single, unsplittable read."""
    return (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
            .option("nullValue", "NA").option("emptyValue", None).option("multiLine", multiline)
            .option("escape", '"').csv(path))


def _typed(df: DataFrame, types: dict[str, str], prefix_types: dict[str, str] | None = None, report: ReadReport | None = None,
           reader: str = "") -> DataFrame:
    """Declared columns cast by name. With a report, cells that fail are counted in the same pass."""
    declared = {c: types.get(c) or next((v for p, v in (prefix_types or {}).items() if c.startswith(p)), None) for c in df.columns}
    if report:
        df = report.watch(df, {c: t for c, t in declared.items() if t}, reader)
    return df.select(*[to_number(F.col(f"`{c}`"), t).alias(c) if t else F.col(f"`{c}`") for c, t in declared.items()])


def intake(df: DataFrame) -> DataFrame:
    """The frame with NaN as NULL in every floating-point column: the rule for
    frames that do not come through a reader of this module."""
    return df.select(*[nan_to_null(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def read_tasks(spark: SparkSession, path: str, multiline: bool = False, report: ReadReport | None = None) -> DataFrame:
    """Task ratings CSV: one row per (occupation, task) with score columns."""
    df = normalise_names(_text(spark, path, multiline=multiline))
    return _typed(df, TASK_TYPES, {"mean_rating_": "double", "gpt4_": "double"}, report, "tasks")


def read_task_statements(spark: SparkSession, path: str, sep: str | None = "\t", multiline: bool = False,
                         report: ReadReport | None = None) -> DataFrame:
    """O*NET task statements (tab-delimited text; ``sep=None``: the delimiter is guessed)."""
    if sep is None:
        guess = sniff(spark, path)
        sep, multiline = guess.sep, multiline or guess.multiline
    return _typed(normalise_names(_text(spark, path, sep, multiline)), STATEMENT_TYPES, None, report, "task_statements")


def read_us_emp(spark: SparkSession, path: str, report: ReadReport | None = None) -> DataFrame:
    """National employment by 6-digit SOC (jobs, wages, education, training, demographics)."""
    df = normalise_names(_text(spark, path))
    return _typed(df, US_EMP_TYPES, {"current_year_": "double"}, report, "us_emp")


def read_metro_emp(spark: SparkSession, path: str, report: ReadReport | None = None) -> DataFrame:
    """Employment by (occupation, metro area)."""
    return _typed(normalise_names(_text(spark, path)), METRO_EMP_TYPES, None, report, "metro_emp")


def read_staffing(spark: SparkSession, path: str, report: ReadReport | None = None) -> DataFrame:
    """Wide staffing matrix, every column kept as text (cells are converted
    after the unpivot). The first column is renamed ``occupation_label``; a report
    counts the cells of the industry columns (the third on) that are not numbers."""
    df = _text(spark, path)
    df = df.withColumnRenamed(df.columns[0], "occupation_label")
    return report.watch(df, dict.fromkeys(df.columns[2:], "double"), "staffing") if report else df


def read_delimited(spark: SparkSession, path: str, types: dict[str, str] | None = None, max_lines: int | None = None,
                   report: ReadReport | None = None) -> DataFrame:
    """Any delimited text file: delimiter, quoted line breaks and, unless declared, column types are guessed.

    ``types`` (by snake_case name) wins over a guess; a type guessed from the
    file's first lines may not hold further on, which a report shows.
    """
    guess = sniff(spark, path, max_lines or MAX_LINES)
    raw = _text(spark, path, guess.sep, guess.multiline)
    named = normalise_names(raw)
    by_name = dict(zip(named.columns, guess.types)) | (types or {})
    numbers = {c: t for c, t in by_name.items() if t in ("bigint", "double")}
    if report:
        named = report.watch(named, numbers, path)
    return named.select(*[typed_cell(c, by_name.get(c, "string")).alias(c) for c in named.columns])


def read_metro_json(spark: SparkSession, path: str) -> DataFrame:
    """Metro metadata document: the ``geos`` array of records as a table."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.inline("geos"))
