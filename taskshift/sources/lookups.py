"""The two fixed lookup tables (occupation major groups, industry sectors).

Both are tiny and of fixed size (22 and 20 rows), so they are always joined
with an explicit broadcast hint: their size bound is proven by the literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# ---------------------------------------------------------------------------
# SOC major groups (occ_2, occ_group, short_name).
# ---------------------------------------------------------------------------
OCC_GROUPS = [
    ("11-0000", "Management", "Management"),
    ("13-0000", "Business and Financial Operations", "Business and Financial"),
    ("15-0000", "Computer and Mathematical", "Computer and Mathematical"),
    ("17-0000", "Architecture and Engineering", "Architecture and Engineering"),
    ("19-0000", "Life, Physical, and Social Science", "Science"),
    ("21-0000", "Community and Social Service", "Community and Social Service"),
    ("23-0000", "Legal", "Legal"),
    ("25-0000", "Educational Instruction and Library", "Education and Library"),
    ("27-0000", "Arts, Design, Entertainment, Sports, and Media", "Arts and Media"),
    ("29-0000", "Healthcare Practitioners and Technical", "Healthcare Practitioners and Technical"),
    ("31-0000", "Healthcare Support", "Healthcare Support"),
    ("33-0000", "Protective Service", "Protective Service"),
    ("35-0000", "Food Preparation and Serving Related", "Food Service"),
    ("37-0000", "Building and Grounds Cleaning and Maintenance", "Cleaning and Maintenance"),
    ("39-0000", "Personal Care and Service", "Personal Care and Service"),
    ("41-0000", "Sales and Related", "Sales"),
    ("43-0000", "Office and Administrative Support", "Office and Administrative Support"),
    ("45-0000", "Farming, Fishing, and Forestry", "Farming and Forestry"),
    ("47-0000", "Construction and Extraction", "Construction and Extraction"),
    ("49-0000", "Installation, Maintenance, and Repair", "Installation and Repair"),
    ("51-0000", "Production", "Production"),
    ("53-0000", "Transportation and Material Moving", "Transportation and Moving"),
]

# ---------------------------------------------------------------------------
# NAICS sectors (naics2_code, sector, naics_short_name).
# ---------------------------------------------------------------------------
SECTORS = [
    ("11", "Agriculture, Forestry, Fishing and Hunting", "Agriculture"),
    ("21", "Mining, Quarrying, and Oil and Gas Extraction", "Mining"),
    ("22", "Utilities", "Utilities"),
    ("23", "Construction", "Construction"),
    ("31-33", "Manufacturing", "Manufacturing"),
    ("42", "Wholesale Trade", "Wholesale Trade"),
    ("44-45", "Retail Trade", "Retail Trade"),
    ("48-49", "Transportation and Warehousing", "Transportation"),
    ("51", "Information", "Information"),
    ("52", "Finance and Insurance", "Finance"),
    ("53", "Real Estate and Rental and Leasing", "Real Estate"),
    ("54", "Professional, Scientific, and Technical Services", "Professional Services"),
    ("55", "Management of Companies and Enterprises", "Management"),
    ("56", "Administrative and Support and Waste Management and Remediation Services", "Administrative Services"),
    ("61", "Educational Services", "Education"),
    ("62", "Health Care and Social Assistance", "Health Care"),
    ("71", "Arts, Entertainment, and Recreation", "Arts"),
    ("72", "Accommodation and Food Services", "Accommodation"),
    ("81", "Other Services (except Public Administration)", "Other Services"),
    ("92", "Public Administration", "Public Administration"),
]

OCC_GROUP_SCHEMA = StructType([StructField("occ_2", StringType(), False),
                               StructField("occ_group", StringType(), False),
                               StructField("short_name", StringType(), False)])
SECTOR_SCHEMA = StructType([StructField("naics2_code", StringType(), False),
                            StructField("sector", StringType(), False),
                            StructField("naics_short_name", StringType(), False)])


_TABLES: dict[tuple[int, str], DataFrame] = {}


def _inline_table(spark: SparkSession, rows, schema: StructType) -> DataFrame:
    """A literal table as an inline VALUES relation (a LocalRelation: no RDD,
    no Python worker to read it), built once per session."""
    cols = [f.name for f in schema.fields]
    key = (id(spark), ",".join(cols))
    hit = _TABLES.get(key)
    if hit is None or hit.sparkSession is not spark:
        hit = _TABLES[key] = spark.sql(f"SELECT * FROM {values_sql(rows, cols)}")
    return hit


def occ_groups(spark: SparkSession) -> DataFrame:
    """22-row major-group lookup, broadcast-hinted (fixed size)."""
    return F.broadcast(_inline_table(spark, OCC_GROUPS, OCC_GROUP_SCHEMA))


def sectors(spark: SparkSession) -> DataFrame:
    """20-row sector lookup, broadcast-hinted (fixed size)."""
    return F.broadcast(_inline_table(spark, SECTORS, SECTOR_SCHEMA))


def values_sql(rows, cols) -> str:
    """A lookup as an SQL VALUES list (inline table in Spark, and in the DuckDB oracle)."""
    def q(v):
        return "'" + v.replace("'", "''") + "'"
    body = ",\n    ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS t({', '.join(cols)})"
