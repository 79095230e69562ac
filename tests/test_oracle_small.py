"""Every registered query against its DuckDB SQL twin at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries, reference_queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("test tables not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(reference_queries()) <= set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "gpt4_rubric1_beta" in df.columns


@pytest.mark.parametrize("name", sorted(reference_queries()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    sp = df.toPandas()
    assert "BatchEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    od = con.execute(oracle_sql()[name]).df()
    sc, sr = _rows(sp)
    oc, orr = _rows(od)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr
