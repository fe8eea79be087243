"""Every registered query against its SQL twin in DuckDB, or for having rows."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from korpusgraf.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, str | bool | pd.Timestamp):
        return str(v)
    return round(float(v), 5)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sql_names_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_point_needs_no_session():
    """Queries can be listed before any session is made."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
