"""Every registered query against its SQL in DuckDB, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from seamline.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return repr(round(float(x), 6) + 0.0) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in pdf[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(oracle.execute(ORACLE_SQL[name]).df())
    assert got == want


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
