"""Every panel query against its SQL twin in DuckDB, on the smallest driver tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelscope.plans import catalog, catalogues, designs, draws, events, fitted, frontiers, inferences, joins, providers, relations, results, rules, scores, streams, studies  # noqa: F401

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | streams.QUERIES, catalog.SQL | streams.SQL
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v != v:
        return "NULL"
    # an integer column with nulls is one of doubles in pandas
    return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
