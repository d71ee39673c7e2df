"""Every registered query beside its SQL, on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from verify import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{SF}/{table}.parquet"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


# the library's own; the corpus queries have tests of their own
OWN = {**contract.REPORT_QUERIES, **contract.JOB_QUERIES}


def test_every_query_has_sql():
    assert OWN.keys() <= contract.queries().keys()
    assert OWN.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "empno_pk" and df.count() == 6


@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert ok, note
