"""Every query against its SQL at the smallest scale."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import compare
from workloads.common import TABLES

SF = "/root/testdata/sf0.001"
# The operators for training text have tests of their own.
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    ok, _, note = compare(spark, db, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
