"""The queries of the text operators that SQL can express, against that SQL."""

import duckdb
import pytest

from check_queries import compare
from tablescope.llm.queries import ORACLES, QUERIES
from workloads.common import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ok, _, note = compare(spark, db, SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
