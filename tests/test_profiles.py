"""Profiles over digests: plans without texts, merged states, many tables at once, ties behind long starts."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.functions.cells import canonicalize_cells
from tablescope.operators import profiling as P, rows as Q, values as V
from tablescope.plans.report import roles_of_tables

LONG = "the same long start of a text that goes on for more than sixty-four characters, and then "


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, f"{LONG}{k % 7}", [" 12 ", "3.5", "n/a", "(4)", None][k % 5], float(k % 4), k % 3 == 0,
             datetime.datetime(2024, 1, 1 + k % 9, 0, 0, 0, k % 2)) for k in range(200)]
    return spark.createDataFrame(rows, "id long, text string, raw string, x double, flag boolean, at timestamp")


def as_dicts(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_scalars(mixed):
    got = as_dicts(P.column_stats(mixed))
    assert [got[c]["inferred_type"] for c in mixed.columns] == ["integer", "string", "number", "integer", "boolean", "date"]
    assert [got[c]["unique_count"] for c in mixed.columns] == [200, 7, 3, 4, 2, 18]
    assert got["raw"]["missing"] == 80 and got["raw"]["min"] == -4.0 and got["text"]["avg_length"] == len(LONG) + 1
    assert got["at"]["first_date"] == "2024-01-01" and got["at"]["last_date"] == "2024-01-09"


def test_text_and_typed_tables_agree(mixed):
    typed, text = as_dicts(P.column_stats(mixed)), as_dicts(P.column_stats(canonicalize_cells(mixed)))
    for column in mixed.columns:
        for key in ("inferred_type", "unique_count", "missing", "min", "max", "mean", "avg_length", "first_date"):
            assert typed[column][key] == pytest.approx(text[column][key]), (column, key)


def test_no_exchange_carries_a_text(mixed):
    plan = P.column_stats(mixed)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text#" not in line


def test_states_merge(mixed):
    names = mixed.columns
    parts = [V.column_values(mixed.filter(F.col("id") % 3 == k), names) for k in range(3)]
    whole = P.scalars_of(V.merged_values(parts), ["column"])
    assert as_dicts(whole) == as_dicts(P.column_stats(mixed))


def test_tables_share_a_job(spark, mixed):
    empty = mixed.filter("id < 0").select("id", "text")
    got = {(r["dataset_id"], r["column"]): r for r in P.scalars_of_tables({"a": mixed, "b": empty}).collect()}
    assert len(got) == len(mixed.columns) + 2
    assert got["b", "text"]["total"] == 0 and got["b", "text"]["inferred_type"] == "string" and got["b", "text"]["column_index"] == 1
    alone = as_dicts(P.column_stats(mixed, "a"))
    assert {c: r.asDict() for (t, c), r in got.items() if t == "a"} == alone
    assert roles_of_tables({"a": mixed, "b": empty}).count() == len(got)


def test_top_values_behind_a_long_start(spark):
    rows = [(f"{LONG}{k:03d}",) for k in range(50)] + [(f"{LONG}777",)] * 3 + [("short",)] * 2
    got = [(r["rank"], r["value"], r["count"]) for r in P.top_values(spark.createDataFrame(rows, "t string"), limit=4).orderBy("rank").collect()]
    assert got == [(1, f"{LONG}777", 3), (2, "short", 2), (3, f"{LONG}000", 1), (4, f"{LONG}001", 1), (5, "+ 48 more", 48)]


def test_top_values_by_key(mixed):
    got = Counter()
    for r in P.top_values(mixed, ["text", "x"], limit=3, by=["flag"]).collect():
        got[r["flag"], r["column"]] += r["count"]
    assert got == {(True, "text"): 67, (True, "x"): 67, (False, "text"): 133, (False, "x"): 133}


def test_pages_without_an_order(spark):
    df = spark.range(25_000).repartition(3)
    pages = [Q.page_rows(df, p, 5_000) for p in range(5)]
    rows = [r for page in pages for r in page.collect()]
    assert all(page.count() == 5_000 for page in pages) and {r["row_number"] for r in rows} == set(range(1, 25_001))
    last = Q.page_rows(df, 99, 10_000)
    assert sorted(r["row_number"] for r in last.collect()) == list(range(20_001, 25_001))
