"""Operators against small tables worked out by hand, and invariants."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablescope.operators import aggregates as A, checks as K, facts as N, profiling as P, rows as Q, statements as D
from tablescope.operators.carry import carry_forward
from tablescope.operators.roles import infer_roles
from tablescope.plans import documents as plan
from tablescope.plans.report import plan_report
from tablescope.sources import delimited, files, pages as G, sheets as S, xml as X
from tablescope.sources.headers import unique_names


def frame(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def test_breakdown_pools_the_rest(spark):
    df = frame(spark, ["k", "v"], [(f"k{i % 12}", str(i)) for i in range(120)] + [("NA", "x")])
    rows = A.group_breakdown(df, "k", "v", "mean", limit=3).orderBy("position").collect()
    assert sum(r["count"] for r in rows) == 121
    assert rows[-1]["value"] == "+ 10 more"
    rest = [i for i in range(120) if i % 12 not in (9, 10, 11)]
    assert abs(rows[-1]["total"] - sum(rest) / len(rest)) < 1e-9


def test_empty_aggregates_are_zero(spark):
    df = frame(spark, ["k", "v"], [])
    assert A.measure_summary(df, ["v"]).first().asDict() == {"measure": "v", "count": 0, "sum": 0.0, "mean": 0.0, "min": 0.0, "max": 0.0}
    assert A.aggregate_value(df, "v", "mean").first()["value"] == 0.0
    assert A.time_series(df, "k").count() == 0
    assert A.histogram(df, "v").count() == 0


def test_median_is_exact_for_hard_distributions(spark):
    random.seed(3)
    groups = {
        "even": [1.0, 2.0, 3.0, 10.0], "one": [5.0], "same": [7.0] * 999, "two": [1.0] * 500 + [2.0] * 500,
        "skew": [random.lognormvariate(0, 8) for _ in range(20_001)], "hot": [0.0] * 10_000 + [random.random() for _ in range(5_000)],
        "negative": [-random.random() for _ in range(4_000)],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, _x double").repartition(8)
    found = {r["g"]: r["median"] for r in P.medians(rows, ["g"]).collect()}
    assert found == {g: statistics.median(vs) for g, vs in groups.items()}


def test_profile_of_text(spark):
    rows = [(str(i), "yes" if i % 2 else "no", "2024-01-%02d" % (i % 28 + 1), "", "1.5" if i else "x", f"v{i % 15}") for i in range(40)]
    df = frame(spark, ["account no", "flag", "day", "void", "amount", "many"], rows)
    found = {r["column"]: r for r in P.profile(df).collect()}
    assert {c: r["inferred_type"] for c, r in found.items()} == {
        "account no": "integer", "flag": "boolean", "day": "date", "void": "string", "amount": "number", "many": "string"}
    assert found["void"]["missing_pct"] == 100.0 and found["void"]["unique_count"] == 0
    assert found["amount"]["mean"] == 1.5 and [b["count"] for b in found["amount"]["histogram"]] == [39]
    assert sum(v["count"] for v in found["many"]["top_values"]) == 40
    assert found["many"]["top_values"][-1]["value"] == "+ 7 more"
    assert (found["day"]["first_date"], found["day"]["last_date"]) == ("2024-01-01", "2024-01-28")
    roles = {r["column"]: (r["role"], r["cardinality"]) for r in infer_roles(P.column_stats(df, "t")).collect()}
    assert roles == {
        "account no": ("identifier", "unique"), "flag": ("boolean", "low"), "day": ("temporal", "medium"), "void": ("categorical", "constant"),
        "amount": ("measure", "low"), "many": ("categorical", "medium")}


def test_type_threshold(spark):
    ninety_five = [(str(i),) for i in range(95)] + [("x",)] * 5
    assert P.infer_types(frame(spark, ["a"], ninety_five)).first()["inferred_type"] == "integer"
    assert P.infer_types(frame(spark, ["a"], ninety_five + [("x",)])).first()["inferred_type"] == "string"


def test_sort_is_natural_and_missing_last(spark):
    df = frame(spark, ["n"], [("item 10",), ("Item 9",), ("",), ("åre",), ("Are 2",), (None,), ("item 9b",)])
    up = [r["n"] for r in Q.sort_rows(df, "n").collect()]
    assert up[:5] == ["åre", "Are 2", "Item 9", "item 9b", "item 10"] and set(up[5:]) == {"", None}
    down = [r["n"] for r in Q.sort_rows(df, "n", desc=True).collect()]
    assert down[0] == "item 10" and set(down[5:]) == {"", None}


def test_carry_forward_over_blocks(spark):
    random.seed(1)
    rows = [(g, i, random.choice([None, None, None, "a", "b", "c"])) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, v string").repartition(7)
    out = carry_forward(df, ["g"], ["i"], F.floor(F.col("i") / 16), {"w": "v"}).orderBy("g", "i").collect()
    last, expected = {}, []
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        expected.append((g, i, last[g]))
    assert [(r["g"], r["i"], r["w"]) for r in out] == expected


INCOME = [("Revenue", 100.0, 90.0), ("Cost of goods sold", -40.0, -35.0), ("Operating profit", 60.0, 55.0), ("Income tax expense", -10.0, -9.0),
          ("Net income", 50.0, 46.0)]
BALANCE = [("Total assets", 300.0, 280.0), ("Total equity", 200.0, 190.0), ("Total liabilities", 100.0, 90.0), ("Cash and cash equivalents", 20.0, 0.0)]
CASH = [("Net cash from operating activities", 30.0, 25.0)]


def statement_facts(spark):
    rows, number = [], 0
    for statement, lines in (("Income statement", INCOME), ("Balance sheet", BALANCE), ("Cash flow statement", CASH)):
        for label, now, before in lines:
            for period, amount in (("FY 2025", now), ("FY 2024", before)):
                number += 1
                rows.append(("d", statement, statement, "", label, "Amount", period, amount, "NOK", "", "", number))
    return spark.createDataFrame(rows, "doc_id string, sheet string, statement string, section string, line_item string, metric string, "
                                       "period string, amount double, unit string, note string, source_row string, row_no long")


def test_analysis(spark):
    facts = statement_facts(spark)
    checks = {r["label"]: r["status"] for r in N.analysis_checks(facts).collect()}
    assert checks == {"Balance sheet equation": "ok", "Primary statement coverage": "ok"}
    shown = {r["label"]: (r["current_value"], r["prior_value"], r["change_pct"]) for r in N.highlights(facts).collect()}
    assert shown["Revenue"] == (100.0, 90.0, 10 / 90 * 100) and shown["Cash and cash equivalents"] == (20.0, 0.0, None)
    summary = N.analysis_summary(facts).first()
    assert summary["periods"] == ["FY 2025", "FY 2024"] and abs(summary["confidence"] - (0.38 + 0.12 + 0.12 + 20 / 500)) < 1e-9


def test_document_from_facts(spark):
    parts = plan.documents_from_items(D.items_from_facts(statement_facts(spark)))
    checks = {(r["kind"], r["period"]): r["status"] for r in parts["checks"].collect()}
    assert checks[("balance_sheet_equation", "FY 2025")] == checks[("balance_sheet_equation", "FY 2024")] == "pass"
    assert checks[("period_consistency", None)] == "pass"
    figures = parts["key_figures"].filter("concept = 'revenue' and period = 'FY 2024'").collect()
    assert [f["value"] for f in figures] == [90.0]
    assert parts["documents"].first()["row_count"] == 10


def test_document_from_text(spark):
    text = "\n".join(["Consolidated income statement", "Amounts in NOK thousand   2025   2024", *[f"{n}   {a:,.0f}   {b:,.0f}" for n, a, b in INCOME]])
    page2 = "\n".join(["Balance sheet", *[f"{n}   7   {a:,.0f}   {b:,.0f}" for n, a, b in BALANCE]])
    pages = spark.createDataFrame([("d", 1, text), ("d", 70, page2), ("e", 1, "nothing here")], "doc_id string, page_no int, text string")
    parts = plan.documents_from_pages(pages)
    lines = {(r["page_no"], r["line_no"]): (r["kind"], r["parsed"]) for r in parts["lines"].filter("doc_id = 'd'").collect()}
    assert lines[(1, 0)] == ("income_statement", False) and lines[(70, 1)] == ("balance_sheet", True)
    items = {(r["label"], r["period"]): r["value"] for r in parts["items"].collect()}
    assert items[("Revenue", "FY 2025")] == 100.0 and items[("Total assets 7", "FY 2024")] == 280.0
    document = {r["doc_id"]: r for r in parts["documents"].collect()}["d"]
    assert (document["currency"], document["scale"]) == ("NOK", "thousands")


def test_route_falls_through(spark):
    wide = spark.createDataFrame([("d", i, n, a, b) for i, (n, a, b) in enumerate(INCOME)], "doc_id string, row_no int, `Line item` string, `2025` double, `2024` double")
    assert {r["route"] for r in plan.items_route(wide, "row_no").collect()} == {2}
    found = N.is_wide_statement(wide.drop("doc_id", "row_no")).first()
    assert found["is_wide"] and found["label_column"] == "Line item" and found["statement"] == "Income statement"


def test_empty_statement_and_unavailable_check(spark):
    items = D.items_from_facts(statement_facts(spark).filter("statement = 'Income statement'"))
    summary = {r["statement"]: r["row_count"] for r in D.statement_summary(D.statement_membership(items)).collect()}
    assert summary == {"income_statement": 5, "balance_sheet": 0, "cash_flow": 0}
    status = {r["status"] for r in K.balance_equation_check(items, D.choose_periods(items)).collect()}
    assert status == {"not_available"}


def test_report_plan(spark):
    df = frame(spark, ["day", "team", "place", "goals"], [("2024-01-%02d" % (i % 28 + 1), f"t{i % 5}", f"p{i % 3}", str(i % 4 - 1)) for i in range(60)])
    parts = plan_report(infer_roles(P.column_stats(df, "match-results.csv")))
    assert [r["kind"] for r in parts["views"].orderBy("rank").collect()] == [
        "keyMeasures", "timeTrend", "categoryBreakdown", "distribution", "crossTab", "detailTable"]
    assert parts["overview"].first()["title"] == "Match Results"
    assert parts["kind"].first()["kind"] == "Time series / periodic measurements"


def test_headers():
    assert unique_names(["a", "", "a", " a "]) == ["a", "Column 2", "a (1)", "a (2)"]
    assert unique_names(["a", "a"], first_repeat=2) == ["a", "a (2)"]
    assert [files.file_kind(*x) for x in (("a.PDF",), ("a.ods",), ("a.xbrl",), ("a.csv", "application/pdf"), ("a", "text/xml"), ("a",))] == [
        "pdf", "sheet", "xml", "delimited", "xml", "delimited"]


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Name, Name ,,n\n"a, b",1,2,3\n , ,,\nshort,1\nlong,1,2,3,4\n')
    df = delimited.read_delimited(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["Name", "Name (1)", "Column 3", "n"]
    assert [tuple(r) for r in df.collect()][0] == ("a, b", "1", "2", "3") and df.count() == 3
    assert sorted(r["row"] for r in delimited.read_issues(spark, str(tmp_path / "x.csv")).collect()) == ["long,1,2,3,4", "short,1"]
    (tmp_path / "y.tsv").write_text("a\tb\n1\t2\n")
    assert {k: v.count() for k, v in files.read_any(spark, str(tmp_path)).items()} == {"csv": 3, "tsv": 1}


def test_tables_without_rows(spark, tmp_path):
    def written(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    header, blank, empty = written("h.csv", "a,b\n"), written("b.csv", "\n a,b\n , \n,\n"), written("e.csv", " \n\n")
    some = written("s.csv", "a,c,d\n1,2,3\n,,\n1\n1,2,3,4\n")
    for path, rows in ((header, 0), (blank, 0), (some, 3)):
        df, seen = delimited.read_delimited(spark, path), delimited.read_summary(spark, path).first()
        assert df.count() == rows == seen["rows"] and (seen["error"] == delimited.NO_ROWS) == (rows == 0)
        if rows:
            assert delimited.require_rows(df) is df
        else:
            with pytest.raises(delimited.TableError, match="no rows"):
                delimited.require_rows(df)
    assert tuple(delimited.read_summary(spark, [blank, some]).first()) == (4, 3, 3, 2, None)
    for failing in (lambda: delimited.read_summary(spark, empty), lambda: delimited.require_rows(spark.createDataFrame([], "struct<>"))):
        with pytest.raises(delimited.TableError, match="no columns"):
            failing()


def test_fragments_seed_rule(spark):
    rows = [("d", 1, 10.0, 100.0, 20.0, "a"), ("d", 1, 40.0, 98.0, 5.0, "b"), ("d", 1, 46.0, 97.0, 5.0, "c"), ("d", 1, 10.0, 96.0, 5.0, "next"), ("d", 1, 9.0, 50.0, 5.0, " ")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, x double, y double, w double, str string")
    assert G.fragments_to_lines(df).first()["text"] == "a   b c\nnext"


def test_sheet_sections_and_notes(spark):
    grid = [["Balance sheet", None, None, None], ["Item", "Note", "2025", "2024"], ["Assets", None, None, None], ["Cash", "3", "10", "(5)"],
            ["Debt", None, None, None], ["Loans", "4", "7", None]]
    cells = [("w", "s", r, c, v, None) for r, row in enumerate(grid) for c, v in enumerate(row) if v]
    df = spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, text string, num double")
    facts = {(r["section"], r["line_item"], r["period"]): (r["amount"], r["note"], r["source_row"]) for r in S.sheet_facts(df).collect()}
    assert facts == {("Assets", "Cash", "FY 2025"): (10.0, "3", "Row 4"), ("Assets", "Cash", "FY 2024"): (-5.0, "3", "Row 4"), ("Debt", "Loans", "FY 2025"): (7.0, "4", "Row 6")}


def test_bad_xml_is_reported(spark):
    docs = spark.createDataFrame([(1, "<a><b x='1'>t<c/>u</b></a>"), (2, "<a><b></a>")], "doc_id int, text string")
    parsed = X.parse_documents(docs)
    assert [r["doc_id"] for r in X.xml_issues(parsed).collect()] == [2]
    flat = [(r["Path"], r["Text"], r["Attributes"], r["Child Count"]) for r in X.flatten_xml(X.xml_elements(parsed)).orderBy("node_id").collect()]
    assert flat == [("/a", "", "", 1), ("/a/b", "t u", 'x="1"', 1), ("/a/b/c", "", "", 0)]


def test_plans_stay_distributed(spark):
    """Rankings limit rows per task, and groups are read from one shuffle."""
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    text = P.top_values(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text
    text = A.group_breakdown(df, "k", "v", "sum")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text
