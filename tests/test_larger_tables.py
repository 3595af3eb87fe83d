"""Values and layouts that only larger tables bring."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tablescope.functions.cells import canonicalize_cells
from tablescope.operators import profiling as P, statements as D
from tablescope.sources import xml as X
from workloads import documents as workload


def test_negative_zero_keeps_its_sign(spark):
    rows = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.5), (4, -3.0)], "doc_id long, x double")
    got = D.dataset_raw_lines(rows.withColumn("n", F.col("doc_id")), "n").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["-0", "0", "-0.5", "-3"]
    for df in (rows, canonicalize_cells(rows)):
        stats = {r["column"]: r for r in P.column_stats(df).collect()}["x"]
        assert (stats["unique_count"], stats["avg_length"], stats["min"], stats["inferred_type"]) == (4, 2.25, -3.0, "number")


INSTANCE = """<xbrl><context id="c"><entity><identifier>old</identifier></entity><period><instant>2019-12-31</instant></period></context>
<context id="c"><entity><identifier> new </identifier></entity><period><startDate>2020-01-01</startDate><endDate>2020-12-31</endDate></period>
<scenario><explicitMember dimension="a:RegionAxis">m:NorthMember</explicitMember><explicitMember>m:South</explicitMember></scenario></context>
<context><period><instant>2001-01-01</instant></period></context>
<unit id="u"><measure>a</measure></unit><unit id="u"/><unit id="q"><divide><measure>a</measure><measure>b</measure><measure>c</measure></divide></unit>
<x:Revenue contextRef="c" unitRef="u">5<i>0</i>0</x:Revenue><nonFraction name="x:Cash" unitRef="q">7</nonFraction><x:Plain contextRef="">1</x:Plain></xbrl>"""


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_references_of_a_document(spark):
    docs = documents(spark, INSTANCE, "<a><b></a>", None)
    contexts = [tuple(r) for r in X.xbrl_contexts(docs).collect()]
    assert contexts == [(0, "c", "FY 2020", "new", "Region Axis: North Member; South")]
    assert {r["unit_id"]: r["unit"] for r in X.xbrl_units(docs).collect()} == {"u": "a", "q": "a / b x c"}
    facts = X.xbrl_facts(docs).orderBy("row_no").select("metric", "period", "section", "amount", "unit", "source_row").collect()
    assert [tuple(r) for r in facts] == [
        ("x:Revenue", "FY 2020", "Region Axis: North Member; South", 500.0, "a", "Fact 1"),
        ("x:Cash", "Unspecified period", "", 7.0, "a / b x c", "Inline fact 2")]


def test_shapes_and_wanted_columns(spark):
    link = ('<l><labelLink><label xlink:label="t"/><label xlink:label="t"/><label/><labelArc xlink:to="t"/><labelArc xlink:to="no"/>'
            "<p><labelArc xlink:to='t'/></p></labelLink><calculationLink><calculationArc/></calculationLink><calculationArc/></l>")
    docs = documents(spark, INSTANCE, link, "<a/>", "<a>")
    shapes = {r["doc_id"]: (r["shape"], r["fact_count"], r["arc_count"], r["label_count"]) for r in X.xml_shapes(docs).collect()}
    assert shapes == {0: ("facts", 2, 0, 0), 1: ("linkbase", 0, 1, 2), 2: ("generic", 0, 0, 0)}
    whole = X.xml_elements(X.parse_documents(docs))
    assert X.xbrl_labels(X.parse_documents(docs, columns=X.LINK_COLUMNS)).count() == 2
    for columns in ((), ("name", "content"), X.LINK_COLUMNS):
        part = X.parse_documents(docs, columns=columns)
        names = ["doc_id", *[c for c in columns if c != "attrs"]]
        assert sorted(map(repr, part.select(names).collect())) == sorted(map(repr, whole.select(names).collect()))


def test_facts_are_not_shuffled_and_files_of_one_row_group_are_dealt_out(spark):
    sf = "/root/testdata/sf0.001"
    plan = X.xbrl_facts(documents(spark, INSTANCE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert workload.instances(spark, sf).rdd.getNumPartitions() > 1 and workload.linkbases(spark, sf).rdd.getNumPartitions() > 1


def test_native_values_are_read_after_they_are_merged(spark):
    rows = [(Decimal("1.50"), True, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 0, 0, 5), -2, 0.1),
            (Decimal("1.50"), None, None, datetime.datetime(2024, 1, 2, 3, 0, 0, 6), 2**62, float("nan")),
            (None, False, datetime.date(1969, 12, 31), None, None, None)]
    df = spark.createDataFrame(rows, "m decimal(10,2), f boolean, day date, at timestamp, k long, x double")
    text = P.column_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "date_format" not in text[text.rindex("Exchange"):]
    stats = {r["column"]: (r["inferred_type"], r["filled"], r["unique_count"], r["avg_length"], r["min"], r["first_date"])
             for r in P.column_stats(df).collect()}
    assert stats == {
        "m": ("number", 2, 1, 3.0, 1.5, None), "f": ("boolean", 2, 2, 4.5, None, None),
        "day": ("date", 2, 2, 10.0, None, "1969-12-31"), "at": ("date", 2, 2, 26.0, None, "2024-01-02"),
        "k": ("integer", 2, 2, 10.5, -2.0, None), "x": ("number", 1, 1, 3.0, 0.1, None)}
