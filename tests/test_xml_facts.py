"""Facts of XML documents: read while parsing, a context once, the same words in Python as in expressions."""

import random

import pytest
from pyspark.sql import functions as F

from tablescope.functions.finance import concept_words, humanize_concept, plain_period_label, reported_period_label
from tablescope.functions.patterns import first_match_reader
from tablescope.functions.text import squeeze, squeezed
from tablescope.functions.values import NUMBER_PATTERN, parse_number, plain_number
from tablescope.operators import statements as D
from tablescope.operators.facts import concept_statement, told_concept
from tablescope.session import stored
from tablescope.sources import xml as X

ODD = """<!DOCTYPE r [<!ENTITY e "in">]><x:xbrl xmlns:y="u"><!-- c --><context id="c" contextRef="c">
 <context id="d"><instant contextRef="d"> 2019&#160;<b>-12</b> </instant></context>
 <entity><identifier>a<identifier>b</identifier> c</identifier><identifier>second</identifier></entity><startDate/><startDate>2020</startDate>
 <endDate>31 <![CDATA[<Dec>]]> 2020</endDate><explicitMember dimension="p:OneAxis">m:A&e;B</explicitMember><p:explicitMember> </p:explicitMember></context>
<instant>2001</instant><unit id="u"><measure>a</measure><x><divide/><measure> b  c</measure></x></unit><unit id="u"><measure/></unit><unit id="n"/>
<labelLink contextRef="c"><context id="c"><instant>2018-01-01</instant></context>t<measure contextRef="d" unitRef="u">9</measure></labelLink>
<ix:nonNumeric name="p:Text" contextRef="c" unitRef="n">one <p:Cash contextRef="d" unitRef="u">1 <i>000</i></p:Cash>&lt;two&gt;<?pi x?></ix:nonNumeric>
<nonFraction/><p:Empty contextRef=""/><unit contextRef="c"/></x:xbrl>"""


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_odd_documents_are_read_as_before(spark):
    docs = documents(spark, ODD, "<a>", None)
    contexts = [tuple(r)[1:] for r in X.xbrl_contexts(docs).collect()]
    assert contexts == [("c", "As of 2018", "", ""), ("d", "As of 2019", "", "")]
    assert [tuple(r)[1:] for r in X.xbrl_units(docs).collect()] == [("u", "")]
    got = X.xbrl_facts(docs).orderBy("row_no").select("metric", "line_item", "period", "amount", "unit", "note", "source_row").collect()
    assert [tuple(r) for r in got] == [
        ("instant", "instant", "As of 2019", None, "", "context d | value: 2019 -12", "Fact 1"),
        ("labelLink", "label Link", "As of 2018", None, "", "context c | value: 2018-01-01t9", "Fact 2"),
        ("measure", "measure", "As of 2019", 9.0, "", "context d", "Fact 3"),
        ("p:Text", "Text", "As of 2018", None, "n", "context c | value: one 1 000<two>", "Inline fact 4"),
        ("p:Cash", "Cash", "As of 2019", 1000.0, "", "context d", "Fact 5"),
        ("Fact", "Fact 6", "Unspecified period", None, "", "", "Inline fact 6")]
    first = ODD.replace('<context id="c"><instant>', '<context id="z"><instant>').replace("<unit id=\"u\"><measure/></unit>", "")
    contexts = {r[1]: tuple(r)[2:] for r in X.xbrl_contexts(documents(spark, first)).collect()}
    assert contexts["c"] == ("Unspecified period", "ab c", "One Axis: Ain B; ")
    assert [r["unit"] for r in X.xbrl_units(documents(spark, first)).collect()] == ["a / b c"]


def test_facts_need_no_tree_and_a_context_is_read_once(monkeypatch):
    def refuse(*_):
        raise AssertionError("a tree was built")

    read, seen = X._context, []
    monkeypatch.setattr(X, "_tree", refuse)
    monkeypatch.setattr(X, "_context", lambda entry: seen.append(1) or read(entry))
    facts = "".join(f'<p:A{i} contextRef="c">{i}</p:A{i}>' for i in range(50))
    assert len(X._fact_rows(f'<x><context id="c"><instant>2020-12-31</instant></context>{facts}</x>')) == 50 and len(seen) == 1


def test_an_amount_is_read_once_and_words_are_no_expressions(spark):
    text = X.xbrl_facts(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert text.count(NUMBER_PATTERN) == 1 and "([a-z0-9])([A-Z])" not in text


PARTS = ["ifrs-full", "US-GAAP", "dei", "ſrt", "srt", ":", "#", "/", "_", "-", " ", "\t", "\n", "\xa0", "\x85", " ", "﻿",
         "​", "Total", "Assets", "EBITDAMargin2", "equİty", "aſſets", "caſh flow", "cash \n flow", "CASHFLOWS",
         "Operating", "Activities", "K", "ıncome", "\xc6rlig", "\U0001d49c", "Comprehensive Income", "$1", "\\1", "Deb", "T"]


def test_plain_texts_are_read_like_columns(spark):
    seeded = random.Random(5)
    names = ["".join(seeded.choices(PARTS, k=seeded.randrange(8))) for _ in range(3000)]
    x = F.col("x")
    for r in spark.createDataFrame([(n,) for n in names], "x string").select(
            "x", squeeze(x).alias("q"), humanize_concept(x).alias("w"), concept_statement(x).alias("s")).collect():
        assert (squeezed(r["x"]), concept_words(r["x"]), *told_concept(r["x"])) == (r["q"], r["w"], r["w"], r["s"])
    dates = ["", "2020", "2020-01-01", "x1999x 2001", "_2020", "12020", "21.12.2019", "1899", "1 jan", "\xe52020", "2020年"]
    rows = [(a, b, c) for a in dates for b in dates for c in dates]
    made = spark.createDataFrame(rows, "a string, b string, c string").select("*", reported_period_label(F.col("a"), F.col("b"), F.col("c")).alias("p"))
    plain = [plain_period_label(r["a"], r["b"], r["c"]) for r in made.collect()]
    assert all(p == r["p"] or (p is None and not (r["a"] + r["b"] + r["c"]).isascii()) for p, r in zip(plain, made.collect()))
    assert sum(p is None for p in plain) == len(rows) - 9**3


def test_plain_numbers_are_read_like_columns(spark):
    seeded = random.Random(6)
    texts = ["".join(seeded.choices("0123456789,.-+( )$e", weights=[3] * 10 + [4, 3, 2] + [1] * 6, k=seeded.randrange(12))) for _ in range(5000)]
    texts += ["-0", "0.1", "1" * 400, "9" * 30 + ".5", "1,234,567.891", "12,34", "1,234", "-1,000", "٣", "1.", ".5", "-0.0", "4.35", "2.675"]
    read = spark.createDataFrame([(t,) for t in texts], "x string").select("x", parse_number(F.col("x")).alias("n")).collect()
    told = [(plain_number(r["x"]), r["n"]) for r in read]
    assert all(mine is None or repr(mine) == repr(theirs) for mine, theirs in told) and sum(mine is not None for mine, _ in told) > 500


def test_facts_meet_a_few_labels_without_a_shuffle(spark):
    facts = X.xbrl_facts(documents(spark, ODD, ODD))
    labels = stored(D.fact_labels(facts))
    items = D.items_from_facts(facts, labels=labels)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, items.collect())) == sorted(map(repr, D.items_from_facts(facts).collect())) and items.count() == 4
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in D.fact_labels(facts)._jdf.queryExecution().executedPlan().toString()


def test_rules_that_engines_read_differently_are_refused():
    assert first_match_reader([("n", r"cash\s+flow")], "-")("a CASH\tFLOW") == "n"
    for pattern in (r"\bcash", r"cash$", r"a\w", "c.sh", "[a-z]ash"):
        with pytest.raises(ValueError):
            first_match_reader([("n", pattern)], "-")


def test_periods_of_dates_beyond_ascii(spark):
    docs = documents(spark, '<x><context id="c"><instant>år 2020</instant></context><p:A contextRef="c">1</p:A></x>')
    assert [r["period"] for r in X.xbrl_facts(docs).collect()] == ["As of 2020"] == [r["period"] for r in X.xbrl_contexts(docs).collect()]
