"""Statement facts and their analysis.

A fact row has ``doc_id, sheet, statement, section, line_item, metric, period,
amount, unit, note, source_row``; ``row_no`` (optional) gives the order that
breaks ties, otherwise the smallest text does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope import rules as R
from tablescope.functions.cells import cell, quoted
from tablescope.functions.finance import concept_words, humanize_concept, period_year, signed_change
from tablescope.functions.patterns import any_match, first_match, first_match_reader
from tablescope.functions.text import trim_ws
from tablescope.functions.values import parse_number

# Smallest table, year columns, amounts and keyword rows of a
# wide statement, and the shares of numbers and of texts its columns need.
WIDE_ROWS, WIDE_YEARS, WIDE_AMOUNTS, WIDE_KEYWORDS = 3, 2, 8, 3
WIDE_SHARE = 0.5
# Fewest facts of an analysis, and the share of the best dated
# period's facts that makes a core period.
ANALYSIS_FACTS = 8
CORE_SHARE = 0.35

FACT_COLUMNS = (
    "sheet", "statement", "section", "line_item", "metric", "period", "amount", "unit", "note",
    "source_row",
)


def year_columns(names: Sequence[str]) -> dict[str, str]:
    """Columns named after a year, with their periods."""
    found = {}
    for name in names:
        match = re.match(R.YEAR_HEADER, name.strip(), re.IGNORECASE)
        if match:
            found[name] = f"FY {match.group(1)}"
    return found


def table_statement(hits: Sequence[Column]) -> Column:
    """Statement type from one flag per rule of the table."""
    chosen = F.when(hits[0], R.TABLE_TYPE_RULES[0][0])
    for (name, _), hit in zip(R.TABLE_TYPE_RULES[1:], hits[1:]):
        chosen = chosen.when(hit, name)
    return chosen.otherwise("Financial statement")


def guess_statement(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Statement type of flat tables, from all their labels."""
    text = cell(df, label).text
    flags = [
        F.coalesce(F.bool_or(any_match(text, (pattern,))), F.lit(False)).alias(f"_h{i}")
        for i, (_, pattern) in enumerate(R.TABLE_TYPE_RULES)
    ]
    hits = [F.col(f"_h{i}") for i in range(len(flags))]
    return df.groupBy(*[quoted(b) for b in by]).agg(*flags).select(
        *by, table_statement(hits).alias("statement")
    )


def is_wide_statement(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Does a table hold a statement with one column per year?

    One row per table, from one pass over all its rows: the label column, the
    measures the decision rests on, the statement type and the decision.
    """
    years = year_columns([c for c in df.columns if c not in by])
    others = [c for c in df.columns if c not in years and c not in by]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(years):
        text, number = trim_ws(cell(df, name).text), cell(df, name).number
        aggs += [
            F.count_if(text != "").alias(f"_filled{i}"), F.count(number).alias(f"_numeric{i}"),
        ]
    for j, name in enumerate(others):
        text = trim_ws(cell(df, name).text)
        amounts = sum(
            (F.when(cell(df, y).number.isNotNull(), 1).otherwise(0) for y in years), F.lit(0)
        )
        aggs += [
            F.count_if((text != "") & cell(df, name).number.isNull()).alias(f"_texts{j}"),
            F.count_if(any_match(text, (R.FINANCE_KEYWORDS,))).alias(f"_keywords{j}"),
            F.sum(F.when(text != "", amounts).otherwise(0)).alias(f"_amounts{j}"),
            *[
                F.coalesce(F.bool_or(any_match(text, (p,))), F.lit(False)).alias(f"_h{j}_{k}")
                for k, (_, p) in enumerate(R.TABLE_TYPE_RULES)
            ],
        ]
    seen = df.groupBy(*[quoted(b) for b in by]).agg(*aggs)
    ratios = [
        F.when(F.col(f"_filled{i}") == 0, 0.0).otherwise(F.col(f"_numeric{i}") / F.col(f"_filled{i}"))
        for i in range(len(years))
    ]
    enough = F.greatest(F.lit(2.0), F.col("rows") * WIDE_SHARE)
    choices = [
        F.when(F.col(f"_texts{j}") >= enough, F.struct(
            F.lit(name).alias("label_column"), F.col(f"_keywords{j}").alias("keyword_rows"),
            F.col(f"_amounts{j}").alias("amounts"),
            table_statement([F.col(f"_h{j}_{k}") for k in range(len(R.TABLE_TYPE_RULES))]).alias("statement"),
        ))
        for j, name in enumerate(others)
    ]
    lowest = F.least(*ratios) if len(ratios) > 1 else (ratios or [F.lit(0.0)])[0]
    first = F.coalesce(*choices) if choices else F.lit(None).cast(
        "struct<label_column:string,keyword_rows:bigint,amounts:bigint,statement:string>")
    result = seen.select(
        *by, "rows", F.lit(len(years)).alias("year_columns"), lowest.alias("numeric_share"),
        first.alias("_f"),
    ).select(*by, "rows", "year_columns", "numeric_share", "_f.*")
    decision = (
        (F.col("rows") >= WIDE_ROWS) & (F.col("year_columns") >= WIDE_YEARS)
        & (F.col("numeric_share") >= WIDE_SHARE) & F.col("label_column").isNotNull()
        & (F.col("keyword_rows") >= WIDE_KEYWORDS) & (F.col("amounts") >= WIDE_AMOUNTS)
    )
    return result.withColumn("is_wide", F.coalesce(decision, F.lit(False)))


def wide_to_facts(
    df: DataFrame, label: str, row_no: str | None = None, by: Sequence[str] = (),
    statement: Column | str | None = None,
) -> DataFrame:
    """One fact per row and year column with an amount.

    ``row_no`` counts the table's rows from 0; the source row adds the header.
    ``statement`` is the result of ``guess_statement`` where known.
    """
    years = year_columns([c for c in df.columns if c not in by])
    kind = F.lit(None).cast("string") if statement is None else (
        F.lit(statement) if isinstance(statement, str) else statement)
    text = trim_ws(cell(df, label).text)
    pairs = F.array(*[
        F.struct(F.lit(period).alias("period"), cell(df, name).number.alias("amount"))
        for name, period in years.items()
    ])
    place = F.lit(None).cast("long") if row_no is None else quoted(row_no)
    rows = df.select(
        *[quoted(b) for b in by], kind.alias("sheet"), kind.alias("statement"),
        text.alias("line_item"), place.alias("_place"), F.inline(pairs),
    )
    return rows.filter((F.col("line_item") != "") & F.col("amount").isNotNull()).select(
        *by, "sheet", "statement", F.lit("").alias("section"), "line_item",
        F.lit("Amount").alias("metric"), "period", "amount", F.lit("").alias("unit"),
        F.lit("").alias("note"),
        F.concat(F.lit("Row "), (F.col("_place") + 2).cast("string")).alias("source_row"),
    )


def concept_statement(concept: Column) -> Column:
    """Statement type of a reported concept."""
    text = F.concat(concept, F.lit(" "), humanize_concept(concept))
    return first_match(text, R.CONCEPT_TYPE_RULES, F.lit("XBRL fact"))


_statement_of = first_match_reader(R.CONCEPT_TYPE_RULES, "XBRL fact")


def told_concept(concept: str) -> tuple[str, str]:
    """Words and ``concept_statement`` of a concept as a plain text, in Python."""
    words = concept_words(concept)
    return words, _statement_of(f"{concept} {words}")


def to_facts(records: DataFrame) -> DataFrame:
    """Usable facts of raw fact records: amount, line item and period given."""
    amount = F.col("amount") if dict(records.dtypes)["amount"] == "double" else parse_number(
        F.col("amount").cast("string"))

    def text(name: str, default: str | None = None) -> Column:
        value = trim_ws(F.coalesce(F.col(name), F.lit("")))
        return value if default is None else F.when(value == "", default).otherwise(value)

    cleaned = records.withColumns({
        "amount": amount, "sheet": text("sheet"), "statement": text("statement", "Financial table"),
        "line_item": text("line_item"), "metric": text("metric", "Amount"), "period": text("period"),
        "unit": F.nullif(text("unit"), F.lit("")),
    })
    return cleaned.filter(
        F.col("amount").isNotNull() & (F.col("line_item") != "") & (F.col("period") != "")
    )


def _tie(facts: DataFrame) -> Column:
    """Order of facts that otherwise rank alike: the earliest, or the smallest."""
    names = ("row_no",) if "row_no" in facts.columns else ("sheet", "statement", "line_item", "amount")
    return F.struct(*[F.col(n).alias(f"t{i}") for i, n in enumerate(names)])


def rank_periods(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Periods of each document in reporting order.

    Dated periods come first, among them those with enough facts, newest first.
    Facts are counted per period before any ranking.
    """
    c = F.col
    counts = facts.groupBy(doc, "period").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "year", period_year(c("period"))
    )
    dated = c("year").isNotNull()
    best = F.coalesce(F.max(F.when(dated, c("count"))).over(Window.partitionBy(doc)), F.lit(1))
    core = c("count") >= F.greatest(F.lit(1.0), best * CORE_SHARE)
    rows = counts.withColumn("core", core)
    ranking = Window.partitionBy(doc).orderBy(
        dated.desc(), c("core").desc(),
        F.when(c("core") & dated, c("year")).desc_nulls_last(),
        c("count").desc(), c("year").desc_nulls_last(), c("period").asc(),
    )
    return rows.withColumn("rank", F.row_number().over(ranking)).select(
        doc, "rank", "period", "year", "count", "core"
    )


def common_unit(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Most frequent unit of each document."""
    counts = facts.filter(F.coalesce(F.col("unit"), F.lit("")) != "").groupBy(doc, "unit").agg(
        F.count(F.lit(1)).alias("count")
    )
    ranking = Window.partitionBy(doc).orderBy(F.col("count").desc(), F.col("unit").asc())
    return counts.withColumn("_r", F.row_number().over(ranking)).filter(F.col("_r") == 1).drop("_r")


def metric_scores(
    facts: DataFrame, rules: Sequence[R.MetricRule] = R.METRIC_RULES
) -> DataFrame:
    """Facts matched to headline metrics, one row per match, with a score.

    The rules become expressions over the scan: no join of facts and rules.
    """
    line = F.col("line_item")
    source = F.concat_ws(" ", "statement", "sheet")
    common = (
        F.when(line.rlike(r"(?i)\Atotal\b"), 15).otherwise(0)
        - F.when(F.col("metric") != "Amount", 8).otherwise(0)
        - F.when(any_match(line, (R.WEAK_METRIC_LABELS,)), 30).otherwise(0)
    )
    matches = []
    for number, rule in enumerate(rules):
        points = sum(
            (
                F.when(any_match(line, (p,)), 100 - 8 * i).otherwise(0)
                for i, p in enumerate(rule.patterns)
            ),
            F.lit(0),
        )
        hint = F.when(any_match(source, rule.hints), 12).otherwise(0)
        matches.append(
            F.when(any_match(line, rule.patterns), F.struct(
                F.lit(number + 1).alias("metric_no"), F.lit(rule.label).alias("label"),
                (points + hint).alias("points")))
        )
    relevant = facts.filter(any_match(line, [p for rule in rules for p in rule.patterns]))
    return (
        relevant.withColumn("_common", common)
        .withColumn("_match", F.explode_outer(F.array_compact(F.array(*matches))))
        .filter(F.col("_match").isNotNull())
        .select(
            *facts.columns, "_match.metric_no", "_match.label",
            (F.col("_match.points") + F.col("_common")).alias("score"),
        )
    )


def highlights(
    facts: DataFrame, rules: Sequence[R.MetricRule] = R.METRIC_RULES, doc: str = "doc_id"
) -> DataFrame:
    """Headline metrics: value of the newest and of the prior period, change.

    The best fact per document, metric and period comes from an aggregate, so
    at most one row per metric and period meets the ranked periods.
    """
    scored = metric_scores(facts, rules)
    tie = _tie(scored)
    fields = F.struct(*[F.col(n) for n in ("amount", "statement", "sheet", "unit")])
    keys = [doc, "metric_no", "label", "period"]
    # Highest score first, then the earliest fact.
    best = (
        scored.groupBy(*keys)
        .agg(F.min_by(fields, F.struct((-F.col("score")).alias("s"), tie.alias("t"))).alias("_f"))
    )
    periods = rank_periods(facts, doc).filter(F.col("rank") <= 2).select(doc, "period", "rank")
    placed = best.join(periods, [doc, "period"])

    def at(rank: int, value: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, value))

    rows = placed.groupBy(doc, "metric_no", "label").agg(
        at(1, F.col("period")).alias("current_period"), at(1, F.col("_f.amount")).alias("current_value"),
        at(2, F.col("period")).alias("prior_period"), at(2, F.col("_f.amount")).alias("prior_value"),
        at(1, F.col("_f.statement")).alias("statement"), at(1, F.col("_f.sheet")).alias("sheet"),
        at(1, F.col("_f.unit")).alias("unit"),
    )
    change = signed_change(F.col("current_value"), F.col("prior_value"))
    return rows.filter(F.col("current_value").isNotNull()).withColumn("_c", change).select(
        *rows.columns, "_c.change", "_c.change_pct"
    )


def analysis_checks(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Balance equation of the newest period and statement coverage."""
    c = F.col
    tie = _tie(facts)
    totals = {
        "assets": r"^total assets$", "both": r"^total liabilities and equity$",
        "liabilities": r"^total liabilities$", "equity": r"^total equity$",
    }
    line = c("line_item")
    found = facts.filter(any_match(line, totals.values())).groupBy(doc, "period").agg(*[
        F.min_by("amount", F.when(any_match(line, (p,)), tie)).alias(name) for name, p in totals.items()
    ])
    newest = rank_periods(facts, doc).filter(c("rank") == 1).select(doc, "period")
    expected = F.coalesce(c("both"), c("liabilities") + c("equity"))
    diff = c("assets") - c("expected")
    tied = F.abs(diff) <= F.greatest(F.lit(1.0), F.abs(c("assets")) * 0.001)
    equation = (
        newest.join(found, [doc, "period"], "left")
        .withColumn("expected", expected)
        .select(
            doc, F.lit("Balance sheet equation").alias("label"),
            F.when(diff.isNull(), "missing").when(tied, "ok").otherwise("warning").alias("status"),
            "period", diff.alias("difference"),
        )
    )
    kinds = [F.coalesce(F.bool_or(any_match(c("statement"), (k,))), F.lit(False)) for k in ("income", "balance", "cash")]
    coverage = facts.groupBy(doc).agg((kinds[0] & kinds[1] & kinds[2]).alias("_all")).select(
        doc, F.lit("Primary statement coverage").alias("label"),
        F.when(c("_all"), "ok").otherwise("warning").alias("status"),
        F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("difference"),
    )
    return equation.unionByName(coverage)


def analysis_summary(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Confidence, unit, periods and statement types of each document.

    Documents with fewer than ``ANALYSIS_FACTS`` facts have none.  Facts are
    counted per statement and per period first; the lists hold distinct names.
    """
    c = F.col
    pairs = facts.groupBy(doc, "statement", "sheet").agg(F.count(F.lit(1)).alias("_n"))
    counted = pairs.groupBy(doc).agg(
        F.sum("_n").alias("fact_count"), F.count_distinct("sheet").alias("sheet_count"),
        F.array_sort(F.collect_set("statement")).alias("statement_types"),
    )
    ranked = rank_periods(facts, doc).groupBy(doc).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "period"))), lambda p: p["period"]).alias("periods")
    )
    rows = counted.filter(c("fact_count") >= ANALYSIS_FACTS).join(ranked, doc).join(
        common_unit(facts, doc).select(doc, "unit"), doc, "left"
    )
    confidence = F.least(
        F.lit(0.96),
        F.lit(0.38) + F.least(F.lit(0.24), F.size("statement_types") * 0.04)
        + F.least(F.lit(0.18), F.size("periods") * 0.06)
        + F.least(F.lit(0.16), c("fact_count") / 500),
    )
    return rows.select(
        doc, confidence.alias("confidence"), "unit", "periods", "sheet_count", "fact_count", "statement_types"
    )
