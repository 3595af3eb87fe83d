"""Statement reconstruction from facts, tables and text lines.

Line items are long rows ``doc_id, line_id, label, concept, kind, period,
value, confidence, page_no``, one per item and period.  Items of one document
are told apart by ``line_id``; ``kind`` is the kind the item was read under,
null where its source does not tell one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope import rules as R
from tablescope.functions.cells import cell, quoted
from tablescope.functions.finance import (
    canonical_label,
    classify_concept,
    clean_label,
    currency_scale,
    heading_kind,
    is_year_token,
    label_kind,
    number_tokens,
    period_label,
    period_of,
    signed_value,
    statement_title,
    years_in,
)
from tablescope.functions.text import squeeze, trim_ws
from tablescope.functions.values import parse_number
from tablescope.operators.carry import carry_forward

_PAGES_PER_BLOCK = 64
# Confidences of headings and of lines that are not parsed.
HEADING_CONFIDENCE = 0.75
LINE_CONFIDENCE = 0.25
ROW_CONFIDENCE = 0.35
# Line items and key figures that make a document worth keeping.
KEEP_ITEMS, KEEP_FIGURES = 4, 2

ITEM_COLUMNS = ("line_id", "label", "concept", "kind", "period", "value", "confidence", "page_no")


# Text lines ---------------------------------------------------------------

def text_years(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Years named in the texts of each document, newest first.

    Years are made distinct per text before they meet per document, and there
    are at most 200 of them.
    """
    years = pages.select(doc, F.explode(years_in(F.col(text))).alias("_y")).distinct()
    return years.groupBy(doc).agg(F.sort_array(F.collect_set("_y"), asc=False).alias("years"))


def page_lines(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines ``(doc_id, page_no, line_no, raw_text, text)`` of pages.

    ``raw_text`` keeps runs of blanks, which separate figures; ``text`` has
    them squeezed.
    """
    raw = F.filter(F.transform(F.split("text", r"\r?\n"), trim_ws), lambda line: line != "")
    lines = pages.select(
        *[c for c in pages.columns if c != "text"], F.posexplode(raw).alias("line_no", "raw_text")
    )
    return lines.withColumn("text", squeeze(F.col("raw_text")))


def segment_lines(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with the statement kind in force, carried over pages.

    A heading sets the kind for the lines after it.  Also brings the amounts of
    each line, read in the scan, and the years of the document, which travel
    through one row per block of pages.
    """
    raw = F.col("raw_text")
    tokens = F.when(raw.rlike("[0-9]"), number_tokens(raw)).otherwise(
        F.array().cast("array<struct<raw:string,value:double,pos:int>>"))
    lines = page_lines(pages, doc).withColumn("heading", heading_kind(F.col("text"))).withColumn("tokens", tokens)
    block = F.floor(F.col("page_no") / _PAGES_PER_BLOCK)
    placed = carry_forward(
        lines, [doc], ["page_no", "line_no"], block, {"kind": "heading"}, text_years(pages, doc)
    )
    return placed.select(
        *[c for c in placed.columns if c not in ("kind", "years", "heading")],
        F.col("heading").isNotNull().alias("is_heading"),
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce("years", F.array().cast("array<int>")).alias("years"),
    )


def _line_parts(lines: DataFrame) -> DataFrame:
    """Add label and usable values to text lines.

    Years are no values.  With one value more than periods, a small whole
    number in front is the number of a note.
    """
    c = F.col
    usable = F.filter("tokens", lambda t: t["value"].isNotNull() & ~is_year_token(t["raw"], c("years")))
    first = F.get("_usable", F.lit(0))["value"]
    note = (
        (F.size("years") > 0) & (F.size("_usable") == F.size("years") + 1)
        & (first == F.floor(first)) & (F.abs(first) <= 99)
    )
    rows = lines.withColumn("_usable", usable).withColumn("_skip", F.when(note, 1).otherwise(0))
    lead = F.substring("raw_text", F.lit(1), F.get("_usable", c("_skip"))["pos"])
    values = F.transform(F.slice("_usable", c("_skip") + 1, F.size("_usable")), lambda t: t["value"])
    return rows.withColumn("label", clean_label(lead)).withColumn("_values", values).drop("_usable", "_skip")


def parse_lines(lines: DataFrame, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES,
                doc: str = "doc_id") -> DataFrame:
    """Parse segmented lines: label, concept, kind, values by period, confidence.

    One row per line.  ``parsed`` is false for headings, lines without a usable
    amount or label, and lines of notes.
    """
    c = F.col
    rows = _line_parts(lines)
    concept = classify_concept(c("label"), rules)
    known = ~c("kind").isin("unknown", "notes")
    rows = rows.withColumn("concept", concept).withColumn(
        "item_kind", F.when(known, c("kind")).otherwise(label_kind(c("label"), rules))
    )
    parsed = (
        ~c("is_heading") & (F.size("_values") > 0) & (F.length("label") >= 3)
        & ~c("label").rlike(r"\A[0-9]+\z")
    )
    periods = F.when(F.size("years") > 0, F.transform("years", period_label)).otherwise(
        F.array(F.lit("Current period"))
    )
    values = F.transform(
        F.arrays_zip(
            F.slice(periods, F.lit(1), F.size("_values")).alias("period"),
            F.slice("_values", F.lit(1), F.size(periods)).alias("value"),
        ),
        lambda pair: F.struct(
            pair["period"].alias("period"),
            signed_value(pair["value"], c("label"), c("item_kind")).alias("value")),
    )
    confidence = line_confidence(
        c("kind") != "unknown", c("concept").isNotNull(), F.size("_values"), c("page_no") > 0
    )
    return rows.withColumn("parsed", F.coalesce(parsed, F.lit(False))).select(
        *[n for n in lines.columns if n not in ("raw_text", "kind", "tokens")],
        F.when(c("parsed"), c("item_kind")).otherwise(c("kind")).alias("kind"),
        "parsed",
        F.when(c("parsed"), confidence).when(c("is_heading"), HEADING_CONFIDENCE)
        .otherwise(LINE_CONFIDENCE).alias("confidence"),
        F.when(c("parsed"), c("label")).alias("label"),
        F.when(c("parsed"), c("concept")).alias("concept"),
        F.when(c("parsed"), values).alias("values"),
    )


def line_confidence(known: Column, has_concept: Column, tokens: Column, on_page: Column) -> Column:
    """Confidence of a parsed line."""
    return F.least(
        F.lit(0.94),
        F.lit(0.38) + F.when(known, 0.16).otherwise(0.0) + F.when(has_concept, 0.2).otherwise(0.0)
        + F.least(F.lit(0.14), tokens * 0.05) + F.when(on_page, 0.04).otherwise(0.0),
    )


def items_from_lines(parsed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Line items of parsed lines, one row per period.

    The id is made of kind, page and line, so that it needs no count over the
    whole document.
    """
    line_id = F.concat_ws(":", "kind", F.format_string("%09d", "page_no"), F.format_string("%09d", "line_no"))
    # The outer form keeps the optimizer from evaluating the values twice, in a
    # filter below the lines; lines without values drop out afterwards.
    rows = parsed.select(
        doc, line_id.alias("line_id"), "label", "concept", "kind", "confidence", "page_no",
        F.inline_outer("values"),
    )
    return rows.filter(F.col("period").isNotNull()).select(doc, *ITEM_COLUMNS)


def unparsed_lines(raw_lines: DataFrame, include_parsed: bool = False, limit: int | None = None,
                   order: Sequence[str] = ("page_no", "line_no")) -> DataFrame:
    """Trace of the lines that gave no item; a limit shows the first ones."""
    rows = raw_lines if include_parsed else raw_lines.filter(~F.col("parsed"))
    return rows if limit is None else rows.orderBy(*order).limit(limit)


# Items of tables ----------------------------------------------------------

def normalize_header(name: str) -> str:
    """Header text as the header patterns see it."""
    return re.sub(r"[^a-z0-9]+", " ", name.strip().lower())


def first_column(names: Sequence[str], pattern: str) -> str | None:
    """First column whose header matches a pattern."""
    return next((n for n in names if re.search(pattern, normalize_header(n), re.IGNORECASE)), None)


def _text(df: DataFrame, name: str | None) -> Column:
    return F.lit("") if name is None or name not in df.columns else cell(df, name).text


def _pick(on_duplicate: str, value: Column, row_no: Column) -> Column:
    if on_duplicate == "sum":
        return F.sum(value)
    return F.max_by(value, row_no)


def _classified(labels: DataFrame, own: str, rules: Sequence[R.ConceptRule]) -> DataFrame:
    return labels.select(
        "_statement", "label", label_kind(F.concat_ws(" ", "_statement", own), rules).alias("kind"),
        classify_concept(F.col(own), rules).alias("concept"))


def _classified_labels(rows: DataFrame, rules: Sequence[R.ConceptRule]) -> DataFrame:
    """Kind and concept of each distinct (``_statement``, ``label``).

    The rules read an aggregated copy of the label: a filter on their result
    then stays above the aggregate, and no rule is tried on every row.
    """
    return _classified(rows.groupBy("_statement", "label").agg(F.max("label").alias("_own")), "_own", rules)


def _fact_rows(facts: DataFrame, row_no: str, doc: str) -> DataFrame:
    """Facts with a label, a period and an amount, as items are made of them."""
    c = F.col
    label, period = trim_ws(c("line_item")), trim_ws(c("period"))
    amount = c("amount") if dict(facts.dtypes)["amount"] == "double" else parse_number(c("amount"))
    return facts.select(
        doc, label.alias("label"), period.alias("period"), amount.alias("_amount"),
        F.coalesce("statement", F.lit("")).alias("_statement"),
        F.coalesce("sheet", F.lit("")).alias("_sheet"), quoted(row_no).alias("_row"),
    ).filter((c("label") != "") & (c("period") != "") & c("_amount").isNotNull())


def fact_labels(facts: DataFrame, row_no: str = "row_no", rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES,
                doc: str = "doc_id") -> DataFrame:
    """Labels of facts with their kinds and concepts, to be stored for ``items_from_facts``.

    Made distinct by hash: no facts are sorted, as they are where a copy is aggregated.
    """
    return _classified(_fact_rows(facts, row_no, doc).select("_statement", "label").distinct(), "label", rules)


def items_from_facts(
    facts: DataFrame, row_no: str = "row_no", on_duplicate: str = "last",
    rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES, doc: str = "doc_id", labels: DataFrame | None = None,
) -> DataFrame:
    """Line items of facts; the last amount of a period wins, or the sum.

    ``labels`` brings the ``fact_labels`` of these facts where they are stored:
    as their size is known then, facts need not be shuffled to meet a few.
    """
    c = F.col
    rows = _fact_rows(facts, row_no, doc)
    rows = rows.join(_classified_labels(rows, rules) if labels is None else labels, ["_statement", "label"])
    value = signed_value(c("_amount"), c("label"), c("kind"))
    grouped = rows.groupBy(doc, "kind", "label", "concept", "_sheet", "period").agg(
        _pick(on_duplicate, value, c("_row")).alias("value")
    )
    line_id = F.concat_ws(":", "kind", "label", F.coalesce("concept", F.lit("")), "_sheet")
    return grouped.select(
        doc, line_id.alias("line_id"), "label", "concept", "kind", "period", "value",
        F.lit(0.82).alias("confidence"), F.lit(None).cast("int").alias("page_no"),
    )


def table_confidence(base: float, ceiling: float, kind: Column, concept: Column) -> Column:
    """Confidence of an item read from a table."""
    return F.least(
        F.lit(ceiling),
        F.lit(base) + F.when(kind != "unknown", 0.18).otherwise(0.0)
        + F.when(concept.isNotNull(), 0.16).otherwise(0.0),
    )


def items_from_period_columns(
    df: DataFrame, row_no: str, label: str | None = None,
    rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES, doc: str = "doc_id",
) -> DataFrame:
    """Line items of a table with one column per period.

    Of several columns with the same year the last one counts.  Rows without
    any amount give no item; single missing amounts stay as nulls.
    """
    names = [n for n in df.columns if n not in (doc, row_no)]
    label = label or first_column(names, R.LABEL_HEADER)
    columns: dict[str, str] = {}
    for name in names:
        year = re.search(r"((?:19|20)[0-9]{2})", name)
        if year:
            columns[f"FY {year.group(1)}"] = name
    if label is None or not columns:
        raise ValueError("no label column or no period column")
    c = F.col
    amounts = [cell(df, name).number for name in columns.values()]
    pairs = F.array(*[
        F.struct(F.lit(p).alias("period"), amount.alias("value")) for p, amount in zip(columns, amounts)
    ])
    rows = df.select(quoted(doc), trim_ws(_text(df, label)).alias("label"), quoted(row_no).alias("_row"),
                     pairs.alias("_pairs"))
    rows = rows.filter((c("label") != "") & F.exists("_pairs", lambda p: p["value"].isNotNull()))
    rows = rows.withColumn("kind", label_kind(c("label"), rules)).withColumn(
        "concept", classify_concept(c("label"), rules))
    return rows.select(
        doc, F.concat(F.lit("table:"), F.format_string("%012d", c("_row").cast("long"))).alias("line_id"),
        "label", "concept", F.lit(None).cast("string").alias("kind"),
        table_confidence(0.5, 0.92, c("kind"), c("concept")).alias("confidence"),
        F.lit(None).cast("int").alias("page_no"), F.inline("_pairs"),
    ).select(doc, *ITEM_COLUMNS)


def items_from_long(
    df: DataFrame, row_no: str, label: str | None = None, period: str | None = None,
    value: str | None = None, on_duplicate: str = "last",
    rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES, doc: str = "doc_id",
) -> DataFrame:
    """Line items of a table with label, period and value columns.

    Rows group by kind and label; per year the last row counts, or the sum.
    """
    names = [n for n in df.columns if n not in (doc, row_no)]
    label = label or first_column(names, R.LABEL_HEADER)
    period = period or first_column(names, R.PERIOD_HEADER)
    value = value or first_column(names, R.VALUE_HEADER_FIRST) or first_column(names, R.VALUE_HEADER)
    if label is None or period is None or value is None:
        raise ValueError("no label, period or value column")
    c = F.col
    group = _text(df, first_column(names, R.CLASS_HEADER))
    rows = df.select(
        quoted(doc), trim_ws(_text(df, label)).alias("label"), period_of(_text(df, period)).alias("period"),
        cell(df, value).number.alias("_amount"), group.alias("_group"), quoted(row_no).alias("_row"),
    ).filter((c("label") != "") & c("period").isNotNull() & c("_amount").isNotNull())
    rows = rows.withColumn("kind", label_kind(F.concat_ws(" ", "_group", "label"), rules)).withColumn(
        "concept", classify_concept(c("label"), rules))
    amount = signed_value(c("_amount"), c("label"), c("kind"))
    grouped = rows.groupBy(doc, "kind", "label", "concept", "period").agg(
        _pick(on_duplicate, amount, c("_row")).alias("value"))
    return grouped.select(
        doc, F.concat(F.lit("long:"), c("kind"), F.lit(":"), c("label")).alias("line_id"),
        "label", "concept", F.lit(None).cast("string").alias("kind"), "period", "value",
        table_confidence(0.48, 0.9, c("kind"), c("concept")).alias("confidence"),
        F.lit(None).cast("int").alias("page_no"),
    )


def dataset_raw_lines(df: DataFrame, row_no: str, doc: str = "doc_id") -> DataFrame:
    """Every row of a table as one text line, empty cells left out."""
    names = [n for n in df.columns if n not in (doc, row_no)]
    parts = [F.nullif(cell(df, n).text, F.lit("")) for n in names]
    return df.select(
        quoted(doc), quoted(row_no).cast("long").alias("line_no"), F.concat_ws(" | ", *parts).alias("text"),
        F.lit("unknown").alias("kind"), F.lit(False).alias("parsed"), F.lit(ROW_CONFIDENCE).alias("confidence"),
    )


# Documents ----------------------------------------------------------------

def choose_periods(items: DataFrame, texts: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Periods of each document: years of its texts and periods of its items.

    One row per period, ranked newest first; periods without a year come last.
    """
    found = items.select(doc, "period").distinct()
    if texts is not None:
        years = texts.select(doc, F.explode(years_in(F.col("text"))).alias("_y")).distinct()
        found = found.union(years.select(doc, period_label(F.col("_y")))).distinct()
    ranking = Window.partitionBy(doc).orderBy(
        F.col("year").desc_nulls_last(), F.col("period").asc()
    )
    year = F.regexp_extract("period", "((?:19|20)[0-9]{2})", 1).try_cast("int")
    return found.withColumn("year", year).withColumn("rank", F.row_number().over(ranking)).select(
        doc, "rank", "period", "year"
    )


def statement_membership(items: DataFrame, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES,
                         doc: str = "doc_id") -> DataFrame:
    """Items per statement; an item may belong to two.

    The label decides, and so does the kind an item was read under; only the
    label can send an item to ``unknown``.
    """
    by_label = label_kind(F.col("label"), rules)
    main = F.when(by_label.isin(*R.PRIMARY_KINDS), by_label).otherwise("unknown")
    own = F.when(F.col("kind").isin(*R.PRIMARY_KINDS), F.col("kind"))
    kinds = F.array_distinct(F.array_compact(F.array(main, own)))
    return items.withColumn("statement", F.explode_outer(kinds))


def statement_summary(members: DataFrame, documents: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Rows, confidence and warning per statement.

    The primary statements of each document are always listed.  Values are
    merged per line first, so a large document reduces before it meets others.
    """
    c = F.col
    lines = members.groupBy(doc, "statement", "line_id").agg(F.max("confidence").alias("_c"))
    counts = lines.groupBy(doc, "statement").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("_c").alias("_avg")
    )
    docs = (members if documents is None else documents).select(doc).distinct()
    frame = docs.withColumn("statement", F.explode(F.array(*[F.lit(k) for k in (*R.PRIMARY_KINDS, "unknown")])))
    rows = frame.join(counts, [doc, "statement"], "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0)))
    confidence = F.least(F.lit(0.96), c("_avg") + F.least(F.lit(0.12), c("row_count") / 100))
    return rows.filter((c("row_count") > 0) | (c("statement") != "unknown")).select(
        doc, "statement", statement_title(c("statement")).alias("title"), "row_count",
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        F.when(c("row_count") == 0, "No rows were confidently assigned to this statement.").alias("warning"),
    )


def statement_periods(members: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Periods with a value per statement."""
    return members.filter(F.col("value").isNotNull()).select(doc, "statement", "period").distinct()


def statement_pages(members: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Source pages per statement."""
    return members.filter(F.col("page_no").isNotNull()).select(doc, "statement", "page_no").distinct()


def key_figures(items: DataFrame, periods: DataFrame, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES,
                doc: str = "doc_id") -> DataFrame:
    """Most confident item per concept, with a value or null for every period."""
    c = F.col
    with_concept = items.filter(c("concept").isNotNull())
    best = with_concept.groupBy(doc, "concept").agg(
        F.min_by(
            F.struct("line_id", "label", "confidence", "page_no"),
            F.struct((-c("confidence")).alias("c"), c("line_id").alias("l")),
        ).alias("_b")
    ).select(doc, "concept", "_b.*")
    values = with_concept.select(doc, "concept", "line_id", "period", "value")
    frame = best.join(periods.select(doc, "period", F.col("rank").alias("period_rank")), doc)
    rows = frame.join(values, [doc, "concept", "line_id", "period"], "left")
    place = F.array_position(F.array(*[F.lit(k) for k in R.KEY_FIGURE_ORDER]), c("concept"))
    return rows.select(
        doc, "concept", canonical_label(c("concept"), rules).alias("label"),
        label_kind(c("label"), rules).alias("kind"), "period", "period_rank", "value", "confidence", "page_no",
        F.when(place == 0, len(R.KEY_FIGURE_ORDER) + 1).otherwise(place).alias("figure_order"),
    )


def document_confidence(items: DataFrame, periods: DataFrame, pages: DataFrame | None = None,
                        doc: str = "doc_id") -> DataFrame:
    """Confidence of each document from pages, items and periods."""
    c = F.col
    lines = items.select(doc, "line_id").distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("row_count"))
    count = periods.groupBy(doc).agg(F.count(F.lit(1)).alias("period_count"))
    rows = lines.join(count, doc, "full_outer")
    if pages is None:
        rows = rows.withColumn("page_quality", F.lit(0.45))
    else:
        quality = pages.groupBy(doc).agg(F.avg("quality").alias("page_quality"))
        rows = rows.join(quality, doc, "full_outer").withColumn(
            "page_quality", F.coalesce("page_quality", F.lit(0.45)))
    rows = rows.na.fill(0, ["row_count", "period_count"])
    confidence = F.least(
        F.lit(0.96),
        c("page_quality") * 0.45 + F.least(F.lit(0.3), c("row_count") / 80)
        + F.least(F.lit(0.25), c("period_count") * 0.08),
    )
    return rows.select(doc, "row_count", "period_count", confidence.alias("confidence"))


def keep_documents(items: DataFrame, forced: bool = False, doc: str = "doc_id") -> DataFrame:
    """Documents with enough items or key figures, with both counts."""
    counts = items.groupBy(doc).agg(
        F.count_distinct("line_id").alias("row_count"), F.count_distinct("concept").alias("figure_count")
    )
    kept = (F.col("row_count") >= KEEP_ITEMS) | (F.col("figure_count") >= KEEP_FIGURES)
    return counts.withColumn("kept", kept | F.lit(forced))


def currency_scale_of(texts: DataFrame, order: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Currency and scale of documents: the first text that shows one.

    The scale follows the order of its rules over the whole document.
    """
    found = texts.select(doc, F.struct(*order).alias("_o"), currency_scale(F.col("text")).alias("_s"),
                         _scale_rule(F.col("text")).alias("_rule"))
    return found.groupBy(doc).agg(
        F.min_by("_s.currency", F.when(F.col("_s.currency").isNotNull(), F.col("_o"))).alias("currency"),
        F.min("_rule").alias("_rule"),
    ).select(doc, "currency", _scale_name(F.col("_rule")).alias("scale"))


def _scale_rule(text: Column) -> Column:
    from tablescope.functions.finance import SCALE_RULES

    chosen = None
    for i, (_, pattern) in enumerate(SCALE_RULES):
        hit = text.rlike(pattern)
        chosen = F.when(hit, i) if chosen is None else chosen.when(hit, i)
    return chosen


def _scale_name(rule: Column) -> Column:
    from tablescope.functions.finance import SCALE_RULES

    chosen = None
    for i, (name, _) in enumerate(SCALE_RULES):
        chosen = F.when(rule == i, name) if chosen is None else chosen.when(rule == i, name)
    return chosen.otherwise("unknown")


def document_warnings(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Warnings on rows with currency, scale, row_count and period_count."""
    c = F.col

    def warn(condition: Column, severity: str, message: str) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    listed = F.array_compact(F.array(
        warn(c("currency").isNull(), "info", "Currency was not confidently detected."),
        warn(c("scale") == "unknown", "info", "Scale was not confidently detected."),
        warn((c("row_count") > 0) & (c("period_count") == 0), "warning",
             "No reporting period header was confidently detected."),
    ))
    return documents.select(doc, F.explode(listed).alias("_w")).select(doc, "_w.*")


def document_overview(members: DataFrame, summary: DataFrame, pages: DataFrame | None = None,
                      doc: str = "doc_id") -> DataFrame:
    """Statements with rows, line items and warnings of each document.

    ``line_items`` counts an item once per statement it belongs to;
    ``distinct_items`` counts it once.
    """
    shown = summary.groupBy(doc).agg(
        F.count_if(F.col("row_count") > 0).alias("statements"),
        F.sum("row_count").alias("line_items"),
        F.count("warning").alias("statement_warnings"),
    )
    distinct = members.select(doc, "line_id").distinct().groupBy(doc).agg(
        F.count(F.lit(1)).alias("distinct_items"))
    rows = shown.join(distinct, doc, "left").na.fill(0, ["distinct_items"])
    if pages is not None:
        rows = rows.join(pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages")), doc, "left")
    return rows


def statement_pivot(items: DataFrame, periods: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Items as rows and the given periods as columns."""
    return items.groupBy(doc, "line_id", "label", "concept", "confidence").pivot(
        "period", list(periods)).agg(F.first("value"))
