"""Workbooks as cell tables.

A cell row has ``workbook, sheet, row, col, text, num``: places count from 0
over the non-blank rows of a sheet, ``num`` is set for numeric cells.  Rows of
a sheet are reduced (one row per sheet row) before they are ordered, and
sections are carried forward in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope import rules as R
from tablescope.functions.finance import sheet_period_label, unit_of, year_from_text
from tablescope.functions.patterns import first_match
from tablescope.functions.text import trim_ws
from tablescope.functions.values import parse_number
from tablescope.operators.carry import carry_forward
from tablescope.operators.facts import analysis_summary, to_facts
from tablescope.session import stored

SHEET = ("workbook", "sheet")
# Rows searched for a header and rows after it that count.
HEADER_ROWS, DENSE_ROWS = 12, 5
# Rows and columns searched for unit and statement type.
UNIT_ROWS, UNIT_COLUMNS, TYPE_ROWS = 4, 3, 8
# Columns and rows that choose the label column, and its scores.
LABEL_COLUMNS, LABEL_ROWS, LABEL_TEXT, LABEL_NUMBER = 6, 19, 20, 12
# Filled cells of a metric header, rows after it, numbers in them.
METRIC_CELLS, METRIC_ROWS, METRIC_NUMBERS = 3, 7, 3
# Fixed value: confidence from which a workbook counts as financial.
WORKBOOK_CONFIDENCE = 0.55

_ROWS_PER_BLOCK = 4_096


def read_cells(cells: DataFrame) -> DataFrame:
    """Cells with trimmed text and readable number; blank cells dropped."""
    if "number" in cells.columns:
        return cells
    text = trim_ws(F.coalesce("text", F.col("num").cast("string"), F.lit("")))
    return cells.select(
        *SHEET, "row", "col", text.alias("text"), "num",
        F.coalesce("num", parse_number(text)).alias("number"),
    ).filter(F.col("text") != "")


def prepare_cells(cells: DataFrame) -> DataFrame:
    """Readable cells, written once: a workbook is read several times over."""
    return cells if "number" in cells.columns else stored(read_cells(cells))


# Generic sheets -----------------------------------------------------------

def sheet_headers(cells: DataFrame, within: int = HEADER_ROWS, after_rows: int = DENSE_ROWS) -> DataFrame:
    """Best header row of each sheet among its first rows.

    The test is defined by its windows: rows ``within`` which a header is
    sought, and rows after it whose cells speak for it.
    """
    c = F.col
    filled = read_cells(cells).filter(c("row") < within + after_rows)
    textual = F.when(parse_number(c("text")).isNull(), 2).otherwise(0)
    rows = filled.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("_cells"), F.sum(textual).alias("_texts"))
    after = Window.partitionBy(*SHEET).orderBy("row").rangeBetween(1, after_rows)
    score = c("_cells") * 3 + c("_texts") + F.coalesce(F.sum("_cells").over(after), F.lit(0))
    scored = rows.withColumn("score", score).filter(c("row") < within)
    return scored.groupBy(*SHEET).agg(
        F.min_by("row", F.struct((-c("score")).alias("s"), c("row").alias("r"))).alias("header_row"),
        F.max("score").alias("score"),
    )


def rows_above_header(cells: DataFrame) -> DataFrame:
    """Cells above the header of each generic sheet: titles and notes that are no records."""
    headers = sheet_headers(cells).select(*SHEET, "header_row")
    return read_cells(cells).join(headers, list(SHEET)).filter(F.col("row") < F.col("header_row")).select(
        *SHEET, "row", "col", "text")


def header_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Names of the columns of each sheet: blanks filled, repeats numbered from 2."""
    c = F.col
    widths = cells.groupBy(*SHEET).agg(F.max("col").alias("_last"))
    places = headers.join(widths, list(SHEET)).withColumn(
        "col", F.explode(F.sequence(F.lit(0), c("_last"))))
    named = places.join(
        read_cells(cells).select(*SHEET, c("row").alias("header_row"), "col", c("text").alias("_name")),
        [*SHEET, "header_row", "col"], "left",
    ).withColumn("_base", F.coalesce("_name", F.concat(F.lit("Column "), (c("col") + 1).cast("string"))))
    nth = F.row_number().over(Window.partitionBy(*SHEET, "_base").orderBy("col"))
    field = F.when(nth == 1, c("_base")).otherwise(F.concat("_base", F.lit(" ("), nth.cast("string"), F.lit(")")))
    return named.select(*SHEET, "header_row", "col", field.alias("field"))


def sheet_records(cells: DataFrame) -> DataFrame:
    """Records of generic sheets in long form ``(…, row, source_row, col, field, value)``."""
    fields = header_names(cells, sheet_headers(cells))
    body = read_cells(cells).join(fields, [*SHEET, "col"]).filter(F.col("row") > F.col("header_row"))
    return body.select(
        *SHEET, "row", F.concat(F.lit("Row "), (F.col("row") + 1).cast("string")).alias("source_row"),
        "col", "field", F.col("text").alias("value"),
    )


def records_to_table(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long sheet records as a table with the given fields as columns."""
    return records.groupBy("workbook", F.col("sheet").alias("Sheet"), F.col("source_row").alias("Source Row")).pivot(
        "field", list(fields)).agg(F.first("value"))


def merge_by_name(*tables: DataFrame) -> DataFrame:
    """Union by column name; missing columns are null, first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# Financial sheets ---------------------------------------------------------

def sheet_statement_type(cells: DataFrame, rows: int = TYPE_ROWS) -> DataFrame:
    """Statement type of each sheet from its name and first ``rows``, or null."""
    head = read_cells(cells).filter(F.col("row") < rows).groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("_cells")
    )  # at most ``rows`` rows of one sheet
    sample = F.concat_ws(" ", "sheet", F.array_join(F.transform("_cells", lambda x: x["text"]), " "))
    return head.select(*SHEET, first_match(sample, R.SHEET_TYPE_RULES, F.lit(None).cast("string")).alias("statement_type"))


def detect_unit(cells: DataFrame, rows: int = UNIT_ROWS, columns: int = UNIT_COLUMNS) -> DataFrame:
    """Unit of each sheet from the cells of its first ``rows`` and ``columns``."""
    head = read_cells(cells).filter((F.col("row") < rows) & (F.col("col") < columns))
    units = head.withColumn("_u", unit_of(F.col("text"))).filter(F.col("_u").isNotNull())
    return units.groupBy(*SHEET).agg(F.min_by("_u", F.struct("row", "col")).alias("unit"))


def sheet_period_header(cells: DataFrame) -> DataFrame:
    """First row of each sheet that heads period columns."""
    c = F.col
    marked = read_cells(cells).withColumn("_p", sheet_period_label(c("text"), c("num")))
    rows = marked.groupBy(*SHEET, "row").agg(
        F.count("_p").alias("_periods"), F.count(F.lit(1)).alias("_cells"),
        F.count_if(c("_p").isNull() & c("number").isNotNull()).alias("_numbers"),
        F.min("col").alias("_first"),
        F.min(F.when(c("_p").isNotNull(), c("col"))).alias("_first_period"),
    )
    heads = (
        (c("_periods") > 0) & (c("_cells") >= 2) & (c("_first") != c("_first_period")) & (c("_numbers") <= 1)
    )
    return rows.filter(heads).groupBy(*SHEET).agg(
        F.min("row").alias("header_row"), F.min_by("_first_period", "row").alias("first_period_col"))


def metric_header(cells: DataFrame) -> DataFrame:
    """First row of each sheet that heads metric columns."""
    c = F.col
    rows = read_cells(cells).groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("_cells"), F.count("number").alias("_numbers"), F.max("col").alias("_last"))
    # Rows at block ends also serve the blocks before them, so that no window
    # spans a sheet.
    block = F.floor(c("row") / _ROWS_PER_BLOCK)
    reach = F.floor((c("row") - METRIC_ROWS) / _ROWS_PER_BLOCK)
    copies = rows.withColumn("_block", F.explode(F.array_distinct(F.array(block, F.greatest(reach, F.lit(0))))))
    after = Window.partitionBy(*SHEET, "_block").orderBy("row").rangeBetween(1, METRIC_ROWS)
    heads = copies.withColumn("_next", F.coalesce(F.sum("_numbers").over(after), F.lit(0))).filter(
        (block == c("_block")) & (c("_cells") >= METRIC_CELLS) & (c("_next") >= METRIC_NUMBERS))
    return heads.groupBy(*SHEET).agg(
        F.min("row").alias("header_row"), F.min_by("_last", "row").alias("last_col"))


def sheet_label_column(
    cells: DataFrame, headers: DataFrame, limit: Column, columns: int = LABEL_COLUMNS, rows: int = LABEL_ROWS
) -> DataFrame:
    """Column of the labels left of ``limit``: most text in the next ``rows``.

    ``limit`` is an expression over the header row of a sheet; only the first
    ``columns`` are tried.
    """
    c = F.col
    bound = headers.select(*SHEET, "header_row", F.greatest(F.lit(1), F.least(limit, F.lit(columns))).alias("_limit"))
    near = read_cells(cells).join(bound, list(SHEET)).filter(
        (c("col") < c("_limit")) & (c("row") > c("header_row")) & (c("row") <= c("header_row") + rows))
    points = F.least(F.lit(LABEL_TEXT), F.length("text")) - F.when(c("number").isNotNull(), LABEL_NUMBER).otherwise(0)
    scored = near.groupBy(*SHEET, "col").agg(F.sum(points).alias("_score"))
    # Columns without any cell score 0 and still beat a negative score.
    frame = bound.withColumn("col", F.explode(F.sequence(F.lit(0), c("_limit").cast("int") - 1)))
    scored = frame.join(scored, [*SHEET, "col"], "left").withColumn("_score", F.coalesce("_score", F.lit(0)))
    return scored.groupBy(*SHEET).agg(
        F.min_by("col", F.struct((-c("_score")).alias("s"), c("col").alias("c"))).alias("label_col"))


def _notes_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    heads = read_cells(cells).join(headers.select(*SHEET, "header_row"), list(SHEET)).filter(
        (F.col("row") == F.col("header_row")) & F.col("text").rlike(r"(?i)\Anotes?\z"))
    return heads.groupBy(*SHEET).agg(F.min("col").alias("notes_col"))


def _labelled_rows(cells: DataFrame, layout: DataFrame, columns: DataFrame) -> DataFrame:
    """Amounts and labels below the header: one row per sheet row.

    ``columns`` has the value columns of each sheet with a ``name``.  A row with
    a label and no amount is a heading.
    """
    c = F.col
    body = read_cells(cells).join(layout, list(SHEET)).filter(c("row") > c("header_row"))
    body = body.join(columns, [*SHEET, "col"], "left")
    amount = F.when(c("name").isNotNull() & c("number").isNotNull(),
                    F.struct(c("col").alias("col"), c("name").alias("name"), c("number").alias("amount")))
    rows = body.groupBy(*SHEET, "row").agg(
        F.max(F.when(c("col") == c("label_col"), c("text"))).alias("line_item"),
        F.max(F.when(c("col") == c("notes_col"), c("text"))).alias("note"),
        F.array_sort(F.collect_list(amount)).alias("amounts"),
    )  # at most the width of a sheet per row
    rows = rows.filter(c("line_item").isNotNull())
    heading = F.size("amounts") == 0
    return rows.withColumn("heading", F.when(heading, c("line_item"))).withColumn(
        "heading_period", F.when(heading, year_from_text(c("line_item"))))


def _layout(cells: DataFrame, headers: DataFrame, limit: Column) -> DataFrame:
    labels = sheet_label_column(cells, headers, limit)
    notes = _notes_column(cells, headers)
    return headers.select(*SHEET, "header_row").join(labels, list(SHEET)).join(notes, list(SHEET), "left")


def _to_facts(rows: DataFrame, sheets: DataFrame, metric: Column, period: Column) -> DataFrame:
    c = F.col
    kinds = sheets.select(*SHEET, "statement_type", "unit")
    return rows.join(kinds, list(SHEET)).withColumn("_v", F.explode("amounts")).select(
        F.col("workbook").alias("doc_id"), "sheet", c("statement_type").alias("statement"),
        F.coalesce("section", F.lit("")).alias("section"), "line_item", metric.alias("metric"),
        period.alias("period"), c("_v.amount").alias("amount"), F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.concat(F.lit("Row "), (c("row") + 1).cast("string")).alias("source_row"),
        c("row").cast("long").alias("row"),
    )


def sheet_period_facts(cells: DataFrame) -> DataFrame:
    """Facts of sheets with period columns; headings carry forward."""
    c = F.col
    cells = prepare_cells(cells)
    sheets = _typed_sheets(cells)
    headers = stored(sheet_period_header(cells).join(sheets, list(SHEET)))  # one row per sheet
    columns = read_cells(cells).join(headers.select(*SHEET, "header_row"), list(SHEET)).filter(
        c("row") == c("header_row")
    ).select(*SHEET, "col", sheet_period_label(c("text"), c("num")).alias("name")).filter(c("name").isNotNull())
    layout = stored(_layout(cells, headers, c("first_period_col")))
    rows = _labelled_rows(cells, layout, columns)
    filled = carry_forward(rows, SHEET, ["row"], F.floor(c("row") / _ROWS_PER_BLOCK), {"section": "heading"})
    return _to_facts(filled, headers, F.lit("Amount"), c("_v.name"))


def sheet_metric_facts(cells: DataFrame) -> DataFrame:
    """Facts of sheets without period columns: one per metric column."""
    c = F.col
    cells = prepare_cells(cells)
    sheets = _typed_sheets(cells).join(sheet_period_header(cells).select(*SHEET), list(SHEET), "left_anti")
    headers = stored(metric_header(cells).join(sheets, list(SHEET)))  # one row per sheet
    layout = stored(_layout(cells, headers, c("last_col") + 1))
    width = headers.select(*SHEET, "header_row", F.explode(F.sequence(F.lit(0), c("last_col"))).alias("col"))
    names = read_cells(cells).select(*SHEET, c("row").alias("header_row"), "col", c("text").alias("_name"))
    columns = width.join(names, [*SHEET, "header_row", "col"], "left").join(
        layout.select(*SHEET, "label_col", "notes_col"), list(SHEET)
    ).filter((c("col") != c("label_col")) & ~c("col").eqNullSafe(c("notes_col"))).select(
        *SHEET, "col",
        F.coalesce("_name", F.concat(F.lit("Column "), (c("col") + 1).cast("string"))).alias("name"))
    rows = _labelled_rows(cells, layout, columns)
    filled = carry_forward(
        rows, SHEET, ["row"], F.floor(c("row") / _ROWS_PER_BLOCK),
        {"section": "heading", "section_period": "heading_period"})
    period = F.coalesce(year_from_text(c("line_item")), c("section_period"), F.lit("Unspecified period"))
    return _to_facts(filled, headers, c("_v.name"), period)


def _typed_sheets(cells: DataFrame) -> DataFrame:
    types = sheet_statement_type(cells).filter(F.col("statement_type").isNotNull())
    return types.join(detect_unit(cells), list(SHEET), "left")


def sheet_facts(cells: DataFrame) -> DataFrame:
    """Facts of all financial sheets."""
    cells = prepare_cells(cells)
    return sheet_period_facts(cells).unionByName(sheet_metric_facts(cells))


def sheet_meta(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Size, kind, statement type and unit of each sheet."""
    c = F.col
    size = cells.groupBy(*SHEET).agg(
        (F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("column_count"))
    counts = facts.groupBy(c("doc_id").alias("workbook"), "sheet").agg(F.count(F.lit(1)).alias("fact_count"))
    header = sheet_headers(cells).select(*SHEET, "header_row")
    below = read_cells(cells).select(*SHEET, "row").distinct().join(header, list(SHEET)).filter(
        c("row") > c("header_row")).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("record_count"))
    rows = size.join(counts, list(SHEET), "left").join(below, list(SHEET), "left").join(
        _typed_sheets(cells), list(SHEET), "left").na.fill(0, ["fact_count", "record_count"])
    kind = F.when(c("fact_count") > 0, "financial-table").when(c("record_count") > 0, "table").otherwise("empty")
    imported = F.when(c("fact_count") > 0, c("fact_count")).otherwise(c("record_count"))
    return rows.select(
        *SHEET, "row_count", "column_count", imported.alias("imported_rows"), kind.alias("kind"),
        "statement_type", "unit")


def workbook_route(facts: DataFrame) -> DataFrame:
    """Workbooks that go the financial way: an analysis with enough confidence.

    Other workbooks are merged as generic tables.
    """
    found = analysis_summary(to_facts(facts))
    return found.select("doc_id", "confidence", (F.col("confidence") >= WORKBOOK_CONFIDENCE).alias("financial"))
