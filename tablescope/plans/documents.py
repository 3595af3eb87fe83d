"""Whole documents: from tables, facts or page texts to checked statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablescope.operators import checks as K, statements as D
from tablescope.operators.facts import is_wide_statement, wide_to_facts
from tablescope.session import stored
from tablescope.sources.pages import page_quality
from tablescope.sources.sheets import prepare_cells, sheet_facts, sheet_records, workbook_route
from tablescope.sources.xml import xml_tables


def items_of_facts_table(df: DataFrame, row_no: str, doc: str = "doc_id") -> DataFrame:
    """Items of a table with the columns of a fact table."""
    def column(name: str):
        return F.col(f"`{name}`") if name in df.columns else F.lit("")

    named = df.select(
        doc, F.col("`Line Item`").alias("line_item"), F.col("Period").alias("period"), F.col("Amount").alias("amount"),
        column("Statement").alias("statement"), column("Sheet").alias("sheet"), row_no)
    return D.items_from_facts(named, row_no, doc=doc)


def items_route(df: DataFrame, row_no: str, doc: str = "doc_id") -> DataFrame:
    """Items of tables by the first reading that gives a document worth keeping.

    Readings, in order: fact columns, period columns, label-period-value
    columns.  The schema decides which apply; the data decide per document.
    """
    readings = []
    if {"Line Item", "Period", "Amount"} <= set(df.columns):
        readings.append((1, lambda: items_of_facts_table(df, row_no, doc)))
    readings += [
        (2, lambda: D.items_from_period_columns(df, row_no, doc=doc)),
        (3, lambda: D.items_from_long(df, row_no, doc=doc)),
    ]
    found = []
    for route, read in readings:
        try:
            found.append(read().withColumn("route", F.lit(route)))
        except ValueError:
            continue  # this reading does not fit the schema
    if not found:
        raise ValueError("no reading fits the columns")
    rows = reduce(DataFrame.unionByName, found)
    # Items are counted per line first, then per document and reading.
    lines = rows.select(doc, "route", "line_id", "concept").distinct()
    kept = lines.groupBy(doc, "route").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("concept").alias("_figures")
    ).filter((F.col("_rows") >= D.KEEP_ITEMS) | (F.col("_figures") >= D.KEEP_FIGURES))
    first = F.row_number().over(Window.partitionBy(doc).orderBy("route"))
    chosen = kept.withColumn("_r", first).filter(F.col("_r") == 1).select(doc, "route")
    return rows.join(chosen, [doc, "route"])


def label_texts(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    return items.select(doc, F.concat(F.lit("label:"), "line_id").alias("place"), F.col("label").alias("text"))


def documents_from_items(
    items: DataFrame, texts: DataFrame | None = None, pages: DataFrame | None = None, doc: str = "doc_id"
) -> dict[str, DataFrame]:
    """Statements, key figures, checks and warnings of documents.

    ``texts`` (``doc_id, place, text``) is searched for periods, currency and
    scale; without them the labels are.  The items are written to the shared
    folder once, as all parts read them.
    """
    items = stored(items)
    if texts is None:
        texts = label_texts(items, doc)
    periods = D.choose_periods(items, texts, doc)
    members = D.statement_membership(items, doc=doc)
    summary = D.statement_summary(members, doc=doc)
    documents = D.document_confidence(items, periods, pages, doc)
    documents = documents.join(D.currency_scale_of(texts, ["place"], doc), doc, "left").withColumn(
        "scale", F.coalesce("scale", F.lit("unknown")))
    return {
        "items": items,
        "periods": periods,
        "statements": summary,
        "membership": members,
        "key_figures": D.key_figures(items, periods, doc=doc),
        "documents": documents,
        "checks": K.document_checks(items, periods, summary, documents, doc),
        "warnings": D.document_warnings(documents, doc),
        "overview": D.document_overview(members, summary, pages, doc),
    }


def documents_from_pages(pages: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Documents of page texts ``(doc_id, page_no, text)``.

    Also gives the parsed ``lines``.  Pages may bring a ``confidence``.
    """
    given = F.col("confidence") if "confidence" in pages.columns else None
    scored = pages.withColumn("quality", page_quality(F.col("text"), given))
    lines = stored(D.parse_lines(D.segment_lines(pages.select(doc, "page_no", "text"), doc), doc=doc))
    texts = lines.select(doc, F.struct("page_no", "line_no").alias("place"), "text")
    parts = documents_from_items(D.items_from_lines(lines, doc), texts, scored.select(doc, "quality"), doc)
    parts["lines"] = lines
    return parts


def documents_from_table(df: DataFrame, row_no: str, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Checked documents of tables: items by the first fitting reading, texts of labels and raw rows.

    Documents with too few items and figures are left out (D16).  Also gives
    ``raw_lines``.
    """
    items = items_route(df, row_no, doc).drop("route")
    kept = D.keep_documents(items, doc=doc).filter("kept").select(doc)
    raw = D.dataset_raw_lines(df, row_no, doc)
    rows = raw.select(doc, F.concat(F.lit("row:"), F.lpad(F.col("line_no").cast("string"), 19, "0")).alias("place"), "text")
    texts = label_texts(items, doc).unionByName(rows).join(kept, doc, "left_semi")
    parts = documents_from_items(items.join(kept, doc, "left_semi"), texts, doc=doc)
    parts["raw_lines"] = raw
    return parts


def statement_table_facts(df: DataFrame, row_no: str | None = None) -> DataFrame | None:
    """Facts of one table with a column per year, or None if it is no such table.

    The decision is one row, made over all rows of the table.
    """
    seen = is_wide_statement(df if row_no is None else df.drop(row_no)).first()
    if seen is None or not seen["is_wide"]:
        return None
    return wide_to_facts(df, seen["label_column"], row_no, statement=seen["statement"])


def documents_from_workbook(cells: DataFrame) -> dict[str, DataFrame]:
    """Workbooks: checked documents of the financial ones, merged ``records`` of the others."""
    cells = prepare_cells(cells)
    facts = stored(sheet_facts(cells))
    financial = workbook_route(facts).filter("financial").select("doc_id")
    others = cells.join(financial.withColumnRenamed("doc_id", "workbook"), "workbook", "left_anti")
    items = D.items_from_facts(facts.join(financial, "doc_id", "left_semi"), "row")
    parts = documents_from_items(items)
    parts["records"] = sheet_records(others)
    return parts


def documents_from_xml(documents: DataFrame) -> dict[str, DataFrame]:
    """Checked documents of the reported facts of XML documents ``(doc_id, text)``; also their ``tables`` by shape."""
    tables = xml_tables(documents)
    facts = stored(tables["facts"])
    parts = documents_from_items(D.items_from_facts(facts, "row_no", labels=stored(D.fact_labels(facts))))
    return parts | {"facts": facts, "linkbase": tables["linkbase"], "generic": tables["generic"]}
