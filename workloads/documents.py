"""Sources: delimited files, sheets, XML, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tablescope.functions import finance as M
from tablescope.plans import documents as plan
from tablescope.functions.text import describe_span, split_lines, squeeze, title_from_name, truncate
from tablescope.session import shared_folder, spread
from tablescope.sources import files, pages as G, sheets as S, xml as X
from tablescope.sources.delimited import read_delimited, read_issues, read_summary
from workloads.common import longs, rounded, table
from workloads.statements import FACTS, LABELS, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Delimited files ----------------------------------------------------------

_TEXT_ORDERS = """
select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, format('{:.2f}', o_totalprice) as price, o_orderpriority from orders"""


def _written(spark, sf, suffix: str, sep: str) -> str:
    """Orders written as delimited files to a new folder."""
    folder = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("price"), "o_orderpriority")
    rows.write.option("header", True).option("sep", sep).csv(f"{folder}/{suffix}")
    return f"{folder}/{suffix}"


@query("read_delimited", _TEXT_ORDERS)
def _read_delimited(spark, sf):
    return read_delimited(spark, _written(spark, sf, "csv", "|"))


@query("read_any", _TEXT_ORDERS)
def _read_any(spark, sf):
    """The files end in .csv, which chooses the reader."""
    return files.read_any(spark, _written(spark, sf, "csv", ","))["csv"]


def _written_with_faults(spark, sf) -> str:
    """Order lines; of pending orders the last field is missing, urgent ones have one too many, each tenth key has a blank row."""
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    whole = F.concat_ws("|", *fields)
    line = (F.when(F.col("o_orderstatus") == "P", F.concat_ws("|", *fields[:2]))
            .when(F.col("o_orderpriority") == "1-URGENT", F.concat(whole, F.lit("|more"))).otherwise(whole))
    lines = F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit("| |"))).otherwise(F.array(line))
    # The header line is the name of the one column.
    rows = table(spark, sf, "orders").select(F.explode(lines).alias("|".join(fields)))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return path


@query("read_issues", """
    select 'The row has more or fewer fields than its header.' as message,
           case when o_orderstatus = 'P' then o_orderkey || '|' || o_orderstatus
                else o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|more' end as row
    from orders where o_orderstatus = 'P' or o_orderpriority = '1-URGENT'
""")
def _read_issues(spark, sf):
    return read_issues(spark, _written_with_faults(spark, sf))


@query("read_summary", """
    select 3::bigint as columns, count(*) as rows, count(*) filter (o_orderkey % 10 = 0) as blank_rows,
           count(*) filter (o_orderstatus = 'P' or o_orderpriority = '1-URGENT') as malformed_rows,
           case when count(*) = 0 then 'There are columns but no rows.' end as error
    from orders
""")
def _read_summary(spark, sf):
    return read_summary(spark, _written_with_faults(spark, sf))


# Pages --------------------------------------------------------------------

@query("fragments_to_lines", """
select c_custkey as doc_id, 1::bigint as page_no, 'Balance   ' || format('{:.2f}', c_acctbal) || chr(10) || 'Segment ' || c_mktsegment as text from customer""")
def _fragments(spark, sf):
    """Two lines per page: a wide gap, a narrow gap and an uneven baseline."""
    def piece(x, y, w, text):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), text.alias("str"))

    parts = F.array(
        piece(101.0, 680.0, 60.0, F.col("c_mktsegment")), piece(70.0, 700.0, 40.0, F.lit("Balance")),
        piece(330.0, 701.5, 50.0, F.format_string("%.2f", "c_acctbal")), piece(70.0, 681.0, 30.0, F.lit("Segment")),
        piece(75.0, 690.5, 0.0, F.lit(" ")))
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.inline(parts))
    return G.fragments_to_lines(rows)


_PACKED = "length(regexp_replace(text, '[\\s\\x{0b}\\x{a0}\\x{feff}\\x{2028}\\x{2029}\\x{3000}]', '', 'g'))"


@query("page_text_status", f"""
select doc_id, case when {_PACKED} > 80 then 'embedded_text' else 'none' end as mode,
 case when {_PACKED} > 80 then '' else 'Little or no embedded text on this page; it may be scanned or image-based.' end as warning from documents""")
def _status(spark, sf):
    pages = G.page_text_status(table(spark, sf, "documents").select("doc_id", "text"))
    return pages.select("doc_id", "mode", F.array_join("warnings", "; ").alias("warning"))


def _ocr(spark, sf) -> DataFrame:
    pages = G.page_text_status(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_no"), "source", "text"))
    labels = table(spark, sf, "labels")
    results = labels.select(
        "doc_id", F.lit(1).alias("page_no"),
        F.when(F.col("toxic") == 1, " ").otherwise(F.concat(F.lit("read "), F.col("doc_id").cast("string"))).alias("text"),
        (F.col("quality") * 0.5 + 0.3).alias("confidence"))
    return G.merge_ocr(pages, results)


_MERGED = f"""
m as (select d.doc_id, d.source, d.text, l.doc_id is not null as seen, l.toxic = 0 as useful, {_PACKED} > 80 as has_text, l.quality * 0.5 + 0.3 as conf
      from documents d left join labels l on l.doc_id = d.doc_id),
mm as (select doc_id, source, case when useful then 'read ' || doc_id else text end as text,
 case when useful then 'ocr' when has_text then 'embedded_text' else 'none' end as mode,
 array_to_string(list_filter([case when not has_text and useful is not true then 'Little or no embedded text on this page; it may be scanned or image-based.' end,
  case when seen and not useful then 'OCR produced no readable text for this page.' end], lambda x: x is not null), '; ') as warnings,
 cast(conf as double) as confidence from m)"""


@query("ocr_merge", f"with {_MERGED} select doc_id, text, mode, warnings, confidence from mm")
def _ocr_merge(spark, sf):
    merged = _ocr(spark, sf)
    return merged.select("doc_id", "text", "mode", F.array_join("warnings", "; ").alias("warnings"), "confidence")


@query("document_mode", f"""with {_MERGED}
select source as doc_id, case when bool_or(mode = 'embedded_text') and bool_or(mode = 'ocr') then 'mixed' when bool_or(mode = 'ocr') then 'ocr'
 when bool_or(mode = 'embedded_text') then 'embedded_text' else 'none' end as mode, bool_or(mode = 'none') as suggest_ocr from mm group by 1""")
def _mode(spark, sf):
    return G.document_mode(_ocr(spark, sf).drop("doc_id").withColumnRenamed("source", "doc_id"))


_QUALITY = """least(0.96, least(0.5, length({t}) / 3000) + least(0.3, len(list_filter(string_split_regex({t}, '\\r?\\n'),
 lambda s: regexp_matches(s, '[^\\s\\x{{a0}}\\x{{feff}}\\x{{0b}}]'))) / 80)
 + case when regexp_matches({t}, '(income statement|statement of financial position|balance sheet|cash flow|revenue|total assets|profit before tax|kontantstrøm|balanse|resultatregnskap)', 'i')
   then 0.16 else 0.0 end)"""


@query("page_quality", f"""with {_MERGED}
select doc_id, round(case when confidence is not null then greatest(0.05, least(0.96, confidence)) else {_QUALITY.format(t='text')} end, 6)::double as quality from mm""")
def _quality(spark, sf):
    pages = _ocr(spark, sf)
    return rounded(pages.select("doc_id", G.page_quality(F.col("text"), F.col("confidence")).alias("quality")), 6)


@query("lines_in_text", """
with x as (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as l from documents),
s as (select doc_id, trim(regexp_replace(l, '[\\s\\x{0b}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')) as l from x)
select doc_id, count(*) as lines, cast(sum(length(l)) as bigint) as chars from s where l <> '' group by 1""")
def _lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(split_lines(F.col("text"))).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("l")).alias("chars"))


@query("squeeze_truncate", """
select item_id, case when length(s) <= 60 then s else s[1:57] || '...' end as text from (
 select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from benchmark)""")
def _squeeze(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", truncate(squeeze(F.col("text")), 60).alias("text"))


@query("lines_as_table", """
select conv_id as doc_id, cast(turn + 1 as varchar) as "Page", 'ocr' as "Mode", case role when 'user' then 'Income Statement' when 'assistant' then 'Balance Sheet'
 else 'Unclassified / Review Needed' end as "Statement", case when role = 'user' then 'yes' else 'no' end as "Parsed",
 case when role = 'user' then '58' else '25' end as "Confidence", text as "Text" from conversations""")
def _lines_table(spark, sf):
    asked = F.col("role") == "user"
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.lit("ocr").alias("mode"), "text", asked.alias("parsed"),
        F.when(asked, "income_statement").when(F.col("role") == "assistant", "balance_sheet").otherwise("unknown").alias("kind"),
        F.when(asked, 0.58).otherwise(0.25).alias("confidence"))
    return G.lines_as_table(lines)


@query("empty_documents", """
select d.doc_id, '' as "Page", 'none' as "Mode", 'Unclassified / Review Needed' as "Statement", 'no' as "Parsed", '0' as "Confidence",
 'No extractable PDF text was found.' as "Text" from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def _empty(spark, sf):
    return G.empty_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("titles_and_spans", """
select o_orderkey, 'big ' || upper(o_orderpriority[3]) || o_orderpriority[4:] || ' of Orders.tar' as title,
 case when d < 0 then '' when d = 0 then 'a single point in time' when d < 45 then 'about ' || d || ' days'
  when d < 730 then 'about ' || cast(floor(d / 30 + 0.5) as bigint) || ' months' else 'about ' || format('{:.1f}', round(d / 365, 1)) || ' years' end as span
from (select *, date_diff('day', date '1995-01-01', o_orderdate::date) - 1 as d from orders)""")
def _titles(spark, sf):
    rows = table(spark, sf, "orders")
    name = F.concat(F.lit("big_"), F.substring("o_orderpriority", 3, 20), F.lit("-of__orders.tar.csv"))
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) - 1
    return rows.select("o_orderkey", title_from_name(name).alias("title"),
                       describe_span(days).alias("span"))


# Sheets -------------------------------------------------------------------

def statement_cells(spark, sf) -> DataFrame:
    """Workbooks of three statement sheets: title, header, a heading, items."""
    rows = facts(spark, sf).select(
        F.concat(F.lit("wb"), F.col("doc_id").cast("string")).alias("workbook"), "sheet", "line_item", "amount",
        M.period_year(F.col("period")).alias("y"),
        (F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("line_item")) - 1).cast("int").alias("place"))
    row = F.col("place") % 5 + 3

    def cell(r, c, text, num=None):
        return F.struct(F.lit(r).cast("int").alias("row") if isinstance(r, int) else r.cast("int").alias("row"),
                        F.lit(c).cast("int").alias("col") if isinstance(c, int) else c.cast("int").alias("col"),
                        text.cast("string").alias("text"), (F.lit(None) if num is None else num).cast("double").alias("num"))

    amounts = rows.select("workbook", "sheet", F.inline(F.array(cell(row, 2 + 2001 - F.col("y"), F.col("amount"), F.col("amount")))))
    labels = rows.select("workbook", "sheet", "line_item", "place").distinct().select(
        "workbook", "sheet", F.inline(F.array(cell(row, 0, F.col("line_item")), cell(row, 1, F.col("place"), F.col("place")))))
    head = [cell(0, 0, F.lit("Amounts in NOK thousand (audited)")), cell(1, 1, F.lit("Note")), cell(2, 0, F.lit("Group accounts"))]
    head += [cell(1, 2 + i, F.lit(f"{2001 - i}"), F.lit(2001.0 - i)) for i in range(7)]
    heads = rows.select("workbook", "sheet").distinct().select("workbook", "sheet", F.inline(F.array(*head)))
    return amounts.unionByName(labels).unionByName(heads)


def price_cells(spark, sf) -> DataFrame:
    """Workbooks of parts without periods in the header: fifty parts per sheet."""
    part = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 50).cast("string")).alias("workbook"),
        F.lit("Revenue from contracts").alias("sheet"), (F.col("p_partkey") % 50 + 2).cast("int").alias("row"), "p_name", "p_size", "p_retailprice")

    def cell(row, col, text, num=None):
        return F.struct(row.alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"),
                        (F.lit(None) if num is None else num).cast("double").alias("num"))

    body = part.select("workbook", "sheet", F.inline(F.array(
        cell(F.col("row"), 0, F.col("p_name")), cell(F.col("row"), 1, F.col("p_size"), F.col("p_size")),
        cell(F.col("row"), 2, F.col("p_retailprice"), F.col("p_retailprice")))))
    heads = part.select("workbook", "sheet").distinct().select("workbook", "sheet", F.inline(F.array(
        cell(F.lit(0), 0, F.lit("Product")), cell(F.lit(0), 1, F.lit("Size")), cell(F.lit(0), 2, F.lit("Price")),
        cell(F.lit(1), 0, F.lit("Year 2020")))))
    return body.unionByName(heads)


def customer_cells(spark, sf) -> DataFrame:
    """Generic sheets: a title, a header with a blank and a repeated name, rows."""
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 100).cast("string")).alias("workbook"), F.lit("list").alias("sheet"),
        (F.col("c_custkey") % 100 + 2).cast("int").alias("row"), "c_name", "c_mktsegment", "c_acctbal")

    def cell(row, col, text, num=None):
        return F.struct(row.alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"),
                        (F.lit(None) if num is None else num).cast("double").alias("num"))

    body = rows.select("workbook", "sheet", F.inline(F.array(
        cell(F.col("row"), 0, F.col("c_name")), cell(F.col("row"), 1, F.lit("x")), cell(F.col("row"), 2, F.col("c_mktsegment")),
        cell(F.col("row"), 3, F.col("c_acctbal"), F.col("c_acctbal")))))
    heads = rows.select("workbook", "sheet").distinct().select("workbook", "sheet", F.inline(F.array(
        cell(F.lit(0), 0, F.lit("List of customers")), cell(F.lit(1), 0, F.lit("Name")), cell(F.lit(1), 2, F.lit("Name")),
        cell(F.lit(1), 3, F.lit("Balance")), cell(F.lit(1), 4, F.lit("Memo")), cell(F.lit(1), 5, F.lit("Remarks")))))
    return body.unionByName(heads)


@query("sheet_headers", """
select distinct 'c' || (c_custkey // 100) as workbook, 1::bigint as header_row from customer""")
def _sheet_headers(spark, sf):
    return longs(S.sheet_headers(customer_cells(spark, sf)).select("workbook", "header_row"), "header_row")


@query("sheet_records", """
with r as (select 'c' || (c_custkey // 100) as workbook, 'Row ' || (c_custkey % 100 + 3) as source_row, * from customer)
select workbook, source_row, 'Name' as field, c_name as value from r union all select workbook, source_row, 'Column 2', 'x' from r
union all select workbook, source_row, 'Name (2)', c_mktsegment from r
union all select workbook, source_row, 'Balance', cast(c_acctbal as varchar) from r""")
def _sheet_records(spark, sf):
    return S.sheet_records(customer_cells(spark, sf)).select("workbook", "source_row", "field", "value")


@query("sheet_table", """
select 'c' || (c_custkey // 100) as workbook, 'list' as "Sheet", 'Row ' || (c_custkey % 100 + 3) as "Source Row", c_name as "Name",
 c_mktsegment as "Name (2)" from customer""")
def _sheet_table(spark, sf):
    return S.records_to_table(S.sheet_records(customer_cells(spark, sf)), ["Name", "Name (2)"])


_BOOK = "'wb' || doc_id"


@query("sheet_types_units", f"""with {FACTS}
select distinct {_BOOK} as workbook, statement as sheet, statement as statement_type, 'NOK thousand' as unit, 1::bigint as header_row, 2::bigint as first_period_col from facts""")
def _sheet_types(spark, sf):
    cells = statement_cells(spark, sf)
    rows = S.sheet_statement_type(cells).join(S.detect_unit(cells), ["workbook", "sheet"]).join(
        S.sheet_period_header(cells), ["workbook", "sheet"])
    return longs(rows, "header_row", "first_period_col")


@query("sheet_period_facts", f"""with {FACTS}
select {_BOOK} as doc_id, statement as sheet, statement, 'Group accounts' as section, line_item, 'Amount' as metric, period, amount, 'NOK thousand' as unit,
 cast(row_no // 10000 as varchar) as note, 'Row ' || (row_no // 10000 % 5 + 4) as source_row from facts""")
def _period_facts(spark, sf):
    return S.sheet_period_facts(statement_cells(spark, sf)).drop("row")


@query("sheet_metric_facts", """
with p as (select 'p' || (p_partkey // 50) as doc_id, 'Year 2020' as section, p_name as line_item, 'FY 2020' as period, 'Row ' || (p_partkey % 50 + 3) as source_row,
  'Revenue note' as statement, p_size, p_retailprice from part)
select doc_id, section, line_item, 'Size' as metric, period, cast(p_size as double) as amount, source_row, statement from p
union all select doc_id, section, line_item, 'Price', period, p_retailprice, source_row, statement from p""")
def _metric_facts(spark, sf):
    df = S.sheet_metric_facts(price_cells(spark, sf))
    return df.select("doc_id", "section", "line_item", "metric", "period", "amount", "source_row", "statement")


@query("sheet_meta", f"""with {FACTS}
select {_BOOK} as workbook, statement as sheet, cast(max(row_no // 10000 % 5) + 4 as bigint) as row_count, 9::bigint as column_count,
 count(*) as imported_rows, 'financial-table' as kind, statement as statement_type, 'NOK thousand' as unit from facts group by doc_id, statement
union all select 'c' || (c_custkey // 100), 'list', max(c_custkey % 100) + 3, 6, count(*), 'table', null, null from customer group by 1""")
def _sheet_meta(spark, sf):
    """Facts of the statement workbooks, records of the lists."""
    cells = S.prepare_cells(statement_cells(spark, sf).unionByName(customer_cells(spark, sf)))
    return longs(S.sheet_meta(cells, S.sheet_facts(cells)), "row_count", "column_count", "imported_rows")


@query("workbook_route", f"""with {FACTS},
n as (select doc_id, count(*) as n, count(distinct statement) as st, count(distinct period) as p from facts group by 1 having count(*) >= 8)
select {_BOOK} as doc_id, round(least(0.96, 0.38 + least(0.24, st * 0.04) + least(0.18, p * 0.06) + least(0.16, n / 500)), 6) as confidence,
 0.38 + least(0.24, st * 0.04) + least(0.18, p * 0.06) + least(0.16, n / 500) >= 0.55 as financial from n""")
def _workbook_route(spark, sf):
    return rounded(S.workbook_route(S.sheet_facts(statement_cells(spark, sf))), 6)


# XML ----------------------------------------------------------------------

def instances(spark, sf) -> DataFrame:
    """One small XBRL document per order."""
    xml = (
        '<?xml version="1.0"?><xbrl><context id="c1"><entity><identifier scheme="s">%d</identifier><segment>'
        '<explicitMember dimension="ax:OrderPriorityAxis">mem:Status%sMember</explicitMember></segment></entity><period>'
        "<startDate>%d-01-01</startDate><endDate>%d-12-31</endDate></period></context>"
        '<context id="c2"><entity><identifier scheme="s">%d</identifier></entity><period><instant>%d-12-31</instant></period></context>'
        '<unit id="u1"><measure>iso4217:NOK</measure></unit><unit id="u2"><divide><unitNumerator><measure>iso4217:NOK</measure>'
        "</unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>"
        '<ifrs-full:Revenue contextRef="c1" unitRef="u1" decimals="2">%s</ifrs-full:Revenue>'
        '<p>note <ix:nonFraction name="ifrs-full:ProfitLoss" contextRef="c1" unitRef="u1" scale="3" sign="-"> <b>%d</b> </ix:nonFraction></p>'
        '<ifrs-full:EarningsPerShare contextRef="c2" unitRef="u2">%d</ifrs-full:EarningsPerShare>'
        '<ifrs-full:NameOfReportingEntity contextRef="cx">%s &amp; Co</ifrs-full:NameOfReportingEntity></xbrl>'
    )
    y = F.year("o_orderdate")
    text = F.format_string(xml, "o_custkey", "o_orderstatus", y, y, "o_custkey", y, F.format_string("%,.2f", "o_totalprice"),
                           "o_orderkey", "o_custkey", "o_orderpriority")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    return spread(orders, "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


_ORDERS_Y = "o as (select *, year(o_orderdate) as y from orders)"


_CHILDREN = """[
 {p: '/xbrl', t: '', a: '', c: 8}, {p: '/xbrl/context', t: '', a: 'id="c1"', c: 2}, {p: '/xbrl/context/entity', t: '', a: '', c: 2},
 {p: '/xbrl/context/entity/identifier', t: cust, a: 'scheme="s"', c: 0}, {p: '/xbrl/context/entity/segment', t: '', a: '', c: 1},
 {p: '/xbrl/context/entity/segment/explicitMember', t: 'mem:Status' || o_orderstatus || 'Member', a: 'dimension="ax:OrderPriorityAxis"', c: 0},
 {p: '/xbrl/context/period', t: '', a: '', c: 2}, {p: '/xbrl/context/period/startDate', t: y || '-01-01', a: '', c: 0},
 {p: '/xbrl/context/period/endDate', t: y || '-12-31', a: '', c: 0},
 {p: '/xbrl/context', t: '', a: 'id="c2"', c: 2}, {p: '/xbrl/context/entity', t: '', a: '', c: 1},
 {p: '/xbrl/context/entity/identifier', t: cust, a: 'scheme="s"', c: 0}, {p: '/xbrl/context/period', t: '', a: '', c: 1},
 {p: '/xbrl/context/period/instant', t: y || '-12-31', a: '', c: 0},
 {p: '/xbrl/unit', t: '', a: 'id="u1"', c: 1}, {p: '/xbrl/unit/measure', t: 'iso4217:NOK', a: '', c: 0},
 {p: '/xbrl/unit', t: '', a: 'id="u2"', c: 1}, {p: '/xbrl/unit/divide', t: '', a: '', c: 2},
 {p: '/xbrl/unit/divide/unitNumerator', t: '', a: '', c: 1}, {p: '/xbrl/unit/divide/unitNumerator/measure', t: 'iso4217:NOK', a: '', c: 0},
 {p: '/xbrl/unit/divide/unitDenominator', t: '', a: '', c: 1}, {p: '/xbrl/unit/divide/unitDenominator/measure', t: 'shares', a: '', c: 0},
 {p: '/xbrl/Revenue', t: format('{:,.2f}', o_totalprice), a: 'contextRef="c1" unitRef="u1" decimals="2"', c: 0},
 {p: '/xbrl/p', t: 'note', a: '', c: 1},
 {p: '/xbrl/p/nonFraction', t: '', a: 'name="ifrs-full:ProfitLoss" contextRef="c1" unitRef="u1" scale="3" sign="-"', c: 1},
 {p: '/xbrl/p/nonFraction/b', t: cast(o_orderkey as varchar), a: '', c: 0},
 {p: '/xbrl/EarningsPerShare', t: cust, a: 'contextRef="c2" unitRef="u2"', c: 0},
 {p: '/xbrl/NameOfReportingEntity', t: o_orderpriority || ' & Co', a: 'contextRef="cx"', c: 0}]"""


@query("flatten_xml", f"""
with o as (select *, cast(o_custkey as varchar) as cust, cast(year(o_orderdate) as varchar) as y from orders),
n as (select o_orderkey as doc_id, {_CHILDREN} as e from o),
x as (select doc_id, unnest(e) as e, generate_subscripts(e, 1) - 1 as node_id from n)
select doc_id, cast(node_id as bigint) as node_id, e.p as "Path", string_split(e.p, '/')[-1] as "Element", e.t as "Text", e.a as "Attributes",
 cast(len(string_split(e.p, '/')) - 2 as bigint) as "Depth", cast(e.c as bigint) as "Child Count" from x""")
def _flatten(spark, sf):
    """All elements of every document."""
    return longs(X.flatten_xml(X.xml_elements(X.parse_documents(instances(spark, sf)))), "node_id", "Depth", "Child Count")


@query("xml_element_counts", "select count(*) * 28 as elements, count(*) as documents from orders")
def _element_counts(spark, sf):
    return X.parse_documents(instances(spark, sf), columns=()).agg(F.count(F.lit(1)).alias("elements"), F.count_distinct("doc_id").alias("documents"))


@query("xbrl_contexts", f"""with {_ORDERS_Y}
select o_orderkey as doc_id, 'c1' as context_id, 'FY ' || y as period, cast(o_custkey as varchar) as entity,
 'Order Priority Axis: Status ' || case o_orderstatus when 'F' then 'F' when 'O' then 'O' else 'P' end || ' Member' as dimensions from o
union all select o_orderkey, 'c2', 'As of ' || y, cast(o_custkey as varchar), '' from o""")
def _contexts(spark, sf):
    return X.xbrl_contexts(instances(spark, sf))


@query("xbrl_units", """
select o_orderkey as doc_id, unnest(['u1', 'u2']) as unit_id, unnest(['iso4217:NOK', 'iso4217:NOK / shares']) as unit from orders""")
def _units(spark, sf):
    return X.xbrl_units(instances(spark, sf))


@query("xbrl_facts", f"""with {_ORDERS_Y}
select o_orderkey as doc_id, 'Revenue' as line_item, 'ifrs-full:Revenue' as metric, 'Income statement' as statement, 'FY ' || y as period, o_totalprice as amount,
 'iso4217:NOK' as unit, 'Fact 1' as source_row from o
union all select o_orderkey, 'Profit Loss', 'ifrs-full:ProfitLoss', 'Income statement', 'FY ' || y, -abs(o_orderkey * 1000.0), 'iso4217:NOK', 'Inline fact 2' from o
union all select o_orderkey, 'Earnings Per Share', 'ifrs-full:EarningsPerShare', 'Equity statement', 'As of ' || y, cast(o_custkey as double), 'iso4217:NOK / shares', 'Fact 3' from o
union all select o_orderkey, 'Name Of Reporting Entity', 'ifrs-full:NameOfReportingEntity', 'XBRL fact', 'Unspecified period', null, '', 'Fact 4' from o""")
def _xbrl_facts(spark, sf):
    df = X.xbrl_facts(instances(spark, sf))
    return rounded(df.select("doc_id", "line_item", "metric", "statement", "period", "amount", "unit", "source_row"), 2)


@query("xbrl_fact_notes", """
with o as (select *, 'Order Priority Axis: Status ' || o_orderstatus || ' Member' as axis from orders)
select o_orderkey as doc_id, 1::bigint as row_no, 'context c1 | decimals 2 | ' || axis as note, axis as section from o
union all select o_orderkey, 2, 'context c1 | scale 3 | ' || axis, axis from o
union all select o_orderkey, 3, 'context c2', cast(o_custkey as varchar) from o
union all select o_orderkey, 4, 'context cx | value: ' || o_orderpriority || ' & Co', '' from o""")
def _xbrl_notes(spark, sf):
    """The notes of every fact."""
    return X.xbrl_facts(instances(spark, sf)).select("doc_id", "row_no", "note", "section")


@query("documents_from_workbook", f"""with {FACTS}
select {_BOOK} as workbook, count(*) as rows, 'items' as kind from facts group by doc_id
union all select 'c' || (c_custkey // 100), count(*) * 4, 'records' from customer group by 1""")
def _documents_from_workbook(spark, sf):
    """Items of the financial workbooks, records of the lists."""
    parts = plan.documents_from_workbook(statement_cells(spark, sf).unionByName(customer_cells(spark, sf)))
    items = parts["items"].groupBy(F.col("doc_id").alias("workbook")).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("items"))
    return items.unionByName(parts["records"].groupBy("workbook").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("records")))


@query("documents_from_xml", """
select o_orderkey as doc_id, 3::bigint as item_rows, 2::bigint as periods from orders""")
def _documents_from_xml(spark, sf):
    parts = plan.documents_from_xml(instances(spark, sf))
    return parts["items"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("item_rows"), F.count_distinct("period").alias("periods"))


def linkbases(spark, sf) -> DataFrame:
    """One small linkbase per part: a calculation and labels in two languages."""
    xml = (
        '<linkbase><calculationLink xlink:role="http://x.org/role/BalanceSheet"><loc xlink:label="a" xlink:href="t.xsd#ifrs-full_TotalAssets"/>'
        '<loc xlink:label="b" xlink:href="t.xsd#ifrs-full_Part%dValue"/><calculationArc xlink:from="a" xlink:to="b" xlink:arcrole="http://x.org/arcrole/summation-item"'
        ' weight="1.0" order="%d"/><calculationArc xlink:from="a" xlink:to="zz" weight="-1"/></calculationLink>'
        '<labelLink xlink:role="http://x.org/role/link"><loc xlink:label="a" xlink:href="t.xsd#ifrs-full_TotalAssets"/>'
        '<label xlink:label="l" xlink:role="http://x.org/role/terseLabel" xml:lang="en">  %s  assets </label>'
        '<label xlink:label="l" xml:lang="no">Eiendeler</label><labelArc xlink:from="a" xlink:to="l"/></labelLink></linkbase>'
    )
    text = F.format_string(xml, "p_partkey", "p_size", "p_name")
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query("xbrl_arcs", """
select p_partkey as doc_id, 'Calculation' as linkbase, 'Balance Sheet' as role, 'summation item' as relationship, 'Total Assets' as from_concept,
 'Part' || p_partkey || ' Value' as to_concept, '1.0' as weight, cast(p_size as varchar) as "order", 't.xsd#ifrs-full_Part' || p_partkey || 'Value' as to_href from part
union all select p_partkey, 'Calculation', 'Balance Sheet', 'Calculation', 'Total Assets', '', '-1', '', '' from part""")
def _arcs(spark, sf):
    df = X.xbrl_arcs(X.stored_links(linkbases(spark, sf)))
    return df.select("doc_id", "linkbase", "role", "relationship", "from_concept", "to_concept", "weight", "order", "to_href")


@query("xbrl_labels", """
select p_partkey as doc_id, 'link' as role, 'Concept label' as relationship, 'Total Assets' as from_concept, p_name || ' assets' as label, 'terse Label' as preferred_label, 'en' as language from part
union all select p_partkey, 'link', 'Concept label', 'Total Assets', 'Eiendeler', '', 'no' from part""")
def _labels(spark, sf):
    df = X.xbrl_labels(X.stored_links(linkbases(spark, sf)))
    return df.select("doc_id", "role", "relationship", "from_concept", "label", "preferred_label", "language")


@query("xml_shapes", """
select 'facts' as shape, count(*) as documents from orders union all select 'linkbase', count(*) from part union all select 'generic', count(*) from supplier""")
def _shapes(spark, sf):
    plain = table(spark, sf, "supplier").select(
        (F.lit(-1) - F.col("s_suppkey")).alias("doc_id"), F.format_string("<s><name>%s</name></s>", "s_name").alias("text"))
    parts = linkbases(spark, sf).withColumn("doc_id", F.col("doc_id") + 1_000_000_000_000)
    shapes = X.xml_shapes(instances(spark, sf).unionByName(parts).unionByName(plain))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("documents"))


@query("xml_issues", """
select o_orderkey as doc_id, 'Not well-formed XML.' as message from orders where o_orderkey % 3 = 0""")
def _issues(spark, sf):
    """Small documents of the orders; every third lacks its end tag and is reported."""
    key = F.col("o_orderkey")
    body = F.concat(F.lit("<o><k>"), key.cast("string"), F.lit("</k>"), F.when(key % 3 == 0, "").otherwise("</o>"))
    made = table(spark, sf, "orders").select(key.alias("doc_id"), body.alias("text"))
    return X.xml_issues(X.parse_documents(made)).select("doc_id", F.regexp_extract("message", r"\A([^(]*\.)", 1).alias("message"))


@query("concept_names", """
select p_partkey, 'Trade And Other Current Receivables ' || p_brand[7:] as words, 'Total Assets' as uri, cast(p_partkey * -1000.0 as double) as value from part""")
def _concepts(spark, sf):
    number = F.substring("p_brand", 7, 5)
    concept = F.concat(F.lit("http://x.org/t.xsd#ifrs-full_TradeAndOtherCurrentReceivables-"), number)
    value = M.scaled_fact_value(F.col("p_partkey").cast("string"), F.lit("3"), F.lit("-"))
    return rounded(table(spark, sf, "part").select(
        "p_partkey", M.humanize_concept(concept).alias("words"), M.short_uri(F.lit("http://x.org/role/TotalAssets/")).alias("uri"), value.alias("value")), 2)


