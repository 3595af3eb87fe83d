"""Facts, statements and their checks.

Statement facts come from ``orders``: a customer's nation is the document,
status and priority choose the line item, the year is the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablescope.functions import finance as M
from tablescope.operators import checks as K, facts as N, statements as D
from tablescope.operators.carry import carry_forward
from tablescope.plans import documents as plan
from tablescope.plans.report import plan_report
from tablescope.rules import CONCEPT_RULES, HEADING_RULES, LABEL_KIND_RULES, METRIC_RULES
from workloads.common import longs, rounded, sql_percent, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LABELS = (
    "Revenue", "Cost of sales", "Operating profit", "Income tax expense", "Profit for the year",
    "Total assets", "Total equity", "Total liabilities", "Cash and cash equivalents", "Trade receivables",
    "Net cash from operating activities", "Net cash used in investing activities", "Dividends paid",
    "Total liabilities and equity", "Depreciation and amortization",
)
STATEMENTS = ("Income statement", "Balance sheet", "Cash flow statement")
_PLACE = "(cast(substr(o_orderpriority, 1, 1) as int) - 1) * 3 + case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end"
YEARS = tuple(range(1995, 2002))


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def facts(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.expr(_PLACE).alias("place"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    grouped = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").cast("long").alias("doc_id"), "place", "y").agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("place") + 1)
    statement = F.element_at(F.array(*[F.lit(x) for x in STATEMENTS]), F.floor(F.col("place") / 5).cast("int") + 1)
    return grouped.select(
        "doc_id", statement.alias("sheet"), statement.alias("statement"), F.lit("").alias("section"),
        label.alias("line_item"), F.lit("Amount").alias("metric"),
        F.concat(F.lit("FY "), F.col("y").cast("string")).alias("period"), "amount",
        F.when(F.col("doc_id") % 2 == 0, "NOK").otherwise("EUR").alias("unit"), F.lit("").alias("note"),
        F.lit("").alias("source_row"), (F.col("place") * 10_000 + F.col("y")).cast("long").alias("row_no"),
    )


_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_STATEMENT_LIST = "[" + ", ".join(f"'{x}'" for x in STATEMENTS) + "]"
FACTS = f"""
base as (select c_nationkey::bigint as doc_id, {_PLACE} as place, year(o_orderdate) as y, round(sum(o_totalprice), 2) as amount
         from orders join customer on o_custkey = c_custkey group by 1, 2, 3),
facts as (select doc_id, {_STATEMENT_LIST}[place // 5 + 1] as statement, {_LIST}[place + 1] as line_item, 'FY ' || y as period,
          y, amount, place * 10000 + y as row_no, case when doc_id % 2 = 0 then 'NOK' else 'EUR' end as unit from base)"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Rule tables as SQL rows: the twin of the queries joins them and ranks.
_RULE_ROWS = ", ".join(
    f"({i}, {_sql_text(r.concept)}, {_sql_text(r.label)}, {_sql_text(r.kind)}, {r.priority}, {_sql_text(p)})"
    for i, r in enumerate(CONCEPT_RULES) for p in r.patterns)
RULES = f"""
rules(no, concept, title, kind, priority, pattern) as (values {_RULE_ROWS})"""


def classified(labels: str) -> str:
    """CTEs that give ``cl(label, concept, kind)`` for the labels of a query."""
    keyword = " ".join(f"when regexp_matches(lb.label, {_sql_text(p)}, 'i') then '{k}'" for k, p in LABEL_KIND_RULES)
    return f"""{RULES},
lb as (select distinct label from ({labels})),
hit as (select lb.label, concept, kind, row_number() over (partition by lb.label order by priority desc, no) as r
        from lb join rules on regexp_matches(lb.label, pattern, 'i')),
cl as (select lb.label, concept, coalesce(kind, case {keyword} else 'unknown' end) as kind
       from lb left join (select * from hit where r = 1) h on h.label = lb.label)"""


_LABEL_SOURCE = "select line_item as label from facts"

# Scalars ------------------------------------------------------------------


@query("financial_number_cases", """
select l_orderkey, l_linenumber, cast(case when l_linenumber in (3, 6) then -l_extendedprice else l_extendedprice end as double) as parsed
from lineitem""")
def _financial_numbers(spark, sf):
    """Prices in US, European, Swiss and Norwegian notation are read back."""
    x, n = F.col("l_extendedprice"), F.col("l_linenumber")
    us = F.format_number(x, 2)
    european = F.translate(us, ",.", ".,")
    text = (
        F.when(n == 1, us).when(n == 2, european).when(n == 3, F.concat(F.lit("("), european, F.lit(")")))
        .when(n == 4, F.concat(F.lit("NOK "), F.translate(us, ",", " ")))
        .when(n == 5, F.translate(us, ",", "'")).when(n == 6, F.concat(F.lit("−"), us))
        .otherwise(F.concat(F.lit("€ "), F.translate(us, ",.", " ,")))
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return rounded(rows.select("l_orderkey", "l_linenumber", M.parse_financial_number(F.col("t")).alias("parsed")), 2)


@query("number_tokens", """
with t as (select o_orderkey, format('{:,.0f}', round(o_totalprice)) as a, '(' || format('{:,.2f}', o_totalprice) || ')' as b,
           12 as lead from orders)
select o_orderkey, 0::bigint as token, a as raw, cast(replace(a, ',', '') as double) as value, 12::bigint as pos from t
union all select o_orderkey, 1, b, -cast(replace(b[2:-2], ',', '') as double), 12 + length(a) + 3 from t""")
def _number_tokens(spark, sf):
    x = F.col("o_totalprice")
    text = F.concat(F.lit("Net sales   "), F.format_number(F.round(x), 0), F.lit("   ("), F.format_number(x, 2), F.lit(")"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.posexplode(M.number_tokens(text)).alias("token", "t"))
    return longs(rounded(rows.select("o_orderkey", "token", "t.raw", "t.value", "t.pos"), 2), "token", "pos")


@query("text_amounts", """
select doc_id, len(regexp_extract_all(text, '[0-9]')) as digits from documents where regexp_matches(text, '[0-9]')""")
def _text_amounts(spark, sf):
    """Digits inside the amount tokens of whole texts: none is lost."""
    docs = table(spark, sf, "documents")
    tokens = docs.select("doc_id", F.explode(M.amount_tokens(F.col("text"))).alias("raw"))
    digits = F.sum(F.length(F.regexp_replace("raw", "[^0-9]", "")))
    return tokens.groupBy("doc_id").agg(digits.alias("digits"))


@query("periods_in_text", """
select o_custkey as doc_id, 'FY ' || y as period from (
 select o_custkey, unnest([year(o_orderdate), year(o_orderdate) - 1]) as y from orders) group by 1, 2""")
def _periods_in_text(spark, sf):
    """Years named in the notes of each customer."""
    year = F.year("o_orderdate")
    text = F.format_string("Year ended 31 December %d, no 12019 or x2018 (FY %d)", year, year - 1)
    notes = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), text.alias("text"))
    years = D.text_years(notes)
    return years.select("doc_id", F.explode(F.transform("years", M.period_label)).alias("period"))


@query("period_functions", """
select o_orderkey, case when o_orderkey % 5 = 4 then null else 'FY ' || strftime(o_orderdate, '%Y') end as period,
 case when o_orderkey % 5 in (1, 2) then null when o_orderkey % 5 = 4 then null else 'FY ' || strftime(o_orderdate, '%Y') end as word_period,
 case when o_orderkey % 5 = 4 then null else year(o_orderdate) end as year from orders""")
def _period_functions(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    year = F.date_format(d, "yyyy")
    text = (
        F.when(k == 0, F.concat(F.lit("Year ended "), year)).when(k == 1, F.concat(F.lit("FY"), year))
        .when(k == 2, F.concat(F.lit("a"), year, F.lit("x"))).when(k == 3, F.date_format(d, "yyyy-MM-dd"))
        .otherwise("no date")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return longs(rows.select("o_orderkey", M.period_of(F.col("t")).alias("period"), M.year_from_text(F.col("t")).alias("word_period"),
                             M.period_year(F.col("t")).alias("year")), "year")


_SCALES = (
    "case when regexp_matches({t}, '(?i)\\b(amounts?\\s+in|in)\\b.{{0,40}}\\b(million|millions|mn|m)\\b') then 'millions' "
    "when regexp_matches({t}, '(?i)\\b(amounts?\\s+in|in)\\b.{{0,40}}\\b(thousand|thousands|000|tusen)\\b') then 'thousands' "
    "when regexp_matches({t}, '(?i)\\b(?:nok|eur|usd|gbp|sek|dkk)\\s*(?:''|’)?000\\b') then 'thousands' "
    "when regexp_matches({t}, '(?i)\\b(?:nok|eur|usd|gbp|sek|dkk)\\s*(?:m|mn|million)\\b') then 'millions' else 'unknown' end"
)


@query("currency_scale_in_text", f"""
select doc_id, case regexp_extract(text, '(?i)\\b(?:NOK|EUR|USD|GBP|SEK|DKK)\\b|[$€£]') when '' then null when '$' then 'USD'
 when '€' then 'EUR' when '£' then 'GBP' else upper(regexp_extract(text, '(?i)\\b(?:NOK|EUR|USD|GBP|SEK|DKK)\\b|[$€£]')) end as currency,
 {_SCALES.format(t='text')} as scale from documents""")
def _currency_scale(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", M.currency_scale(F.col("text")).alias("c"))
    return docs.select("doc_id", "c.currency", "c.scale")


@query("currency_scale_cases", """
select c_custkey, ['USD', 'NOK', 'EUR', null][c_custkey % 4 + 1] as currency,
 ['millions', 'thousands', 'thousands', 'unknown'][c_custkey % 4 + 1] as scale,
 cast([0.9, 0.9, 0.9, 0.0][c_custkey % 4 + 1] as double) as confidence from customer""")
def _currency_scale_cases(spark, sf):
    texts = F.array(F.lit("Amounts in $ million of "), F.lit("NOK '000 "), F.lit("Amounts in EUR thousand, "), F.lit("for "))
    text = F.concat(F.get(texts, (F.col("c_custkey") % 4).cast("int")), F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", M.currency_scale(text).alias("c")).select("c_custkey", "c.*")


@query("clean_labels", """
select p_partkey, p_name as label, trim(regexp_replace(lower(p_type || ' /' || p_brand), '[^a-z0-9]+', ' ', 'g')) as header from part""")
def _clean_labels(spark, sf):
    part = table(spark, sf, "part")
    label = F.concat(F.regexp_replace("p_name", " ", "   "), F.lit(" note "), F.col("p_size").cast("string"), F.lit(" ... :"))
    from tablescope.functions.text import normalize_header_text

    return part.select("p_partkey", M.clean_label(label).alias("label"),
                       normalize_header_text(F.concat_ws(" /", "p_type", "p_brand")).alias("header"))


@query("signed_changes", f"""with {FACTS},
p as (select a.doc_id, a.line_item, a.y, a.amount - b.amount as change, case when b.amount = 0 then null
        else (a.amount - b.amount) / abs(b.amount) * 100 end as pct
      from facts a join facts b on a.doc_id = b.doc_id and a.line_item = b.line_item and a.y = b.y + 1)
select doc_id, line_item, y::bigint as year, round(change, 2) as change, round(pct, 4) as change_pct from p""")
def _signed_changes(spark, sf):
    rows = facts(spark, sf).select("doc_id", "line_item", "amount", M.period_year(F.col("period")).alias("year"))
    prior = rows.select("doc_id", "line_item", F.col("amount").alias("prior"), (F.col("year") + 1).alias("year"))
    both = rows.join(prior, ["doc_id", "line_item", "year"]).withColumn("c", M.signed_change(F.col("amount"), F.col("prior")))
    df = both.select("doc_id", "line_item", "year", "c.change", "c.change_pct")
    return longs(rounded(rounded(df, 2, "change"), 4, "change_pct"), "year")


# Rules --------------------------------------------------------------------

@query("classify_labels", f"""with {FACTS}, {classified(_LABEL_SOURCE)}
select f.doc_id, f.line_item, f.period, cl.concept, cl.kind,
 coalesce((select any_value(title) from rules r where r.concept = cl.concept), cl.concept) as title
from facts f join cl on cl.label = f.line_item""")
def _classify(spark, sf):
    label = F.col("line_item")
    concept = M.classify_concept(label)
    return facts(spark, sf).select("doc_id", "line_item", "period", concept.alias("concept"),
                                   M.label_kind(label).alias("kind"), M.canonical_label(concept).alias("title"))


@query("classify_texts", f"""with t as (select l.doc_id, unnest(string_split_regex(text, '\\r?\\n')) as label from documents l),
{classified('select label from t')}
select doc_id, coalesce(concept, '') as concept, kind, count(*) as lines from t join cl on cl.label = t.label
where not regexp_full_match(t.label, '\\s*') group by 1, 2, 3""")
def _classify_texts(spark, sf):
    """Concept and kind of every line of the documents."""
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("label")).filter(~F.col("label").rlike(r"\A\s*\z"))
    rows = lines.select("doc_id", F.coalesce(M.classify_concept(F.col("label")), F.lit("")).alias("concept"),
                        M.label_kind(F.col("label")).alias("kind"))
    return rows.groupBy("doc_id", "concept", "kind").agg(F.count(F.lit(1)).alias("lines"))


_HEADING = " ".join(
    f"when regexp_matches({{t}}, {_sql_text('|'.join(p))}, 'i') then '{k}'" for k, p in HEADING_RULES)


@query("heading_kinds", f"""
select item_id, text, case {_HEADING.format(t='h')} end as kind, title from (
 select item_id, text, ['Consolidated income statement of ', 'Statement of financial position: ', 'Cash flow statement ', 'Notes to the ', ''][item_id % 5 + 1]
   || text as h, ['Income Statement', 'Balance Sheet', 'Cash Flow Statement', 'Notes deferred', null][item_id % 5 + 1] as title from benchmark)""")
def _headings(spark, sf):
    lead = F.get(F.array(*[F.lit(x) for x in (
        "Consolidated income statement of ", "Statement of financial position: ", "Cash flow statement ", "Notes to the ", "")]),
        (F.col("item_id") % 5).cast("int"))
    kind = M.heading_kind(F.concat(lead, F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", "text", kind.alias("kind"), M.statement_title(kind).alias("title"))


# Facts --------------------------------------------------------------------

def wide(spark, sf) -> DataFrame:
    """One row per document and label, one column per year."""
    rows = facts(spark, sf).groupBy("doc_id", "statement", "line_item").pivot(
        "period", [f"FY {y}" for y in YEARS]).agg(F.first("amount"))
    return rows.withColumn("row_no", F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("line_item")) - 1)


@query("unpivot_statement", f"""with {FACTS}
select doc_id, line_item, period, round(amount, 2) as amount, 'Amount' as metric, 'Row ' || (row_no // 10000 + 2) as source_row from facts""")
def _unpivot(spark, sf):
    rows = wide(spark, sf).drop("statement")
    df = N.wide_to_facts(rows, "line_item", "row_no", by=["doc_id"])
    return rounded(df.select("doc_id", "line_item", "period", "amount", "metric", "source_row"), 2)


@query("detect_wide_statement", f"""with {FACTS}
select doc_id, count(distinct line_item) as rows, 7::bigint as year_columns, 'line_item' as label_column,
 count(distinct line_item) as keyword_rows, count(*) as amounts,
 case when bool_or(regexp_matches(line_item, 'operating activities|investing activities|financing activities', 'i')) then 'Cash flow statement'
      when bool_or(regexp_matches(line_item, 'total assets|liabilit|equity|receivable|payable|retained earnings', 'i')) then 'Balance sheet'
      when bool_or(regexp_matches(line_item, 'revenue|sales|gross profit|operating profit|net (?:profit|income)|ebit|tax', 'i')) then 'Income statement'
      else 'Financial statement' end as statement,
 -- a year without any amount has a numeric share of 0 and rules the table out
 count(distinct line_item) >= 3 and count(*) >= 8 and count(distinct period) = 7 as is_wide from facts group by 1""")
def _detect_wide(spark, sf):
    rows = wide(spark, sf).drop("statement", "row_no")
    df = N.is_wide_statement(rows, by=["doc_id"]).drop("numeric_share")
    return longs(df, "year_columns", "keyword_rows")


@query("detect_wide_not", """
select count(*) as rows, 0::bigint as year_columns, 'p_name' as label_column, false as is_wide from part""")
def _detect_not(spark, sf):
    df = N.is_wide_statement(table(spark, sf, "part")).select("rows", "year_columns", "label_column", "is_wide")
    return longs(df, "year_columns")


@query("guess_statement", f"""with {FACTS}
select doc_id, statement as page, case when bool_or(regexp_matches(line_item, 'operating activities|investing activities|financing activities', 'i')) then 'Cash flow statement'
      when bool_or(regexp_matches(line_item, 'total assets|liabilit|equity|receivable|payable|retained earnings', 'i')) then 'Balance sheet'
      when bool_or(regexp_matches(line_item, 'revenue|sales|gross profit|operating profit|net (?:profit|income)|ebit|tax', 'i')) then 'Income statement'
      else 'Financial statement' end as statement from facts group by 1, 2""")
def _guess(spark, sf):
    rows = facts(spark, sf).select("doc_id", F.col("statement").alias("page"), "line_item")
    return N.guess_statement(rows, "line_item", by=["doc_id", "page"])


@query("to_facts", f"""with {FACTS}
select doc_id, line_item, period, round(amount, 2) as amount, 'Amount' as metric, 'Financial table' as statement from facts where y <> 1999""")
def _to_facts(spark, sf):
    """Records with gaps: no period in 1999, blank metric and statement."""
    raw = facts(spark, sf).withColumn("period", F.when(F.col("period") == "FY 1999", " ").otherwise(F.col("period")))
    raw = raw.withColumn("amount", F.format_number("amount", 2)).withColumn("metric", F.lit("")).withColumn("statement", F.lit(None).cast("string"))
    return rounded(N.to_facts(raw).select("doc_id", "line_item", "period", "amount", "metric", "statement"), 2)


@query("rank_periods", f"""with {FACTS},
c as (select doc_id, period, y, count(*) as n from facts group by 1, 2, 3),
k as (select *, n >= greatest(1, max(n) over (partition by doc_id) * 0.35) as core from c)
select doc_id, period, y::bigint as year, n as "count", core,
 row_number() over (partition by doc_id order by core desc, case when core then y end desc nulls last, n desc, y desc, period) as rank from k""")
def _rank_periods(spark, sf):
    return longs(N.rank_periods(facts(spark, sf)), "rank", "year")


@query("common_unit", """
with u as (select c_mktsegment, n_name as unit, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1, 2)
select c_mktsegment, unit, n as "count" from (
 select *, row_number() over (partition by c_mktsegment order by n desc, unit) as r from u) where r = 1""")
def _common_unit(spark, sf):
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return N.common_unit(rows.select("c_mktsegment", F.col("n_name").alias("unit")), "c_mktsegment")


_METRIC_ROWS = ", ".join(
    f"({i + 1}, {_sql_text(r.label)}, {j}, {_sql_text(p)}, {_sql_text('|'.join(r.hints))})"
    for i, r in enumerate(METRIC_RULES) for j, p in enumerate(r.patterns))
SCORED = f"""
metric_rules(no, label, place, pattern, hints) as (values {_METRIC_ROWS}),
scored as (select f.doc_id, f.line_item, f.period, f.amount, f.statement, f.unit, f.row_no, m.no, m.label,
  sum(100 - 8 * place) + max(case when regexp_matches(f.line_item, '^total\\b', 'i') then 15 else 0 end
   + case when regexp_matches(f.statement || ' ' || f.statement, m.hints, 'i') then 12 else 0 end
   - case when regexp_matches(f.line_item, 'per share|share capital|treasury shares', 'i') then 30 else 0 end) as score
 from facts f join metric_rules m on regexp_matches(f.line_item, m.pattern, 'i') group by all),
best as (select * from (select *, row_number() over (partition by doc_id, no, period order by score desc, row_no) as r from scored) where r = 1),
pc as (select doc_id, period, y, count(*) as n from facts group by 1, 2, 3),
pk as (select *, n >= greatest(1, max(n) over (partition by doc_id) * 0.35) as core from pc),
pr as (select *, row_number() over (partition by doc_id order by core desc, case when core then y end desc nulls last, n desc, y desc, period) as rank from pk)"""


@query("metric_scores", f"""with {FACTS}, {SCORED}
select doc_id, line_item, period, label, cast(score as bigint) as score from scored""")
def _metric_scores(spark, sf):
    return longs(N.metric_scores(facts(spark, sf)).select("doc_id", "line_item", "period", "label", "score"), "score")


@query("highlights", f"""with {FACTS}, {SCORED},
h as (select b.doc_id, b.label, max(case when rank = 1 then b.period end) as current_period, max(case when rank = 1 then amount end) as current_value,
  max(case when rank = 2 then b.period end) as prior_period, max(case when rank = 2 then amount end) as prior_value,
  max(case when rank = 1 then statement end) as statement, max(case when rank = 1 then unit end) as unit
 from best b join pr on pr.doc_id = b.doc_id and pr.period = b.period and rank <= 2 group by 1, 2)
select *, round(current_value - prior_value, 2) as change,
 round(case when prior_value = 0 then null else (current_value - prior_value) / abs(prior_value) * 100 end, 4) as change_pct
from h where current_value is not null""")
def _highlights(spark, sf):
    df = N.highlights(N.to_facts(facts(spark, sf))).drop("metric_no", "sheet")
    return rounded(rounded(df, 2, "change"), 4, "change_pct")


@query("analysis_checks", f"""with {FACTS}, {SCORED},
v as (select doc_id, period, min(case when line_item = 'Total assets' then amount end) as a,
  min(case when line_item = 'Total liabilities and equity' then amount end) as b,
  min(case when line_item = 'Total liabilities' then amount end) as l, min(case when line_item = 'Total equity' then amount end) as e
 from facts group by 1, 2),
d as (select pr.doc_id, pr.period, a, a - coalesce(b, l + e) as diff from pr left join v on v.doc_id = pr.doc_id and v.period = pr.period where rank = 1)
select doc_id, 'Balance sheet equation' as label, case when diff is null then 'missing' when abs(diff) <= greatest(1, abs(a) * 0.001) then 'ok'
 else 'warning' end as status, period, round(diff, 2) as difference from d
union all select doc_id, 'Primary statement coverage', case when count(distinct statement) = 3 then 'ok' else 'warning' end, null, null from facts group by 1""")
def _analysis_checks(spark, sf):
    return rounded(N.analysis_checks(facts(spark, sf)), 2)


ANALYSIS = f"""
an as (select doc_id, count(*) as n, count(distinct statement) as st, count(distinct period) as p, any_value(unit) as unit from facts group by 1
  having count(*) >= 8)"""


@query("analysis_summary", f"""with {FACTS}, {SCORED}, {ANALYSIS}
select an.doc_id, round(least(0.96, 0.38 + least(0.24, st * 0.04) + least(0.18, p * 0.06) + least(0.16, n / 500)), 6) as confidence, unit,
 (select string_agg(period, ',' order by rank) from pr where pr.doc_id = an.doc_id) as periods, st as sheet_count, n as fact_count,
 (select string_agg(distinct statement, ',' order by statement) from facts f where f.doc_id = an.doc_id) as statement_types from an""")
def _analysis_summary(spark, sf):
    df = N.analysis_summary(N.to_facts(facts(spark, sf)))
    return rounded(df.withColumn("periods", F.array_join("periods", ",")).withColumn(
        "statement_types", F.array_join("statement_types", ",")), 6)


def _fact_report(spark, sf):
    """Report parts for the facts as a table, with their analysis."""
    rows = facts(spark, sf)
    from tablescope.operators.profiling import column_stats
    from tablescope.operators.roles import infer_roles

    whole = N.to_facts(rows.withColumn("doc_id", F.lit("facts")))
    analysis = N.analysis_summary(whole).withColumnRenamed("doc_id", "dataset_id")
    table_rows = rows.select("statement", "line_item", "period", "amount", "unit")
    return plan_report(infer_roles(column_stats(table_rows, "facts")), analysis)


@query("report_of_facts", f"""with {FACTS}
select 'facts' as dataset_id, 'Financial statement report' as kind,
 round(least(0.96, 0.38 + 0.12 + least(0.18, count(distinct period) * 0.06) + least(0.16, count(*) / 500)), 6) as confidence from facts""")
def _report_kind(spark, sf):
    return rounded(_fact_report(spark, sf)["kind"].drop("rationale"), 6)


def _first_names(names: str, n: int) -> str:
    return f"array_to_string({names}[1:{n}], ', ') || case when len({names}) > {n} then ', +' || (len({names}) - {n}) || ' more' else '' end"


@query("report_of_facts_summary", f"""with {FACTS},
t as (select count(*) as n, list(distinct period) as p, list(distinct statement) as s, min(amount) < 0 as neg,
  round(100.0 * (count(statement) + count(line_item) + count(period) + count(amount) + count(unit)) / (5 * count(*)), 1) as filled from facts),
c as (select unnest(['statement', 'line_item', 'period', 'unit']) as col, unnest([0, 1, 2, 4]) as idx,
  unnest([count(statement), count(line_item), count(period), count(unit)]) as filled,
  unnest([count(distinct statement), count(distinct line_item), count(distinct period), count(distinct unit)]) as k from facts),
d as (select list(col order by case when k between 2 and 12 then 0 when k between 13 and 50 then 1 else 2 end, filled desc, idx) as dims from c)
select 'facts' as dataset_id, -2::bigint as rank, 'Statement facts: ' || format('{{:,}}', n) || ' from ' || len(s) || ' sources.' as line from t
union all select 'facts', -1, 'Periods: ' || {_first_names("list_reverse_sort(p)", 4)} || '.' from t
union all select 'facts', 0, 'Statements: ' || {_first_names("list_sort(s)", 4)} || '.' from t
union all select 'facts', 2, 'Measures: amount' || case when neg then ' (some below zero).' else '.' end from t
union all select 'facts', 3, 'Columns to group by: ' || array_to_string(dims, ', ') || '.' from d
union all select 'facts', 4, 'Of all cells, ' || {sql_percent("filled")} || ' are filled' || case when filled < 95 then '; see the warnings.' else '.' end from t""")
def _report_summary(spark, sf):
    return longs(_fact_report(spark, sf)["summary"], "rank")


# Items and documents from facts -------------------------------------------

def items(spark, sf) -> DataFrame:
    return D.items_from_facts(facts(spark, sf))


_UNSIGNED = "regexp_matches({l}, 'liabilit|equity|payable|borrowings?|debt|gjeld|egenkapital', 'i')"
ITEMS = f"""{FACTS},
{classified("select line_item as label from facts union all select statement || ' ' || line_item from facts")},
items as (select f.doc_id, k.kind || ':' || f.line_item || ':' || coalesce(c.concept, '') || ':' || f.statement as line_id, f.line_item as label,
   c.concept, c.kind as label_kind, k.kind, f.period, f.y,
   case when k.kind = 'balance_sheet' and {_UNSIGNED.format(l='f.line_item')} then abs(f.amount) else f.amount end as value, 0.82 as confidence
 from facts f join cl c on c.label = f.line_item join cl k on k.label = f.statement || ' ' || f.line_item),
members as (select i.*, unnest(list_distinct([case when label_kind in ('income_statement', 'balance_sheet', 'cash_flow') then label_kind else 'unknown' end,
   case when kind in ('income_statement', 'balance_sheet', 'cash_flow') then kind else
     case when label_kind in ('income_statement', 'balance_sheet', 'cash_flow') then label_kind else 'unknown' end end])) as statement from items i),
periods as (select distinct doc_id, period, y from items),
rp as (select *, row_number() over (partition by doc_id order by y desc) as rank from periods)"""


@query("items_from_facts", f"""with {ITEMS}
select doc_id, line_id, label, concept, kind, period, round(value, 2) as value, cast(confidence as double) as confidence from items""")
def _items(spark, sf):
    return rounded(items(spark, sf).drop("page_no"), 2)


@query("items_from_facts_sum", f"""with {FACTS}
select doc_id, line_item as label, round(sum(amount), 2) as value from facts group by 1, 2""")
def _items_sum(spark, sf):
    """All periods read as one: duplicates add up."""
    rows = facts(spark, sf).withColumn("period", F.lit("FY 2000"))
    return rounded(D.items_from_facts(rows, on_duplicate="sum").select("doc_id", "label", "value"), 2)


@query("items_last_wins", """
with t as (select *, row_number() over (partition by o_orderstatus, o_orderpriority, year(o_orderdate) order by o_orderkey desc) as r from orders)
select o_orderstatus as doc_id, o_orderpriority as label, 'FY ' || year(o_orderdate) as period, o_totalprice as value, cast(0.48 as double) as confidence
from t where r = 1""")
def _items_last(spark, sf):
    """A long table with repeated years: the last row of each year counts."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("doc_id"), "o_orderkey", F.col("o_orderpriority").alias("Account"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Posting period"), F.col("o_totalprice").alias("Balance"))
    return D.items_from_long(rows, "o_orderkey").select("doc_id", "label", "period", "value", "confidence")


@query("items_from_period_columns", f"""with {FACTS}, {classified(_LABEL_SOURCE)},
frame as (select d.doc_id, d.line_item, y.y from (select distinct doc_id, line_item from facts) d, (select unnest(range(1995, 2002)) as y) y)
select f.doc_id, f.line_item as label, 'FY ' || f.y as period, a.amount as value, cl.concept,
 cast(least(0.92, 0.5 + case when cl.kind <> 'unknown' then 0.18 else 0 end + case when cl.concept is not null then 0.16 else 0 end) as double) as confidence
from frame f join cl on cl.label = f.line_item left join facts a on a.doc_id = f.doc_id and a.line_item = f.line_item and a.y = f.y""")
def _items_columns(spark, sf):
    rows = wide(spark, sf).drop("statement").withColumnRenamed("line_item", "Line item")
    df = D.items_from_period_columns(rows, "row_no")
    return df.select("doc_id", "label", "period", F.round("value", 2).alias("value"), "concept", F.round("confidence", 6).alias("confidence"))


@query("choose_periods", f"""with {ITEMS}
select doc_id, rank, period, y::bigint as year from rp""")
def _choose_periods(spark, sf):
    return longs(D.choose_periods(items(spark, sf)), "rank", "year")


@query("statement_membership", f"""with {ITEMS}
select doc_id, line_id, period, statement from members""")
def _membership(spark, sf):
    return D.statement_membership(items(spark, sf)).select("doc_id", "line_id", "period", "statement")


SUMMARY = f"""{ITEMS},
sm as (select d.doc_id, s.statement, count(distinct m.line_id) as n from (select distinct doc_id from items) d,
   (select unnest(['income_statement', 'balance_sheet', 'cash_flow', 'unknown']) as statement) s
   left join members m on m.doc_id = d.doc_id and m.statement = s.statement group by 1, 2)"""


@query("statement_summary", f"""with {SUMMARY}
select doc_id, statement, case statement when 'income_statement' then 'Income Statement' when 'balance_sheet' then 'Balance Sheet'
 when 'cash_flow' then 'Cash Flow Statement' else 'Unclassified / Review Needed' end as title, n as row_count,
 round(case when n = 0 then 0.0 else least(0.96, 0.82 + least(0.12, n / 100)) end, 6) as confidence,
 case when n = 0 then 'No rows were confidently assigned to this statement.' end as warning from sm where n > 0 or statement <> 'unknown'""")
def _summary(spark, sf):
    return rounded(D.statement_summary(D.statement_membership(items(spark, sf))), 6)


@query("statement_periods", f"""with {SUMMARY} select distinct doc_id, statement, period from members""")
def _statement_periods(spark, sf):
    return D.statement_periods(D.statement_membership(items(spark, sf)))


@query("key_figures", f"""with {ITEMS},
b as (select * from (select doc_id, concept, line_id, label_kind, row_number() over (partition by doc_id, concept order by line_id) as r
      from (select distinct doc_id, concept, line_id, label_kind from items where concept is not null)) where r = 1)
select b.doc_id, b.concept, (select any_value(title) from rules r where r.concept = b.concept) as label, b.label_kind as kind, rp.period,
 i.value, cast(0.82 as double) as confidence,
 coalesce(list_position(['revenue', 'gross_profit', 'operating_profit', 'profit_before_tax', 'net_income', 'total_assets', 'total_equity',
  'total_liabilities', 'cash_and_cash_equivalents', 'operating_cash_flow'], b.concept), 11)::bigint as figure_order
from b join rp on rp.doc_id = b.doc_id left join items i on i.doc_id = b.doc_id and i.line_id = b.line_id and i.period = rp.period""")
def _key_figures(spark, sf):
    rows = items(spark, sf)
    df = D.key_figures(rows, D.choose_periods(rows)).drop("page_no", "period_rank")
    return longs(rounded(df, 2), "figure_order")


@query("keep_documents", f"""with {ITEMS}
select doc_id, count(distinct line_id) as row_count, count(distinct concept) as figure_count,
 count(distinct line_id) >= 4 or count(distinct concept) >= 2 as kept from items group by 1""")
def _keep(spark, sf):
    return D.keep_documents(items(spark, sf))


DOCUMENTS = f"""{SUMMARY},
docs as (select doc_id, count(distinct line_id) as n, count(distinct period) as p from items group by 1),
dq as (select *, least(0.96, 0.45 * 0.45 + least(0.3, n / 80) + least(0.25, p * 0.08)) as conf from docs)"""


@query("document_confidence", f"""with {DOCUMENTS}
select doc_id, n as row_count, p as period_count, round(conf, 6) as confidence from dq""")
def _confidence(spark, sf):
    rows = items(spark, sf)
    return rounded(D.document_confidence(rows, D.choose_periods(rows)), 6)


@query("document_warnings", f"""with {DOCUMENTS}
select doc_id, 'info' as severity, 'Scale was not confidently detected.' as message from docs""")
def _doc_warnings(spark, sf):
    rows = items(spark, sf)
    units = facts(spark, sf).select("doc_id", "row_no", F.col("unit").alias("text"))
    found = D.document_confidence(rows, D.choose_periods(rows)).join(D.currency_scale_of(units, ["row_no"]), "doc_id", "left")
    return D.document_warnings(found)


@query("balance_check", f"""with {ITEMS},
v as (select doc_id, period, max(case when concept = 'total_assets' then abs(value) end) as a,
  max(case when concept = 'total_equity_and_liabilities' then abs(value) end) as b,
  max(case when concept = 'total_equity' then abs(value) end) as e, max(case when concept = 'total_liabilities' then abs(value) end) as l from items group by 1, 2),
d as (select rp.doc_id, rp.period, a, coalesce(b, e + l) as x from rp left join v on v.doc_id = rp.doc_id and v.period = rp.period)
select doc_id, 'balance_sheet_equation' as kind, case when a is null or x is null then 'not_available'
 when abs(a - x) <= greatest(1, a * 0.01) then 'pass' else 'fail' end as status, period, a as lhs, round(x, 2) as rhs, round(a - x, 2) as diff from d""")
def _balance(spark, sf):
    rows = items(spark, sf)
    return rounded(K.balance_equation_check(rows, D.choose_periods(rows)), 2)


@query("document_checks", f"""
with eq as ({ORACLES["balance_check"]}),
ot as (with {DOCUMENTS}
 select doc_id, 'period_consistency' as kind, case when count(*) filter (where n > 0 and statement <> 'unknown') = 3 then 'pass' else 'warn' end as status from sm group by 1
 union all select doc_id, 'extraction_quality', case when conf >= 0.65 then 'pass' when conf >= 0.35 then 'warn' else 'fail' end from dq)
select doc_id, kind, status, period, lhs, rhs, diff from eq
union all select doc_id, kind, status, null, null, null, null from ot""")
def _checks(spark, sf):
    """All checks, also the balance equation of each period."""
    rows = items(spark, sf)
    periods = D.choose_periods(rows)
    summary = D.statement_summary(D.statement_membership(rows))
    found = K.document_checks(rows, periods, summary, D.document_confidence(rows, periods))
    return rounded(found.select("doc_id", "kind", "status", "period", "lhs", "rhs", "diff"), 2)


@query("document_overview", f"""with {SUMMARY}
select s.doc_id, count(*) filter (where n > 0) as statements, cast(sum(n) as bigint) as line_items,
 count(*) filter (where n = 0 and statement <> 'unknown') as statement_warnings,
 (select count(distinct line_id) from items i where i.doc_id = s.doc_id) as distinct_items from sm s group by 1""")
def _overview(spark, sf):
    members = D.statement_membership(items(spark, sf))
    return D.document_overview(members, D.statement_summary(members))


@query("statement_pivot", f"""with {ITEMS}
select doc_id, line_id, label, concept, max(case when y = 2001 then value end) as "FY 2001", max(case when y = 2000 then value end) as "FY 2000",
 max(case when y = 1999 then value end) as "FY 1999" from items group by 1, 2, 3, 4""")
def _pivot(spark, sf):
    df = D.statement_pivot(items(spark, sf), ["FY 2001", "FY 2000", "FY 1999"])
    return rounded(df.drop("confidence"), 2)


@query("dataset_raw_lines", """
select c_custkey as doc_id, c_custkey as line_no, c_name || ' | ' || c_nationkey || ' | ' || regexp_replace(cast(c_acctbal as varchar), '\\.0$', '')
 || ' | ' || c_mktsegment as text from customer""")
def _raw_lines(spark, sf):
    rows = table(spark, sf, "customer").withColumn("doc_id", F.col("c_custkey"))
    return D.dataset_raw_lines(rows, "c_custkey").select("doc_id", "line_no", "text")


@query("items_route", f"""with {ITEMS}
select doc_id, 1::bigint as route, count(*) as item_rows from items i
where (select count(distinct line_id) >= 4 or count(distinct concept) >= 2 from items j where j.doc_id = i.doc_id) group by 1""")
def _route(spark, sf):
    rows = facts(spark, sf).select(
        "doc_id", "row_no", F.col("sheet").alias("Sheet"), F.col("statement").alias("Statement"), F.col("line_item").alias("Line Item"),
        F.col("period").alias("Period"), F.col("amount").alias("Amount"))
    routed = plan.items_route(rows, "row_no")
    return longs(routed.groupBy("doc_id", "route").agg(F.count(F.lit(1)).alias("item_rows")), "route")


@query("documents_from_table", f"""with {ITEMS}
select doc_id, count(distinct line_id) as line_items, count(*) as item_rows, (select count(*) from facts f where f.doc_id = i.doc_id) as raw_lines from items i
group by 1 having count(distinct line_id) >= 4 or count(distinct concept) >= 2""")
def _documents_from_table(spark, sf):
    rows = facts(spark, sf).select(
        "doc_id", "row_no", F.col("sheet").alias("Sheet"), F.col("statement").alias("Statement"), F.col("line_item").alias("Line Item"),
        F.col("period").alias("Period"), F.col("amount").alias("Amount"))
    parts = plan.documents_from_table(rows, "row_no")
    raw = parts["raw_lines"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("raw_lines"))
    counts = parts["items"].groupBy("doc_id").agg(F.count_distinct("line_id").alias("line_items"), F.count(F.lit(1)).alias("item_rows"))
    return parts["documents"].select("doc_id").join(counts, "doc_id").join(raw, "doc_id")


@query("wide_table_analysis", f"""with {FACTS}
select count(*) as facts, count(distinct period) as periods, round(sum(amount), 2) as amount from facts""")
def _wide_table_analysis(spark, sf):
    found = plan.statement_table_facts(wide(spark, sf))
    return rounded(found.agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("period").alias("periods"), F.sum("amount").alias("amount")), 2)


# Text pages ---------------------------------------------------------------

def statement_pages(spark, sf) -> DataFrame:
    """Pages of text rendered from the facts: one statement per page."""
    years = [f"FY {y}" for y in reversed(YEARS)]
    rows = facts(spark, sf).groupBy("doc_id", "statement", "line_item").pivot("period", years).agg(F.first("amount"))
    amounts = [F.coalesce(F.format_number(F.round(F.col(f"`{y}`")), 0), F.lit("0")) for y in years]
    shown = [
        F.when(F.col("line_item").isin("Income tax expense", "Total liabilities") & (a != "0"), F.concat(F.lit("("), a, F.lit(")"))).otherwise(a)
        for a in amounts
    ]
    note = F.when(F.col("line_item") == "Trade receivables", "   9").otherwise("")
    line = F.concat(F.col("line_item"), note, F.lit("   "), F.concat_ws("   ", *shown))
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("line_item"))
    page = F.array_position(F.array(*[F.lit(x) for x in STATEMENTS]), F.col("statement")).cast("int")
    heading = F.when(F.col("page_no") == 1, "Consolidated income statement").when(
        F.col("page_no") == 2, "Statement of financial position").otherwise("Statement of cash flows")
    body = rows.groupBy("doc_id", page.alias("page_no")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("l")))).alias("lines"))  # at most 5 labels a page
    head = F.array(heading, F.lit("   ".join(str(y) for y in reversed(YEARS))))
    return body.select("doc_id", "page_no", F.array_join(F.concat(head, F.transform("lines", lambda x: x["l"])), "\n").alias("text"))


PAGE_LINES = f"""{FACTS}, {classified(_LABEL_SOURCE)},
pl as (select distinct doc_id, statement, line_item, row_no // 10000 as place from facts),
frame as (select pl.*, y.y, case statement when 'Income statement' then 'income_statement' when 'Balance sheet' then 'balance_sheet' else 'cash_flow' end as kind,
  list_position({_STATEMENT_LIST}, statement) as page_no,
  row_number() over (partition by doc_id, statement, y.y order by place) + 1 as line_no from pl, (select unnest(range(1995, 2002)) as y) y),
parsed as (select f.*, c.concept, case when a.amount is null then 0 else round(a.amount) * case when f.line_item = 'Income tax expense' then -1 else 1 end end as value,
  least(0.94, 0.38 + 0.16 + case when c.concept is null then 0 else 0.2 end + 0.14 + 0.04) as conf
 from frame f join cl c on c.label = f.line_item left join facts a on a.doc_id = f.doc_id and a.line_item = f.line_item and a.y = f.y)"""


@query("parse_lines", f"""with {PAGE_LINES}
select doc_id, page_no::bigint as page_no, kind || ':' || printf('%09d:%09d', page_no, line_no) as line_id,
 line_item || case when line_item = 'Trade receivables' then ' 9' else '' end as label, concept, kind, 'FY ' || y as period, value,
 cast(round(conf, 6) as double) as confidence from parsed""")
def _parse_lines(spark, sf):
    """Figures come back from the rendered pages; a note number stays in the label."""
    parsed = D.parse_lines(D.segment_lines(statement_pages(spark, sf)))
    return longs(rounded(D.items_from_lines(parsed), 6), "page_no")


@query("unparsed_lines", f"""with {PAGE_LINES}
select doc_id, page_no::bigint as page_no, unnest([0, 1])::bigint as line_no, unnest([true, false]) as is_heading, kind,
 unnest([0.75, 0.25])::double as confidence from (select distinct doc_id, page_no, kind from parsed)""")
def _unparsed(spark, sf):
    parsed = D.parse_lines(D.segment_lines(statement_pages(spark, sf)))
    return longs(D.unparsed_lines(parsed).select("doc_id", "page_no", "line_no", "is_heading", "kind", "confidence"), "page_no", "line_no")


@query("text_documents", f"""with {PAGE_LINES},
n as (select doc_id, count(distinct (page_no, line_no)) as n from parsed group by 1)
select doc_id, n as row_count, 7::bigint as period_count from n""")
def _text_documents(spark, sf):
    """Whole text path: pages to document."""
    built = plan.documents_from_pages(statement_pages(spark, sf))
    return built["documents"].select("doc_id", "row_count", "period_count")


_DOC_LINES = """
l as (select doc_id, line_no - 1 as line_no, line from (
  select doc_id, unnest(x) as line, generate_subscripts(x, 1) as line_no from (
    select doc_id, list_filter(string_split_regex(text, '\\r?\\n'), lambda s: not regexp_full_match(s, '[\\s\\x{a0}\\x{feff}\\x{0b}]*')) as x from documents)))"""


@query("segment_lines", f"""with {_DOC_LINES},
h as (select *, case {_HEADING.format(t="regexp_replace(line, '\\s+', ' ', 'g')")} end as k from l)
select doc_id, line_no, k is not null as is_heading,
 coalesce(last_value(k ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 'unknown') as kind from h""")
def _segment(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    return longs(D.segment_lines(pages).select("doc_id", "line_no", "is_heading", "kind"), "line_no")


@query("carry_forward_sections", """
select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (
 partition by conv_id order by turn rows unbounded preceding) as question from conversations""")
def _carry(spark, sf):
    """The latest user turn at each turn, carried over blocks of three turns."""
    rows = table(spark, sf, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("text")))
    filled = carry_forward(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 3), {"question": "asked"})
    return filled.select("conv_id", "turn", "question")


@query("carry_forward_flags", """
select l_suppkey, l_orderkey, l_linenumber, l_partkey, last_value(case when l_returnflag = 'R' then l_quantity end ignore nulls) over (
 partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows unbounded preceding) as quantity from lineitem""")
def _carry_flags(spark, sf):
    """A few busy groups: each is filled in blocks of orders."""
    rows = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    filled = carry_forward(
        rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        F.floor(F.col("l_orderkey") / 1000), {"quantity": "q"})
    return filled.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "quantity")
