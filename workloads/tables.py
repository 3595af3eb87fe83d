"""Row operators, aggregations, profiles and report plans (Q, A, P, R, F1-F5, F25-F28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.cells import canonicalize_cells
from tablescope.functions.values import parse_boolean, parse_date, parse_number
from tablescope.operators import aggregates as A, profiling as P, rows as Q
from tablescope.operators.roles import infer_roles
from tablescope.plans import report
from tablescope.sources.sheets import merge_by_name
from workloads.common import (
    TABLES,
    longs,
    rounded,
    sql_breakdown,
    sql_cross_tab,

    sql_histogram,
    sql_int,
    sql_key,
    sql_label,
    sql_missing,
    sql_percent,
    sql_series,
    sql_trim,
    table,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Aggregations -------------------------------------------------------------

def _breakdown(source, dim, measure, agg, limit):
    def run(spark, sf):
        df = A.group_breakdown(table(spark, sf, source), dim, measure, agg, limit)
        return longs(rounded(df, 2, "total"), "position")

    return run


for _name, _args in {
    "group_sum": ("orders", "o_orderpriority", "o_totalprice", "sum", 8),
    "group_mean_folded": ("part", "p_brand", "p_retailprice", "mean", 8),
    "group_count": ("part", "p_brand", None, "count", 10),
    "group_sum_flags": ("lineitem", "l_returnflag", "l_extendedprice", "sum", 8),
    "group_sum_names": ("part", "p_name", "p_retailprice", "sum", 10),
}.items():
    QUERIES[_name] = _breakdown(*_args)
    ORACLES[_name] = sql_breakdown(*_args)


def _series(source, ts, measure, agg):
    def run(spark, sf):
        return rounded(A.time_series(table(spark, sf, source), ts, measure, agg), 2).select("label", "value")

    return run


for _name, _args in {
    "series_day": ("events", "ts", "value", "sum"),
    "series_day_count": ("events", "ts", None, "count"),
    "series_year": ("orders", "o_orderdate", "o_totalprice", "mean"),
    "series_year_lines": ("lineitem", "l_shipdate", "l_extendedprice", "sum"),
}.items():
    QUERIES[_name] = _series(*_args)
    ORACLES[_name] = sql_series(*_args)


@query("series_month", """
select year(o_orderdate) // 3 as years, strftime(o_orderdate, '%Y-%m') as label, round(sum(o_totalprice), 2) as value from orders group by 1, 2""")
def _series_month(spark, sf):
    """A series of each three calendar years: shown by month."""
    orders = table(spark, sf, "orders").withColumn("years", F.floor(F.year("o_orderdate") / 3))
    return longs(rounded(A.time_series(orders, "o_orderdate", "o_totalprice", "sum", ["years"]), 2).select("years", "label", "value"), "years")


@query("series_extremes", f"""
with x as ({sql_series("orders", "o_orderdate", "o_totalprice", "sum")})
select (select label from x order by value desc, label limit 1) as peak_label, max(value) as peak,
       (select label from x order by value, label limit 1) as low_label, min(value) as low from x""")
def _series_extremes(spark, sf):
    series = A.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum")
    return rounded(A.series_extremes(series), 2)


@query("aggregate_value", """
select o_orderstatus, round(avg(o_totalprice), 2) as value from orders group by 1""")
def _aggregate_value(spark, sf):
    return rounded(A.aggregate_value(table(spark, sf, "orders"), "o_totalprice", "mean", ["o_orderstatus"]), 2)


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("measure_summary", " union all ".join(
    f"select '{m}' as measure, count({m}) as \"count\", round(sum({m}), 2) as sum, round(avg({m}), 6) as mean, "
    f"min({m}) as min, max({m}) as max from lineitem" for m in _MEASURES))
def _measure_summary(spark, sf):
    df = A.measure_summary(table(spark, sf, "lineitem"), list(_MEASURES))
    return rounded(rounded(df, 2, "sum"), 6, "mean")


def _histogram(source, column):
    def run(spark, sf):
        df = A.histogram(table(spark, sf, source), column).select("bin", "start", "end", "count")
        return longs(rounded(df, 4), "bin")

    sql = sql_histogram(source, column) + (
        "select cast(bin as bigint) as bin, round(start, 4) as start, round(stop, 4) as \"end\", n as \"count\" from e")
    return run, sql


for _name, _args in {
    "histogram": ("customer", "c_acctbal"),
    "histogram_lines": ("lineitem", "l_extendedprice"),
    "histogram_quantity": ("lineitem", "l_quantity"),
}.items():
    QUERIES[_name], ORACLES[_name] = _histogram(*_args)


@query("bin_labels", sql_histogram("orders", "o_totalprice")
       + f"select cast(bin as bigint) as bin, {sql_label('start', 'stop')} as label from e")
def _bin_labels(spark, sf):
    return longs(A.histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", "label"), "bin")


@query("distribution_filtered", sql_histogram("(select * from orders where o_orderstatus = 'F')", "o_totalprice")
       + 'select cast(bin as bigint) as bin, round(start, 4) as start, round(stop, 4) as "end", n as "count" from e')
def _distribution(spark, sf):
    """Histogram of the rows left by a filter."""
    rows = Q.apply_filters(table(spark, sf, "orders"), {"o_orderstatus": "F"})
    df = A.histogram(rows, "o_totalprice").select("bin", "start", "end", "count")
    return longs(rounded(df, 4), "bin")


@query("histogram_by_status", """
with v as (select o_orderstatus as k, o_totalprice as x from orders),
s as (select k, min(x) as lo, max(x) as hi, least(12, cast(ceil(sqrt(count(*))) as int)) as b from v group by k),
f as (select k, unnest(range(b)) as bin from s),
n as (select v.k, cast(greatest(0, least(b - 1, cast(floor((x - lo) / ((hi - lo) / b)) as bigint))) as bigint) as bin, count(*) as n
      from v join s on s.k = v.k group by 1, 2)
select f.k as o_orderstatus, cast(f.bin as bigint) as bin, coalesce(n, 0) as "count" from f left join n on n.k = f.k and n.bin = f.bin""")
def _histogram_by(spark, sf):
    df = A.histogram(table(spark, sf, "orders"), "o_totalprice", by=["o_orderstatus"])
    return longs(df.select("o_orderstatus", "bin", "count"), "bin")


@query("top_keys", f"""
with g as (select {sql_key('p_brand')} as key, count(*) as c from part group by 1),
r as (select *, row_number() over (order by c desc, key) as p, count(*) over () as k from g)
select p as position, key, c as "count", k - 6 as truncated from r where p <= 6""")
def _top_keys(spark, sf):
    return longs(A.top_keys(table(spark, sf, "part"), "p_brand"), "position", "truncated")


def _cross(source, row, col, measure, agg):
    def run(spark, sf):
        df = A.cross_tab(table(spark, sf, source), row, col, measure, agg)
        return longs(rounded(df, 2, "value"), "row_position", "col_position")

    sql = sql_cross_tab(source, row, col, measure, agg, 6)
    return run, sql + "select row_key, col_key, row_position, col_position, round(value, 2) as value from ct_out"


for _name, _args in {
    "crosstab_count": ("orders", "o_orderstatus", "o_orderpriority", None, "count"),
    "crosstab_sum": ("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "sum"),
    "crosstab_mean": ("part", "p_brand", "p_type", "p_retailprice", "mean"),
}.items():
    QUERIES[_name], ORACLES[_name] = _cross(*_args)


@query("crosstab_totals", sql_cross_tab("part", "p_brand", "p_type", "p_retailprice", "mean", 6) + """
select row_key, null as col_key, 'row' as kind, round(sum(value), 2) as total from ct_out group by 1
union all select null, col_key, 'column', round(sum(value), 2) from ct_out group by 2
union all select null, null, 'grand', round(sum(value), 2) from ct_out""")
def _crosstab_totals(spark, sf):
    cells = A.cross_tab(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice", "mean")
    return rounded(A.cross_tab_totals(cells), 2)


@query("crosstab_by_market", """
with t as (select c_mktsegment as m, n_name as rk, cast(n_regionkey as varchar) as ck
           from customer join nation on c_nationkey = n_nationkey),
rt as (select m, rk, row_number() over (partition by m order by count(*) desc, rk) as rp from t group by 1, 2),
ct as (select m, ck, row_number() over (partition by m order by count(*) desc, ck) as cp from t group by 1, 2),
c as (select m, rk, ck, count(*) as c from t group by 1, 2, 3)
select rt.m as c_mktsegment, rt.rk as row_key, ct.ck as col_key, cast(coalesce(c.c, 0) as double) as value
from rt join ct on rt.m = ct.m and rp <= 6 and cp <= 6
left join c on c.m = rt.m and c.rk = rt.rk and c.ck = ct.ck""")
def _crosstab_by(spark, sf):
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = A.cross_tab(rows, "n_name", "n_regionkey", by=["c_mktsegment"])
    return df.select("c_mktsegment", "row_key", "col_key", "value")


@query("crosstab_peak", sql_cross_tab("orders", "o_orderstatus", "o_orderpriority", "o_totalprice", "sum", 6)
       + "select round(greatest(max(value), 0.0), 2) as peak from ct_out")
def _crosstab_peak(spark, sf):
    cells = A.cross_tab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "sum")
    return rounded(A.cross_tab_peak(cells), 2)


@query("relative_to_peak", f"""
with g as ({sql_breakdown('customer', 'c_mktsegment', 'c_acctbal', 'sum', 8)})
select value, round(abs(total) / greatest(max(abs(total)) over (), 1), 6) as share from g""")
def _relative(spark, sf):
    groups = A.group_breakdown(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "sum")
    return rounded(A.relative_to_peak(groups).select("value", "share"), 6)


@query("group_by_market", f"""
with g as (select c_mktsegment as m, n_name as k, sum(c_acctbal) as s, count(*) as c
           from customer join nation on c_nationkey = n_nationkey group by 1, 2),
r as (select *, row_number() over (partition by m order by s desc, k) as p from g)
select m as c_mktsegment,
       case when least(p, 6) <= 5 then max(k) else '+ ' || count(*) || ' more' end as value,
       round(sum(s), 2) as total, cast(sum(c) as bigint) as "count" from r group by m, least(p, 6)""")
def _group_by_market(spark, sf):
    """Breakdown per key: one job for several tables or segments."""
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = A.group_breakdown(rows, "n_name", "c_acctbal", "sum", 5, by=["c_mktsegment"])
    return rounded(df, 2).select("c_mktsegment", "value", "total", "count")


# Row operators ------------------------------------------------------------

@query("apply_filters", "select * from part where p_brand = 'Brand#2' and p_type = 'SMALL'")
def _filters(spark, sf):
    return Q.apply_filters(table(spark, sf, "part"), {"p_brand": "Brand#2", "p_type": "SMALL"})


@query("filter_empty", """
select d.doc_id, d.lang from documents d left join labels l on l.doc_id = d.doc_id where l.quality is null""")
def _filter_empty(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_id")
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(
        labels, F.col("doc_id") == F.col("label_id"), "left")
    return Q.apply_filters(rows, {"quality": "(empty)"}).select("doc_id", "lang")


@query("drill_down", "select * from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def _drill(spark, sf):
    chosen = Q.drill_down({"o_orderstatus": "O"}, ("o_orderstatus", "F"), ("o_orderpriority", "5-LOW"))
    return Q.apply_filters(table(spark, sf, "orders"), chosen)


@query("search_rows", """
select * from part where contains(lower(cast(p_partkey as varchar)), 'ring') or contains(lower(p_name), 'ring')
 or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring')""")
def _search(spark, sf):
    return Q.search_rows(table(spark, sf, "part"), "RING")


def _sort_page(page, size):
    sql = f"""
select p_partkey, p_name, p_brand, row_number from (
 select *, row_number() over (order by lower(regexp_extract(p_brand, '^[^0-9]*')) desc,
   cast(regexp_extract(p_brand, '[0-9]+') as int) desc, p_partkey) as row_number from part)
where row_number > {page * size} and row_number <= {page * size + size}"""

    def run(spark, sf):
        part = table(spark, sf, "part")
        order = [*Q.sort_order(part, "p_brand", desc=True), F.col("p_partkey").asc()]
        return Q.page_rows(part, page, size, order).select("p_partkey", "p_name", "p_brand", "row_number")

    return run, sql


QUERIES["sort_page_first"], ORACLES["sort_page_first"] = _sort_page(0, 25)
QUERIES["sort_page_third"], ORACLES["sort_page_third"] = _sort_page(2, 50)


_LOTS = "select *, case when c_custkey % 11 = 0 then ' n/a ' else 'lot ' || repeat('7', cast(c_custkey % 30 as int)) || c_custkey end as lot from customer"


def _lots(spark, sf):
    """Customers with a text that ends in a number of up to 34 digits, or is missing."""
    digits = F.concat(F.lit("lot "), F.expr("repeat('7', cast(c_custkey % 30 as int))"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").withColumn("lot", F.when(F.col("c_custkey") % 11 == 0, " n/a ").otherwise(digits))


@query("sort_rows", f"""select c_custkey, lot, row_number() over (order by lot = ' n/a ', length(lot) desc, lot desc, c_custkey) as row_number from ({_LOTS})""")
def _sort_rows(spark, sf):
    """All rows numbered in natural order, from the largest number down, missing cells last."""
    rows = _lots(spark, sf)
    order = [*Q.sort_order(rows, "lot", desc=True), F.col("c_custkey").asc()]
    return Q.numbered_rows(rows, order).select("c_custkey", "lot", "row_number")


@query("sort_dates", """select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as row_number from orders""")
def _sort_dates(spark, sf):
    orders = table(spark, sf, "orders")
    order = [*Q.sort_order(orders, "o_orderdate", desc=True), F.col("o_orderkey").asc()]
    return Q.numbered_rows(orders, order).select("o_orderkey", "row_number")


@query("page_deep", """
select l_orderkey, l_linenumber, row_number from (
 select *, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) as row_number, count(*) over () as n from lineitem)
where row_number > (n // 200) * 100 and row_number <= (n // 200 + 1) * 100""")
def _page_deep(spark, sf):
    """A page in the middle of the table."""
    lines = table(spark, sf, "lineitem")
    order = [*Q.sort_order(lines, "l_extendedprice"), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    return Q.page_rows(lines, lines.count() // 200, 100, order).select("l_orderkey", "l_linenumber", "row_number")


@query("filter_typed", "select o_orderkey, o_custkey from orders where o_custkey = 42")
def _filter_typed(spark, sf):
    return Q.apply_filters(table(spark, sf, "orders"), {"o_custkey": "42"}).select("o_orderkey", "o_custkey")


@query("exact_cells", """
select o_orderkey, case when o_custkey % 3 = 0 then '' || o_orderkey else o_orderkey || '.00000000000000000' || (o_custkey % 3) end as amount,
 case when o_custkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.00000' || (o_custkey % 3) end as moment
from orders""")
def _exact_cells(spark, sf):
    """Decimals that differ in their last digit and times that differ by a microsecond stay apart."""
    rest = (F.col("o_custkey") % 3).cast("int")
    amount = (F.col("o_orderkey").cast("decimal(19,0)") + rest.cast("decimal(1,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)")).cast("decimal(38,18)")
    moment = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + rest)
    return canonicalize_cells(table(spark, sf, "orders").select(amount.alias("amount"), moment.alias("moment"), "o_orderkey")).withColumn(
        "o_orderkey", F.col("o_orderkey").cast("long"))


@query("page_clamped", """
select s_suppkey, s_name, row_number from (
 select *, row_number() over (order by s_acctbal, s_suppkey) as row_number, count(*) over () as n from supplier)
where row_number > (cast(ceil(n / 25.0) as bigint) - 1) * 25""")
def _page_clamped(spark, sf):
    """A page far beyond the end shows the last one."""
    supplier = table(spark, sf, "supplier")
    order = [*Q.sort_order(supplier, "s_acctbal"), F.col("s_suppkey").asc()]
    return Q.page_rows(supplier, 1_000_000, 25, order).select("s_suppkey", "s_name", "row_number")


@query("filtered_counts", "select count(*) filter (where l_returnflag = 'R') as filtered, count(*) as total from lineitem")
def _filtered_counts(spark, sf):
    return Q.filtered_counts(table(spark, sf, "lineitem"), {"l_returnflag": "R"})


@query("merge_tables_by_name", """
select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def _merge(spark, sf):
    customer = table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    supplier = table(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")
    return merge_by_name(customer, supplier)


# Value parsing ------------------------------------------------------------

@query("parse_number_cases", """
select l_orderkey, l_linenumber, cast(case when l_linenumber in (1, 5) then -l_extendedprice
       else l_extendedprice end as double) as parsed from lineitem""")
def _parse_number(spark, sf):
    """Prices written in several notations are read back."""
    x, n = F.col("l_extendedprice"), F.col("l_linenumber")
    grouped = F.format_number(x, 2)
    plain = F.format_string("%.2f", x)
    text = (
        F.when(n == 1, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(n == 2, F.concat(F.lit("$"), grouped))
        .when(n == 3, F.concat(F.lit("  € "), plain, F.lit(" ")))
        .when(n == 4, F.translate(grouped, ",", " "))
        .when(n == 5, F.concat(F.lit("- "), grouped))
        .when(n == 6, F.concat(F.format_string("%.0f", x * 100), F.lit("e-2")))
        .otherwise(plain)
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return rounded(rows.select("l_orderkey", "l_linenumber", parse_number(F.col("t")).alias("parsed")), 2)


@query("parse_rejects", """
select o_orderkey, cast(null as double) as number, cast(null as boolean) as flag from orders where o_orderstatus <> 'P'
union all select o_orderkey, null, o_orderkey % 2 = 0 from orders where o_orderstatus = 'P'""")
def _parse_rejects(spark, sf):
    """Texts that are no numbers stay null; yes and no are booleans."""
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "P", F.when(F.col("o_orderkey") % 2 == 0, " Yes ").otherwise("FALSE"))
        .when(status == "F", F.concat(F.lit("12,34"), F.col("o_orderpriority")))
        .otherwise(F.concat(F.lit("-("), F.col("o_orderkey").cast("string"), F.lit(")")))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", parse_number(F.col("t")).alias("number"), parse_boolean(F.col("t")).alias("flag"))


@query("parse_date_cases", """
select o_orderkey, strftime(case when o_orderkey % 6 = 5 then date_trunc('month', o_orderdate) else o_orderdate end,
       '%Y-%m-%d %H:%M:%S') as parsed from orders""")
def _parse_date(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy"))
        .when(k == 2, F.date_format(d, "MM/dd/yy")).when(k == 3, F.date_format(d, "M-d-yyyy"))
        .when(k == 4, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(d, "yyyy/M"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.date_format(parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# Profiles -----------------------------------------------------------------

COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n "
                "l_tax:n l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:n props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n embedding:a label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}


def sql_cells(name: str, source: str | None = None) -> str:
    """Filled and empty cells of a table as rows ``ds, col, idx, t, x, d``."""
    parts = []
    for i, spec in enumerate(COLUMNS[name].split()):
        col, kind = spec.split(":")
        if kind == "n":
            text = f"regexp_replace(cast({col} as varchar), '\\.0$', '')"
            parts.append(f"select '{name}' as ds, '{col}' as col, {i} as idx, {text} as t, "
                         f"cast({col} as double) as x, null::timestamp as d from {source or name}")
        elif kind == "t":
            text = (f"case when {col} = date_trunc('day', {col}) then strftime({col}, '%Y-%m-%d') "
                    f"else regexp_replace(strftime({col}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') end")
            parts.append(f"select '{name}', '{col}', {i}, {text}, null, {col} from {source or name}")
        elif kind == "a":
            parts.append(f"select '{name}', '{col}', {i}, cast({col} as varchar), null, null from {source or name}")
        else:
            number = (f"case when regexp_full_match({sql_trim(col)}, '[-+]?[0-9]+(\\.[0-9]+)?') "
                      f"then try_cast({sql_trim(col)} as double) end")
            parts.append(f"select '{name}', '{col}', {i}, case when {sql_missing(col)} then null else {sql_trim(col)} end, "
                         f"{number}, null from {source or name}")
    return " union all ".join(parts)


def sql_stats(cells: str) -> str:
    return f"""
cells as ({cells}),
g as (select ds, col, idx, count(*) as total, count(t) as filled, count(distinct t) as uniq, count(x) as nums,
             count(*) filter (where x = floor(x)) as wholes, count(d) as dates, coalesce(avg(length(t)), 0.0) as avg_len,
             min(x) as lo, max(x) as hi, avg(x) as mean, stddev_pop(x) as sd, median(x) as med, min(d) as d0, max(d) as d1
      from cells group by 1, 2, 3),
st as (select *, case when filled = 0 then 'string' when nums / filled >= 0.95 and wholes = nums then 'integer'
             when nums / filled >= 0.95 then 'number' when dates / filled >= 0.95 then 'date' else 'string' end as kind
      from g)"""


def _stats_sql(name: str) -> str:
    return f"""with {sql_stats(sql_cells(name))}
select col as "column", idx::bigint as column_index, kind as inferred_type, total, filled, total - filled as missing,
 round(case when total = 0 then 0.0 else (total - filled) / total * 100 end, 6) as missing_pct, uniq as unique_count,
 round(avg_len, 6) as avg_length,
 case when kind in ('integer', 'number') then round(lo, 4) end as min,
 case when kind in ('integer', 'number') then round(hi, 4) end as max,
 case when kind in ('integer', 'number') then round(mean, 4) end as mean,
 case when kind = 'date' then strftime(d0, '%Y-%m-%d') end as first_date,
 case when kind = 'date' then strftime(d1, '%Y-%m-%d') end as last_date from st"""


def _stats(name, as_text=False):
    def run(spark, sf):
        df = table(spark, sf, name)
        df = P.column_stats(canonicalize_cells(df) if as_text else df)
        return longs(rounded(rounded(df, 6, "missing_pct", "avg_length"), 4, "min", "max", "mean"), "column_index")

    return run


for _name in ("customer", "lineitem", "events", "documents"):
    QUERIES[f"column_stats_{_name}"] = _stats(_name)
    ORACLES[f"column_stats_{_name}"] = _stats_sql(_name)
# The same table as text: every cell is parsed.
QUERIES["column_stats_orders_text"] = _stats("orders", as_text=True)
ORACLES["column_stats_orders_text"] = _stats_sql("orders")


@query("profile_columns", f"""with {sql_stats(sql_cells("customer"))},
h as (select col, idx, x, min(x) over (partition by col) as lo, max(x) over (partition by col) as hi,
             least(12, cast(ceil(sqrt(count(*) over (partition by col))) as int)) as b from cells where x is not null),
hb as (select col, greatest(0, least(b - 1, cast(floor((x - lo) / ((hi - lo) / b)) as bigint))) as bin, max(b) as b, count(*) as n
       from h group by 1, 2),
hs as (select col, unnest(range(max(b))) as bin from hb group by 1),
hist as (select hs.col, string_agg(coalesce(n, 0), ',' order by hs.bin) as counts
         from hs left join hb on hb.col = hs.col and hb.bin = hs.bin group by 1),
v as (select col, t, count(*) as n from cells where t is not null and x is null group by 1, 2),
r as (select *, row_number() over (partition by col order by n desc, t) as p from v),
f as (select col, least(p, 9) as p, case when least(p, 9) <= 8 then max(t) else '+ ' || count(*) || ' more' end as t,
             sum(n) as n from r group by col, least(p, 9)),
tops as (select col, string_agg(t || '=' || cast(n as bigint), ',' order by p) as tops from f group by 1)
select st.col as "column", kind as inferred_type, uniq as unique_count,
 round(case when kind in ('integer', 'number') then med end, 4) as median,
 round(case when kind in ('integer', 'number') then sd end, 4) as std_dev, counts as histogram,
 tops as top_values from st left join hist on hist.col = st.col left join tops on tops.col = st.col""")
def _profile(spark, sf):
    df = P.profile(table(spark, sf, "customer"))
    bins = F.array_join(F.transform("histogram", lambda b: b["count"].cast("string")), ",")
    tops = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string"))), ",")
    rows = df.select("column", "inferred_type", "unique_count", "median", "std_dev",
                     bins.alias("histogram"), tops.alias("top_values"))
    return rounded(rows, 4)


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")


@query("numeric_stats", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as n, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
    f"round(avg({c}), 4) as mean, round(cast(median({c}) as double), 4) as median, round(stddev_pop({c}), 4) as std_dev "
    "from lineitem" for c in _NUMERIC))
def _numeric_stats(spark, sf):
    return rounded(P.numeric_stats(table(spark, sf, "lineitem"), list(_NUMERIC)), 4, "mean", "median", "std_dev")


@query("numeric_stats_by_flag", """
select l_returnflag, 'l_extendedprice' as "column", count(*) as n, round(median(l_extendedprice), 4) as median
from lineitem group by 1""")
def _numeric_stats_by(spark, sf):
    df = P.numeric_stats(table(spark, sf, "lineitem"), ["l_extendedprice"], by=["l_returnflag"])
    return rounded(df.select("l_returnflag", "column", "n", "median"), 4)


@query("infer_types", f"""with {sql_stats(sql_cells("lineitem"))}
select col as "column", kind as inferred_type from st""")
def _infer_types(spark, sf):
    return P.infer_types(canonicalize_cells(table(spark, sf, "lineitem")))


@query("top_values", f"""
with v as (select 'p_brand' as col, p_brand as t from part union all select 'p_type', p_type from part
           union all select 'p_name', p_name from part),
c as (select col, t, count(*) as n from v group by 1, 2),
r as (select *, row_number() over (partition by col order by n desc, t) as p from c)
select col as "column", cast(least(p, 9) as bigint) as rank,
 case when least(p, 9) <= 8 then max(t) else '+ ' || count(*) || ' more' end as value, cast(sum(n) as bigint) as "count"
from r group by col, least(p, 9)""")
def _top_values(spark, sf):
    return longs(P.top_values(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"]), "rank")


_LABELLED = "(select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id)"


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_id")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")


@query("completeness_map", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as filled, count(*) - count({c}) as missing, "
    f"round(count({c}) / count(*) * 100, 6) as pct from {_LABELLED}" for c in ("doc_id", "lang", "quality", "toxic")))
def _completeness(spark, sf):
    return rounded(P.completeness(_labelled(spark, sf)), 6)


@query("dataset_completeness", f"""
select round((count(doc_id) + count(lang) + count(quality) + count(toxic)) / (count(*) * 4) * 100, 6) as completeness
from {_LABELLED}""")
def _dataset_completeness(spark, sf):
    return rounded(P.dataset_completeness(P.column_stats(_labelled(spark, sf))), 6)


@query("type_counts", f"""with {sql_stats(sql_cells("orders"))}
select kind as inferred_type, count(*) as columns from st group by 1""")
def _type_counts(spark, sf):
    return P.type_counts(P.column_stats(table(spark, sf, "orders")))


@query("approx_profile", """
select 'l_quantity' as "column", count(l_quantity) as filled, true as near from lineitem
union all select 'l_extendedprice', count(l_extendedprice), true from lineitem
union all select 'l_returnflag', count(l_returnflag), true from lineitem""")
def _approx(spark, sf):
    """Estimated distinct counts lie within a tenth of the exact ones; the other columns are exact."""
    names = ["l_quantity", "l_extendedprice", "l_returnflag"]
    lines = table(spark, sf, "lineitem").select(*names)
    stats = P.column_stats(lines, exact=False).select("column", "filled", "unique_count")
    exact = lines.agg(*[F.count_distinct(n).alias(n) for n in names]).unpivot([], names, "column", "exact")
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.1 * F.col("exact")
    return stats.join(exact, "column").select("column", "filled", near.alias("near"))


@query("canonical_cells", """
select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
 regexp_replace(cast(o_totalprice as varchar), '\\.0$', '') as o_totalprice,
 strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders""")
def _canonical(spark, sf):
    return canonicalize_cells(table(spark, sf, "orders"))


# Roles and reports --------------------------------------------------------

_REPORT_TABLES = TABLES


def _roles(spark, sf):
    return report.roles_of_tables({t: table(spark, sf, t) for t in _REPORT_TABLES})


SQL_ROLES = f"""{sql_stats(" union all ".join(sql_cells(t) for t in _REPORT_TABLES))},
cd as (select *, case when filled = 0 then 0.0 else uniq / filled end as ratio,
        regexp_matches(col, '(^|[_\\s-])(id|ids|uuid|guid|key|code|ref|no|num|number|hash|sku|isbn|ean)([_\\s-]|$)', 'i') as idn,
        kind in ('integer', 'number') and lo < 0 as neg from st),
cb as (select *, case when uniq <= 1 then 'constant' when ratio >= 0.98 then 'unique' when uniq <= 12 then 'low'
        when uniq <= 50 then 'medium' else 'high' end as card from cd),
rl as (select *, case when kind = 'date' then 'temporal'
        when kind = 'integer' and idn then case when card = 'unique' then 'identifier' else 'categorical' end
        when kind in ('integer', 'number') then 'measure' when idn and ratio >= 0.5 then 'identifier'
        when card in ('unique', 'high') or avg_len > 40 then 'text' else 'categorical' end as role from cb),
ro as (select *, case role when 'temporal' then card in ('low', 'medium') when 'measure' then card = 'low'
        when 'categorical' then card <> 'constant' else false end as groupable,
        case when role = 'temporal' then 0.9 when role in ('measure') then 0.8 when role = 'text' then 0.6
        when role = 'identifier' then case when card = 'unique' then 0.8 else 0.55 end
        when kind = 'integer' then 0.6 else 0.8 end as conf from rl)"""

SQL_OVERVIEW = SQL_ROLES + """,
mr as (select *, row_number() over (partition by ds order by filled * (0.5 + uniq / greatest(1, filled)) desc, idx) as rk
       from ro where role = 'measure'),
dr as (select *, row_number() over (partition by ds order by case card when 'low' then 0 when 'medium' then 1 else 2 end,
       filled desc, idx) as rk from ro where role = 'categorical' and groupable),
tr as (select *, date_diff('day', d0::date, d1::date) as span,
       row_number() over (partition by ds order by date_diff('day', d0::date, d1::date) desc, filled desc, idx) as rk
       from ro where role = 'temporal'),
ov as (select ds, max(total) as n_rows, count(*) as n_cols, sum(total - filled) as miss,
        (sum(total) - sum(total - filled)) / sum(total) * 100 as comp,
        coalesce(bool_or(role = 'measure' and neg), false) as neg,
        (select list(col order by rk) from mr where mr.ds = ro.ds) as ms,
        (select list(col order by rk) from dr where dr.ds = ro.ds) as dm,
        (select list(col order by idx) from ro r2 where r2.ds = ro.ds and r2.role = 'identifier') as ids,
        (select list(col order by idx) from ro r2 where r2.ds = ro.ds and r2.role = 'text') as txt,
        (select max(col) from tr where tr.ds = ro.ds and rk = 1) as tcol,
        (select max(span) from tr where tr.ds = ro.ds and rk = 1) as tspan,
        (select max(strftime(d0, '%Y-%m-%d')) from tr where tr.ds = ro.ds and rk = 1) as t0,
        (select max(strftime(d1, '%Y-%m-%d')) from tr where tr.ds = ro.ds and rk = 1) as t1
       from ro group by ds)"""


@query("roles", f"""with {SQL_ROLES}
select ds as dataset_id, col as "column", kind as inferred_type, card as cardinality, role, groupable,
 coalesce(neg, false) as has_negatives, cast(conf as double) as confidence, round(ratio, 6) as unique_ratio from ro""")
def _roles_query(spark, sf):
    df = _roles(spark, sf).select("dataset_id", "column", "inferred_type", "cardinality", "role", "groupable",
                                  "has_negatives", "confidence", "unique_ratio")
    return rounded(df, 6, "unique_ratio")


@query("role_reasons", f"""with {SQL_ROLES}
select ds as dataset_id, col as "column", case when kind = 'date' then 'values read as dates'
 when kind = 'integer' and idn and card = 'unique' then 'whole numbers, hardly repeated; named like an identifier'
 when kind = 'integer' and idn then 'whole numbers that repeat; named like an identifier'
 when role = 'measure' then case when neg then 'amounts, some below zero' else 'amounts' end
 when role = 'identifier' then 'named like an identifier, many values'
 when role = 'text' then case when avg_len > 40 then 'long texts' else 'too many values to group' end
 else uniq || ' values to group by' end as reasons from ro""")
def _reasons(spark, sf):
    """Every column of every report table."""
    return _roles(spark, sf).select("dataset_id", "column", F.array_join("reasons", "; ").alias("reasons"))


@query("rank_measures", f"""with {SQL_OVERVIEW}
select ds as dataset_id, rk as rank, col as "column" from mr""")
def _rank_measures(spark, sf):
    return longs(report.rank_measures(_roles(spark, sf)).drop("score"), "rank")


@query("rank_dimensions", f"""with {SQL_OVERVIEW}
select ds as dataset_id, rk as rank, col as "column", card as cardinality from dr""")
def _rank_dimensions(spark, sf):
    return longs(report.rank_dimensions(_roles(spark, sf)), "rank")


@query("primary_time", f"""with {SQL_OVERVIEW}
select ds as dataset_id, col as "column", span::bigint as span_days, strftime(d0, '%Y-%m-%d') as first_date,
 strftime(d1, '%Y-%m-%d') as last_date from tr where rk = 1""")
def _primary_time(spark, sf):
    return longs(report.primary_time(_roles(spark, sf)), "span_days")


@query("suggest_views", f"""with {SQL_OVERVIEW},
v as (select ds, 1 as o, 'keyMeasures' as kind, 'Key measures' as title, null as time_column, null as dimension,
        null as col_dimension, null as measure, null as aggregate, array_to_string(ms, ',') as measures from ov where ms is not null
 union all select ds, 2, 'timeTrend', 'Trend over ' || tcol, tcol, null, null, ms[1], case when ms is null then 'count' else 'sum' end, null from ov where tcol is not null
 union all select ds, 3, 'categoryBreakdown', 'Breakdown by ' || dm[1], null, dm[1], null, null, 'count', null from ov where dm is not null
 union all select ds, 4, 'distribution', 'Distribution of ' || ms[1], null, null, null, ms[1], null, null from ov where ms is not null
 union all select ds, 5, 'crossTab', dm[1] || ' × ' || dm[2], null, dm[1], dm[2], null, 'count', null from ov where len(dm) >= 2
 union all select ds, 6, 'completeness', 'Completeness map', null, null, null, null, null, null from ov where miss > 0
 union all select ds, 7, 'detailTable', 'Detail table', null, null, null, null, null, null from ov)
select ds as dataset_id, row_number() over (partition by ds order by o) as rank, kind, title, time_column, dimension,
 col_dimension, measure, aggregate, measures from v""")
def _views(spark, sf):
    views = report.suggest_views(report.overview(_roles(spark, sf)))
    return longs(views.withColumn("measures", F.array_join("measures", ",")).drop("description"), "rank")


def _listed(names: str, n: int) -> str:
    more = f"case when len({names}) > {n} then ', +' || (len({names}) - {n}) || ' more' else '' end"
    return f"array_to_string({names}[1:{n}], ', ') || {more}"


def _counted(names: str, word: str) -> str:
    return f"len({names}) || ' {word}' || case when len({names}) = 1 then '' else 's' end"


@query("findings", f"""with {SQL_OVERVIEW},
f as (select ds, 1 as o, 'time' as tone, 'Time axis' as label, tcol as detail from ov where tcol is not null
 union all select ds, 2, 'measure', {_counted('ms', 'measure')}, {_listed('ms', 4)} from ov where ms is not null
 union all select ds, 3, 'dimension', {_counted('dm', 'dimension')}, {_listed('dm', 4)} from ov where dm is not null
 union all select ds, 4, 'identifier', {_counted('ids', 'identifier')}, {_listed('ids', 3)} from ov where ids is not null
 union all select ds, 5, 'text', {_counted('txt', 'text field')}, {_listed('txt', 3)} from ov where txt is not null
 union all select ds, 6, 'quality', 'Completeness', {sql_percent('comp')} from ov)
select ds as dataset_id, row_number() over (partition by ds order by o) as rank, tone, label, detail from f""")
def _findings(spark, sf):
    return longs(report.findings(report.overview(_roles(spark, sf))), "rank")


def _sentence(names: str) -> str:
    return (f"array_to_string({names}[1:5], ', ') || case when len({names}) > 5 then ', +' || (len({names}) - 5) || ' more' "
            "else '' end")


@query("summary_lines", f"""with {SQL_OVERVIEW},
l as (select ds, 1 as o, 'The table has ' || {sql_int('n_rows')} || ' record' || case when n_rows = 1 then '' else 's' end
  || ' with ' || {sql_int('n_cols')} || ' field' || case when n_cols = 1 then '' else 's' end || '.' as line from ov
 union all select ds, 2, 'Its time column is “' || tcol || '”, from ' || t0 || ' to ' || t1 || ' ('
  || case when tspan = 0 then 'a single point in time' when tspan < 45 then 'about ' || tspan || ' days'
          when tspan < 730 then 'about ' || cast(floor(tspan / 30 + 0.5) as bigint) || ' months'
          else 'about ' || format('{{:.1f}}', round(tspan / 365, 1)) || ' years' end || ').' from ov where t0 is not null
 union all select ds, 3, 'Measures: ' || {_sentence('ms')}
  || case when neg then ' (some below zero).' else '.' end from ov where ms is not null
 union all select ds, 4, 'Columns to group by: ' || {_sentence('dm')} || '.' from ov where dm is not null
 union all select ds, 5, '“' || ids[1] || '” identifies the records.' from ov where ids is not null
 union all select ds, 6, 'Of all cells, ' || {sql_percent('comp')} || ' are filled'
  || case when comp < 95 then '; see the warnings.' else '.' end from ov)
select ds as dataset_id, row_number() over (partition by ds order by o) as rank, line from l""")
def _summary(spark, sf):
    return longs(report.summary_lines(report.overview(_roles(spark, sf))), "rank")


@query("quality_warnings", f"""with {SQL_ROLES},
w as (select ds, 'missing' as warning, col, '“' || col || '” is ' || {sql_percent('(total - filled) / total * 100')}
  || ' empty (' || {sql_int('total - filled')} || ' of ' || {sql_int('total')} || ' rows).' as message
  from ro where (total - filled) / total * 100 >= 20
 union all select ds, 'constant', col, '“' || col || '” has one value in all rows.'
  from ro where card = 'constant'
 union all select ds, 'no measure', null, 'There is no measure to add up.'
  from ro group by ds having not bool_or(role = 'measure')
 union all select ds, 'no time', null, 'There is no time column for trends.'
  from ro group by ds having not bool_or(role = 'temporal'))
select ds as dataset_id, warning, col as "column", message from w""")
def _warnings(spark, sf):
    return report.quality_warnings(_roles(spark, sf))


@query("quality_warnings_gaps", f"""
with s as (select count(*) as n, count(*) - count(quality) as q, count(*) - count(toxic) as t from {_LABELLED})
select 'labelled' as dataset_id, 'missing' as warning, c as "column",
 '“' || c || '” is ' || {sql_percent('m / n * 100')} || ' empty (' || {sql_int('m')} || ' of ' || {sql_int('n')} || ' rows).' as message
from (select n, unnest(['quality', 'toxic']) as c, unnest([q, t]) as m from s) where m / n >= 0.2
union all select 'labelled', 'no time', null, 'There is no time column for trends.'""")
def _warnings_gaps(spark, sf):
    return report.quality_warnings(infer_roles(P.column_stats(_labelled(spark, sf), "labelled")))


@query("kind_guess", f"""with {SQL_OVERVIEW},
k as (select ds, tcol is not null as t, coalesce(len(ms), 0) as m, coalesce(len(dm), 0) as d, coalesce(len(ids), 0) as i, neg from ov)
select ds as dataset_id, case when t and i > 0 and m > 0 then 'Time-stamped event log'
 when t and m > 0 then 'Time series / periodic measurements' when m >= 2 and d >= 1 and neg then 'Balance-style financial summary'
 when d >= 2 and m >= 1 then 'Categorical results / breakdown table' when m >= 2 then 'Numeric measurement table'
 when i > 0 then 'Record register / list' else 'General tabular report' end as kind,
 cast(case when t and i > 0 and m > 0 then 0.45 when t and m > 0 then 0.4 when m >= 2 and d >= 1 and neg then 0.35
 when d >= 2 and m >= 1 then 0.35 when m >= 2 then 0.3 when i > 0 then 0.3 else 0.25 end as double) as confidence from k""")
def _kind(spark, sf):
    return report.kind_guess(report.overview(_roles(spark, sf))).drop("rationale")


@query("report_titles", f"""with {SQL_OVERVIEW}
select ds as dataset_id, upper(ds[1]) || ds[2:] as title,
 {sql_int('n_rows')} || ' rows × ' || {sql_int('n_cols')} || ' columns' as subtitle from ov""")
def _titles(spark, sf):
    parts = report.plan_report(_roles(spark, sf))
    return parts["overview"].select("dataset_id", "title", "subtitle")


