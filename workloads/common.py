"""Table access, rounding and SQL fragments shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Round double columns, so that the order of additions does not show."""
    wanted = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in wanted})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# SQL fragments ------------------------------------------------------------

SPACES = (
    "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)||chr(5760)||chr(8192)||chr(8193)"
    "||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)"
    "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"
)


def sql_trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def sql_missing(x: str) -> str:
    return f"({x} is null or lower({sql_trim(x)}) in ('','na','n/a','null','nil','nan','-','--'))"


def sql_key(x: str) -> str:
    return f"case when {sql_missing(x)} then '(empty)' else {sql_trim(x)} end"


def sql_int(x: str) -> str:
    """Whole number with thousands separators."""
    return f"format('{{:,}}', cast(round({x}) as bigint))"


def sql_decimal(x: str, digits: int) -> str:
    """Number with separators and at most ``digits`` decimals."""
    text = f"format('{{:,.{digits}f}}', round({x}, {digits}))"
    return f"regexp_replace(regexp_replace({text}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def sql_percent(x: str) -> str:
    return f"({sql_decimal(x, 1)} || '%')"


def sql_label(x: str, y: str) -> str:
    def bound(v: str) -> str:
        return (
            f"case when abs({v}) >= 1000 or {v} = floor({v}) then {sql_decimal(v, 1)} "
            f"else {sql_decimal(v, 2)} end"
        )

    return f"({bound(x)} || ' – ' || {bound(y)})"


def sql_value(measure: bool, agg: str) -> str:
    if not measure or agg == "count":
        return "cast(c as double)"
    return "s" if agg == "sum" else "case when n = 0 then 0.0 else s / n end"


def sql_breakdown(source: str, dim: str, measure: str | None, agg: str, limit: int) -> str:
    m = measure or "null::double"
    total = sql_value(measure is not None, agg)
    return f"""
with g as (select {sql_key(dim)} as k, coalesce(sum({m}), 0.0) as s, count({m}) as n, count(*) as c
           from {source} group by 1),
r as (select *, row_number() over (order by {total} desc, k) as p from g),
f as (select least(p, {limit + 1}) as position, max(k) as k, count(*) as groups, sum(s) as s,
             cast(sum(n) as bigint) as n, cast(sum(c) as bigint) as c from r group by 1)
select case when position <= {limit} then k else '+ ' || groups || ' more' end as value,
       round({total}, 2) as total, c as "count", cast(position as bigint) as position
from f"""


def sql_series(source: str, ts: str, measure: str | None, agg: str) -> str:
    m = measure or "null::double"
    return f"""
with t as (select {ts} as ts, {m} as m from {source} where {ts} is not null),
u as (select case when epoch_us(max(ts)) - epoch_us(min(ts)) <= 60 * 86400000000 then 'day'
                  when epoch_us(max(ts)) - epoch_us(min(ts)) <= 1100 * 86400000000 then 'month'
                  else 'year' end as unit from t),
b as (select case unit when 'day' then strftime(ts, '%Y-%m-%d') when 'month' then strftime(ts, '%Y-%m')
             else strftime(ts, '%Y') end as label,
             coalesce(sum(m), 0.0) as s, count(m) as n, count(*) as c from t, u group by 1)
select label, round({sql_value(measure is not None, agg)}, 2) as value from b"""


def sql_cross_tab(source: str, row: str, col: str, measure: str | None, agg: str, limit: int) -> str:
    m = measure or "null::double"
    return f"""
with t as (select {sql_key(row)} as rk, {sql_key(col)} as ck, {m} as m from {source}),
rt as (select rk, row_number() over (order by count(*) desc, rk) as rp from t group by rk),
ct as (select ck, row_number() over (order by count(*) desc, ck) as cp from t group by ck),
cells as (select rk, ck, coalesce(sum(m), 0.0) as s, count(m) as n, count(*) as c from t group by 1, 2),
ct_out as (
 select rt.rk as row_key, ct.ck as col_key, rp as row_position, cp as col_position,
        coalesce({sql_value(measure is not None, agg)}, 0.0) as value
 from rt join ct on rp <= {limit} and cp <= {limit} left join cells on cells.rk = rt.rk and cells.ck = ct.ck)
"""


def sql_histogram(source: str, x: str, bins: int = 12) -> str:
    return f"""
with v as (select {x} as x from {source} where {x} is not null),
s as (select min(x) as lo, max(x) as hi, count(*) as n,
             case when min(x) = max(x) then 1 else least({bins}, greatest(1, cast(ceil(sqrt(count(*))) as int))) end as b
      from v),
f as (select lo, hi, b, unnest(range(b)) as bin from s),
c as (select case when lo = hi then 0
                  else greatest(0, least(b - 1, cast(floor((x - lo) / ((hi - lo) / b)) as bigint))) end as bin,
             count(*) as n from v, s group by 1),
e as (select f.bin, lo + f.bin * ((hi - lo) / b) as start,
             case when f.bin = b - 1 then hi else lo + f.bin * ((hi - lo) / b) + (hi - lo) / b end as stop,
             coalesce(c.n, 0) as n from f left join c on c.bin = f.bin)
"""
