"""Grouping, time buckets, histograms and cross-tabs (A1-A10).

``by`` names key columns (such as ``dataset_id``) carried through an operator,
so that one job serves many tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.cells import cell, quoted
from tablescope.functions.text import bin_label

# Length of a top list, of a cross-tab axis, and number of bins.
TOP_GROUPS = 8
TOP_KEYS = 6
HISTOGRAM_BINS = 12
# Longest spans, in days, shown by day and by month.
DAY_SPAN = 60
MONTH_SPAN = 1100

_STATE = ("_sum", "_n", "_rows")


def _measure_state(value: Column | None) -> list[Column]:
    """Mergeable state of a measure: sum, readable values, rows."""
    value = F.lit(None).cast("double") if value is None else value
    return [
        F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"),
        F.count(value).alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
    ]


def _merge_state() -> list[Column]:
    return [F.sum(name).alias(name) for name in _STATE]


def _value_of_state(measure: str | None, agg: str) -> Column:
    """Displayed value: rows, sum, or mean of the readable values, 0 if none (A1)."""
    if measure is None or agg == "count":
        return F.col("_rows").cast("double")
    if agg == "sum":
        return F.col("_sum")
    return F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_sum") / F.col("_n"))


def aggregate_value(df: DataFrame, measure: str | None = None, agg: str = "count",
                    by: Sequence[str] = ()) -> DataFrame:
    """Count, sum or mean of a measure; an empty input gives 0 (A1)."""
    value = None if measure is None else cell(df, measure).number
    state = df.groupBy(*[quoted(b) for b in by]).agg(*_measure_state(value))
    return state.select(*by, _value_of_state(measure, agg).alias("value"))


def group_breakdown(
    df: DataFrame,
    dimension: str,
    measure: str | None = None,
    agg: str = "count",
    limit: int = TOP_GROUPS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Top groups of a dimension and one row that pools the rest (A2).

    Rows are pre-aggregated per group before any ranking, and the rank filter
    keeps only ``limit`` groups of a task.  The ranking names the whole state,
    so that both uses of the groups read one shuffle; the groups are then
    pooled under the position they got, the others under the last one.
    """
    value = F.lit(None).cast("double") if measure is None else cell(df, measure).number
    groups = (
        df.select(*[quoted(b) for b in by], cell(df, dimension).key.alias("value"), value.alias("_measure"))
        .groupBy(*by, "value")
        .agg(*_measure_state(F.col("_measure")))
        .withColumn("total", _value_of_state(measure, agg))
    )
    ranking = Window.partitionBy(*by).orderBy(
        F.col("total").desc(), F.col("value").asc(), *[F.col(s).asc() for s in _STATE]
    )
    top = (
        groups.withColumn("position", F.row_number().over(ranking))
        .filter(F.col("position") <= limit)
        .select(*[F.col(b).alias(f"_top_{b}") for b in by], F.col("value").alias("_top_value"), "position")
    )
    if not by:
        top = F.broadcast(top)  # at most `limit` rows
    same = reduce(
        and_, [F.col(b).eqNullSafe(F.col(f"_top_{b}")) for b in by], F.col("value") == F.col("_top_value")
    )
    pooled = (
        groups.join(top, same, "left")
        .groupBy(*by, F.coalesce("position", F.lit(limit + 1)).alias("position"))
        .agg(*_merge_state(), F.max("_top_value").alias("_name"), F.count(F.lit(1)).alias("_groups"))
    )
    return pooled.select(
        *by,
        F.coalesce("_name", F.format_string("+ %d more", "_groups")).alias("value"),
        _value_of_state(measure, agg).alias("total"),
        F.col("_rows").alias("count"),
        "position",
    )


def time_series(
    df: DataFrame,
    time_column: str,
    measure: str | None = None,
    agg: str = "count",
    by: Sequence[str] = (),
) -> DataFrame:
    """Buckets by day, month or year, as the whole span suggests (A3).

    One scan aggregates to days; the span and the final buckets come from the
    day rows, whose number is bounded by the calendar.
    """
    moment = cell(df, time_column).moment
    value = F.lit(None).cast("double") if measure is None else cell(df, measure).number
    days = (
        df.select(*[quoted(b) for b in by], moment.alias("_ts"), value.alias("_measure"))
        .filter(F.col("_ts").isNotNull())
        .groupBy(*by, F.date_trunc("day", "_ts").alias("_day"))
        .agg(*_measure_state(F.col("_measure")), F.min("_ts").alias("_min"), F.max("_ts").alias("_max"))
    )
    whole = Window.partitionBy(*by)
    span = F.unix_micros(F.max("_max").over(whole)) - F.unix_micros(F.min("_min").over(whole))
    day = 86_400_000_000
    unit = (
        F.when(span <= DAY_SPAN * day, "day")
        .when(span <= MONTH_SPAN * day, "month")
        .otherwise("year")
    )
    bucket = (
        F.when(F.col("_unit") == "day", F.col("_day"))
        .when(F.col("_unit") == "month", F.date_trunc("month", "_day"))
        .otherwise(F.date_trunc("year", "_day"))
    )
    label = (
        F.when(F.col("_unit") == "day", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("_unit") == "month", F.date_format("ts", "yyyy-MM"))
        .otherwise(F.date_format("ts", "yyyy"))
    )
    return (
        days.withColumn("_unit", unit)
        .groupBy(*by, "_unit", bucket.alias("ts"))
        .agg(*_merge_state())
        .select(*by, label.alias("label"), "ts", _value_of_state(measure, agg).alias("value"))
    )


def series_extremes(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest and lowest bucket of a time series; the earlier of equals (A4)."""
    first = -F.unix_micros("ts")
    return series.groupBy(*by).agg(
        F.max_by("label", F.struct(F.col("value"), first)).alias("peak_label"),
        F.max("value").alias("peak"),
        F.min_by("label", F.struct(F.col("value"), -first)).alias("low_label"),
        F.min("value").alias("low"),
    )


def measure_summary(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, sum, mean, min and max of each measure, in one pass; 0 if empty (A5)."""
    numbers = df.select(
        *[quoted(b) for b in by], *[cell(df, m).number.alias(f"_m{i}") for i, m in enumerate(measures)]
    )
    stats = []
    for i in range(len(measures)):
        x = F.col(f"_m{i}")
        zero = F.lit(0.0)
        stats.append(
            F.struct(
                F.lit(measures[i]).alias("measure"),
                F.count(x).alias("count"),
                F.coalesce(F.sum(x), zero).alias("sum"),
                F.coalesce(F.avg(x), zero).alias("mean"),
                F.coalesce(F.min(x), zero).alias("min"),
                F.coalesce(F.max(x), zero).alias("max"),
            ).alias(f"_s{i}")
        )
    wide = numbers.groupBy(*by).agg(*stats)
    return wide.select(*by, F.inline(F.array(*[f"_s{i}" for i in range(len(measures))])))


def bin_count(n: Column, max_bins: int = HISTOGRAM_BINS) -> Column:
    """Number of bins for ``n`` values: square root, at most ``max_bins``."""
    return F.least(F.lit(max_bins), F.greatest(F.lit(1), F.ceil(F.sqrt(n)))).cast("int")


def bin_index(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Equal-width bin of a value, the maximum falling into the last one."""
    width = (high - low) / bins
    index = F.floor((value - low) / width)
    return F.when(low == high, 0).otherwise(F.greatest(F.lit(0), F.least(index, bins - 1))).cast("int")


def with_bin_edges(bins: DataFrame) -> DataFrame:
    """Add ``start``, ``end`` and ``label`` to rows with low, high, bins and bin."""
    width = (F.col("high") - F.col("low")) / F.col("bins")
    last = F.col("bin") == F.col("bins") - 1
    return (
        bins.withColumn("start", F.col("low") + F.col("bin") * width)
        .withColumn("end", F.when(last, F.col("high")).otherwise(F.col("start") + width))
        .withColumn("label", bin_label(F.col("start"), F.col("end")))
    )


def regrouped(df: DataFrame, by: Sequence[str], more: Sequence[Column], *aggregates: Column) -> DataFrame:
    """Aggregate rows that were joined on ``by`` before, by these and more keys.

    Grouped by the columns themselves, the rows would stay where the join put
    them, a hot key in one task.  Behind a struct they are aggregated in part,
    then dealt anew, and adaptive execution may split the hot key in the join.
    """
    if not by:
        return df.groupBy(*more).agg(*aggregates)
    grouped = df.groupBy(F.struct(*by).alias("_by"), *more).agg(*aggregates)
    return grouped.select("_by.*", *[c for c in grouped.columns if c != "_by"])


def histogram(
    df: DataFrame, column: str, max_bins: int = HISTOGRAM_BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width histogram of a numeric column, empty bins included.

    The range is one row (a scalar subquery) or, with ``by``, one row per key.
    """
    values = df.select(*[quoted(b) for b in by], cell(df, column).number.alias("_x"))
    return histogram_of_values(values, by, max_bins)


def histogram_of_values(
    values: DataFrame, by: Sequence[str], max_bins: int = HISTOGRAM_BINS, few_keys: bool = False
) -> DataFrame:
    """Histogram of column ``_x``; with ``few_keys`` the key count is bounded
    (by a schema, say), so that the ranges may be broadcast."""
    values = values.filter(F.col("_x").isNotNull())
    bounds = (
        values.groupBy(*by)
        .agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("_x").alias("_n"))
        .filter(F.col("_n") > 0)
        .withColumn(
            "bins",
            F.when(F.col("low") == F.col("high"), 1).otherwise(bin_count(F.col("_n"), max_bins)),
        )
    )
    if by:
        ranged = values.join(F.broadcast(bounds) if few_keys else bounds, list(by))
    else:
        whole = bounds.select(F.struct("low", "high", "bins")).scalar()
        ranged = values.withColumn("_b", whole).select("_x", "_b.low", "_b.high", "_b.bins")
    index = bin_index(F.col("_x"), F.col("low"), F.col("high"), F.col("bins"))
    counts = regrouped(ranged, by, [index.alias("bin")], F.count(F.lit(1)).alias("count"))
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    filled = frame.join(counts, [*by, "bin"], "left")
    return with_bin_edges(filled).select(
        *by, "bin", "start", "end", "label",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def top_keys(
    df: DataFrame, dimension: str, limit: int = TOP_KEYS, by: Sequence[str] = ()
) -> DataFrame:
    """Most frequent keys of a dimension and how many others there are."""
    counts = (
        df.select(*[quoted(b) for b in by], cell(df, dimension).key.alias("key"))
        .groupBy(*by, "key")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranking = Window.partitionBy(*by).orderBy(F.col("count").desc(), F.col("key").asc())
    top = counts.withColumn("position", F.row_number().over(ranking)).filter(
        F.col("position") <= limit
    )
    distinct = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_keys"), F.sum("count").alias("_rows"))
    if by:
        joined = top.join(distinct, list(by))
    else:
        joined = top.withColumn("_keys", distinct.select("_keys").scalar())
    return joined.select(
        *by, "position", "key", "count", F.greatest(F.lit(0), F.col("_keys") - limit).alias("truncated")
    )


def cross_tab(
    df: DataFrame,
    row_dim: str,
    col_dim: str,
    measure: str | None = None,
    agg: str = "count",
    limit: int = TOP_KEYS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pivot of two dimensions over the most frequent keys of each.

    Each axis has at most ``limit`` keys, so rows outside are dropped before the
    shuffle and the cells number at most ``limit`` squared.  Absent cells are 0.
    """
    value = F.lit(None).cast("double") if measure is None else cell(df, measure).number
    rows = df.select(
        *[quoted(b) for b in by],
        cell(df, row_dim).key.alias("row_key"),
        cell(df, col_dim).key.alias("col_key"),
        value.alias("_measure"),
    )
    row_top = top_keys(df, row_dim, limit, by).select(
        *by, F.col("key").alias("row_key"), F.col("position").alias("row_position")
    )
    col_top = top_keys(df, col_dim, limit, by).select(
        *by, F.col("key").alias("col_key"), F.col("position").alias("col_position")
    )
    if by:
        inside = rows.join(row_top, [*by, "row_key"], "left_semi").join(
            col_top, [*by, "col_key"], "left_semi"
        )
        columns = col_top.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("col_position", "col_key"))).alias("_cols")
        )
        framed = row_top.join(columns, list(by))
    else:
        inside = rows.join(F.broadcast(row_top), "row_key", "left_semi").join(
            F.broadcast(col_top), "col_key", "left_semi"
        )  # at most `limit` keys on each side
        columns = col_top.agg(F.array_sort(F.collect_list(F.struct("col_position", "col_key"))))
        framed = row_top.withColumn("_cols", columns.scalar())
    frame = framed.withColumn("_col", F.explode("_cols")).select(
        *by, "row_key", "row_position", "_col.col_key", "_col.col_position"
    )
    cells = (
        regrouped(inside, by, [F.col("row_key"), F.col("col_key")], *_measure_state(F.col("_measure")))
        .withColumn("value", _value_of_state(measure, agg))
    )
    return frame.join(cells, [*by, "row_key", "col_key"], "left").select(
        *by, "row_key", "col_key", "row_position", "col_position",
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def cross_tab_totals(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row, column and grand totals of the displayed cells.

    Totals of means are sums of the means shown, so they are taken from the
    cross-tab and not from the rows behind it.
    """
    level = F.grouping_id()
    totals = (
        cells.cube(*[quoted(b) for b in by], "row_key", "col_key")
        .agg(F.sum("value").alias("total"), level.alias("_level"))
        .filter(F.col("_level").isin(1, 2, 3))
    )
    return totals.select(
        *by, "row_key", "col_key",
        F.when(F.col("_level") == 1, "row").when(F.col("_level") == 2, "column").otherwise("grand").alias("kind"),
        "total",
    )


def cross_tab_peak(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest displayed cell, at least 0, for shading."""
    return cells.groupBy(*by).agg(F.greatest(F.max("value"), F.lit(0.0)).alias("peak"))


def relative_to_peak(groups: DataFrame, column: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """Add ``share``: size of a bar relative to the largest one, at least 1 (A10).

    For presentation tables such as the result of ``group_breakdown``.
    """
    peak = groups.groupBy(*by).agg(F.max(F.abs(column)).alias("_peak"))
    if by:
        joined = groups.join(peak, list(by))
    else:
        joined = groups.withColumn("_peak", peak.scalar())
    share = F.abs(column) / F.greatest(F.col("_peak"), F.lit(1.0))
    return joined.withColumn("share", share).drop("_peak")
