"""Type inference and column profiles.

Types, completeness, ranges and distinct counts come from mergeable states
(``values``), top values from counts by digest: no text is a shuffle key.  The
generated code does not grow with the number of columns.  The exact median narrows the values by a
bounded sketch before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.cells import cell, quoted
from tablescope.functions.values import infer_number_kind, is_numeric_type, is_whole
from tablescope.operators.aggregates import TOP_GROUPS, histogram_of_values, regrouped
from tablescope.operators.values import DIGEST, cells, column_values, head_counts, is_scalar, named, values_of_tables, whole_texts
from tablescope.session import stored

# Fixed value: share of cells that must read as a number or date.
TYPE_SHARE = 0.95

_SKETCH = 10_000  # accuracy of the quantile sketch that brackets the median
_SLICES = 4_096  # equal slices of the bracket
_FEW = 10_000  # digests (16 bytes and keys) that may be broadcast


def _by(by: Sequence[str]) -> list[Column]:
    return [quoted(b) for b in by]


def _columns(df: DataFrame, cols: Sequence[str] | None, by: Sequence[str]) -> list[str]:
    return list(cols) if cols is not None else [c for c in df.columns if c not in by]


def inferred_type(filled: Column, bools: Column, numbers: Column, wholes: Column, dates: Column) -> Column:
    """Column type from counts of readable cells; numbers win over dates."""
    return (
        F.when(filled == 0, "string")
        .when(bools == filled, "boolean")
        .when(numbers / filled >= TYPE_SHARE, infer_number_kind(wholes, numbers))
        .when(dates / filled >= TYPE_SHARE, "date")
        .otherwise("string")
    )


def scalars_of(values: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per column from its state: type, completeness, range, mean.

    ``keys`` end with the column.  The rows of a state are distinct values with
    their counts; without ``exact`` they are cells, and the number of distinct
    ones is estimated.
    """
    n, x, d, filled = F.col("n"), F.col("x"), F.col("d"), F.col("h1").isNotNull()
    unique = F.count_if(filled) if exact else F.approx_count_distinct("h1", 0.01)

    def rows_with(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    sums = values.groupBy(*keys).agg(
        F.min("column_index").alias("column_index"), F.sum(n).alias("total"), rows_with(filled).alias("filled"),
        unique.alias("unique_count"), rows_with(F.col("b").isNotNull()).alias("bools"),
        rows_with(x.isNotNull()).alias("numbers"), rows_with(is_whole(x)).alias("wholes"),
        rows_with(d.isNotNull()).alias("dates"), F.sum(F.col("len") * n).alias("chars"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x * n).alias("sum"),
        F.min(d).alias("first_ts"), F.max(d).alias("last_ts"),
    )
    return _scalars(sums, keys)


def _scalars(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col
    kind = inferred_type(c("filled"), c("bools"), c("numbers"), c("wholes"), c("dates"))
    numeric, dated = is_numeric_type(c("inferred_type")), c("inferred_type") == "date"
    return sums.withColumn("inferred_type", kind).select(
        *keys, "column_index", "inferred_type", "total", "filled",
        (c("total") - c("filled")).alias("missing"),
        F.when(c("total") == 0, 0.0)
        .otherwise((c("total") - c("filled")) / c("total") * 100)
        .alias("missing_pct"),
        "unique_count",
        F.when(c("filled") == 0, 0.0).otherwise(c("chars") / c("filled")).alias("avg_length"),
        F.when(numeric, c("min")).alias("min"), F.when(numeric, c("max")).alias("max"),
        F.when(numeric, c("sum") / c("numbers")).alias("mean"),
        F.when(dated, F.date_format("first_ts", "yyyy-MM-dd")).alias("first_date"),
        F.when(dated, F.date_format("last_ts", "yyyy-MM-dd")).alias("last_date"),
    )


def _with_empty(rows: DataFrame, tables: Mapping[str | None, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Adds the columns of tables without rows; the names come from the schemas."""
    entries = [
        F.struct(*([] if t is None else [F.lit(t).alias("dataset_id")]), F.lit(c).alias("column"), F.lit(i).alias("_place"))
        for t, names in tables.items() for i, c in enumerate(names)
    ]
    places = rows.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*entries)))
    whole = places.join(rows, list(keys), "left")
    zeros = {"total": 0, "filled": 0, "missing": 0, "missing_pct": 0.0, "unique_count": 0, "avg_length": 0.0}
    return whole.withColumns({
        "column_index": F.col("_place"), "inferred_type": F.coalesce("inferred_type", F.lit("string")),
        **{k: F.coalesce(k, F.lit(v)) for k, v in zeros.items()}}).select(*rows.columns)


def column_scalars(
    df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """One row per column: type, completeness, range, mean.

    Exact statistics come from the distinct values, which travel as digests.
    ``exact=False`` skips their shuffle and estimates how many there are.
    """
    names = _columns(df, cols, by)
    if exact:
        values = column_values(df, names, by)
    else:
        values = named(cells(df, names, by).withColumn("n", F.lit(1)), names)
    rows = scalars_of(values, [*by, "column"], exact)
    return rows if by else _with_empty(rows, {None: names}, ["column"])


def scalars_of_tables(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """Scalar profiles of the columns of many tables, keyed by ``dataset_id``, in one job."""
    if not exact:
        return reduce(DataFrame.unionByName, [column_stats(df, name, exact=False) for name, df in tables.items()])
    keys = ["dataset_id", "column"]
    rows = scalars_of(values_of_tables(tables), keys)
    return _with_empty(rows, {name: df.columns for name, df in tables.items()}, keys)


def infer_types(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Inferred type of each column, from all its cells."""
    return column_scalars(df, cols, by).select(*by, "column", "inferred_type")


def numeric_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Readable numbers of several columns as rows ``(column, _x)``."""
    pairs = [F.struct(F.lit(c).alias("column"), cell(df, c).number.alias("_x")) for c in cols]
    nothing = F.array().cast("array<struct<column:string,_x:double>>")
    return df.select(*_by(by), F.inline(F.array(*pairs) if pairs else nothing)).filter(F.col("_x").isNotNull())


def medians(values: DataFrame, by: Sequence[str], few_keys: bool = True) -> DataFrame:
    """Exact median of ``_x`` per key, without sorting a whole group.

    1. A quantile sketch brackets the middle 0.2 % of each group.
    2. One pass counts values below the bracket and value counts inside it.
    3. The bracket is cut into equal slices; running totals over at most
       ``_SLICES`` rows per key find the slices that hold the middle ranks.
    4. Only the values of those slices are ranked.
    """
    keys = list(by)
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_x", F.array(F.lit(0.499), F.lit(0.501)), F.lit(_SKETCH)).alias("_q"),
        F.count("_x").alias("_n"),
    ).select(*keys, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_n")
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    joined = values.join(F.broadcast(sketch) if few_keys else sketch, keys)
    carried = [*keys, "_lo", "_hi", "_n"]
    counts = (
        regrouped(joined, carried, [F.when(x.between(lo, hi), x).alias("_v")],
                  F.count(F.lit(1)).alias("_c"), F.count_if(x < lo).alias("_below"))
        .withColumn(
            "_slice",
            F.when(F.col("_v").isNull(), -1)
            .when(lo == hi, 0)
            .otherwise(F.least(F.floor((F.col("_v") - lo) / (hi - lo) * _SLICES), F.lit(_SLICES - 1)))
            .cast("int"),
        )
        .withColumn("_w", F.when(F.col("_v").isNull(), F.col("_below")).otherwise(F.col("_c")))
    )
    running = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        counts.groupBy(*keys, "_n", "_slice")
        .agg(F.sum("_w").alias("_slice_w"))
        .withColumn("_end", F.sum("_slice_w").over(running))
        .withColumn("_start", F.col("_end") - F.col("_slice_w"))
        .withColumn("_k1", F.floor((F.col("_n") + 1) / 2))
        .withColumn("_k2", F.floor(F.col("_n") / 2) + 1)
    )

    def holds(rank: str, start: Column, end: Column) -> Column:
        return (start < F.col(rank)) & (F.col(rank) <= end)

    targets = slices.filter(
        (F.col("_slice") >= 0)
        & (holds("_k1", F.col("_start"), F.col("_end")) | holds("_k2", F.col("_start"), F.col("_end")))
    ).select(*keys, "_slice", "_start", "_k1", "_k2")
    inner = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.filter(F.col("_v").isNotNull())
        .join(F.broadcast(targets) if few_keys else targets, [*keys, "_slice"])
        .withColumn("_to", F.col("_start") + F.sum("_c").over(inner))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    middle = ranked.groupBy(*keys).agg(
        F.max(F.when(holds("_k1", F.col("_from"), F.col("_to")), F.col("_v"))).alias("_m1"),
        F.max(F.when(holds("_k2", F.col("_from"), F.col("_to")), F.col("_v"))).alias("_m2"),
    )
    return middle.select(*keys, ((F.col("_m1") + F.col("_m2")) / 2).alias("median"))


def numeric_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Count, range, mean, median and population deviation per column."""
    keys = [*by, "column"]
    values = numeric_long(df, cols, by)
    basic = values.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std_dev"),
        *([] if exact else [F.percentile_approx("_x", 0.5, F.lit(_SKETCH)).alias("median")]),
    )
    if exact:
        basic = basic.join(medians(values, keys, few_keys=not by), keys, "left")
    return basic.select(*keys, "n", "min", "max", "mean", "median", "std_dev")


def top_values(
    df: DataFrame, cols: Sequence[str] | None = None, limit: int = TOP_GROUPS, by: Sequence[str] = ()
) -> DataFrame:
    """Most frequent values per column, then ``+ N more`` for the rest.

    Values are counted by digest and ranked by count and their first
    characters, in each task before the shuffle.  Longer values among the first
    ``limit``, and those that share count and start with the last of them, get
    their texts from a second scan and are ranked again by the whole text.
    """
    names = _columns(df, cols, by)
    keys = [*by, "column_index"]
    counts = head_counts(df, names, by)
    ranking = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("head").asc(), F.col("more").asc())
    top = counts.withColumn("_rank", F.rank().over(ranking)).filter(F.col("_rank") <= limit)
    if any(not is_scalar(df, name) for name in names):
        top = stored(top)
        longer = top.filter("more").select(*keys, *DIGEST)
        # Few, unless values differ behind the same long start only: then the join is left to Spark.
        few = longer.limit(_FEW + 1).count() <= _FEW
        texts = whole_texts(df, names, F.broadcast(longer) if few else longer, by)
        on = reduce(Column.__and__, [top[k].eqNullSafe(texts[k]) for k in [*keys, *DIGEST]])
        top = top.join(texts, on, "left").select(*[top[c] for c in top.columns], F.coalesce("text", "head").alias("value"))
    else:
        top = top.withColumn("value", F.col("head"))
    final = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value").asc())
    top = top.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit)
    whole = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_rows"))
    shown = top.groupBy(*keys).agg(F.sum("n").alias("_shown"))
    rest = (
        whole.filter(F.col("_values") > limit)
        .join(shown, keys)
        .select(
            *keys, F.lit(limit + 1).alias("rank"),
            F.format_string("+ %d more", F.col("_values") - limit).alias("value"),
            (F.col("_rows") - F.col("_shown")).alias("count"),
        )
    )
    rows = top.select(*keys, "rank", "value", F.col("n").alias("count")).unionByName(rest)
    return named(rows, names).select(*by, "column", "rank", "value", "count")


def column_stats(df: DataFrame, dataset_id: str | None = None, by: Sequence[str] = (),
                 exact: bool = True) -> DataFrame:
    """Scalar profile of every column; what role inference needs."""
    rows = column_scalars(df, None, by, exact)
    if dataset_id is not None:
        rows = rows.select(F.lit(dataset_id).alias("dataset_id"), *rows.columns)
    return rows


def profile(df: DataFrame, dataset_id: str | None = None, by: Sequence[str] = (),
            exact: bool = True) -> DataFrame:
    """Full profile, one row per column.

    Medians and histograms are given for numeric columns, top values for the
    others; the scalar profile, stored first, says which are which, so that no
    column is read for what it lacks.  All arrays are bounded (12 bins, 9 values).
    """
    keys = [*by, "column"]
    stats = stored(column_stats(df, None, by, exact))
    # One name per column of the schema: which readings each column needs.
    kinds = stats.groupBy("column").agg(F.max(is_numeric_type(F.col("inferred_type"))), F.min(is_numeric_type(F.col("inferred_type"))))
    some, every = ({r[0] for r in kinds.collect() if r[k]} for k in (1, 2))
    names = _columns(df, None, by)
    numbers, others = [c for c in names if c in some], [c for c in names if c not in every]
    values = numeric_long(df, numbers, by)
    spread = numeric_stats(df, numbers, by, exact).select(*keys, "median", "std_dev")
    bins = histogram_of_values(values, keys, few_keys=not by).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", "start", "end", "count", "label"))).alias("histogram")
    )
    top = top_values(df, others, by=by).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top_values")
    )
    numeric = is_numeric_type(F.col("inferred_type"))
    rows = (
        stats.join(spread, keys, "left").join(bins, keys, "left").join(top, keys, "left")
        .withColumn("median", F.when(numeric, F.col("median")))
        .withColumn("std_dev", F.when(numeric, F.col("std_dev")))
        .withColumn("histogram", F.when(numeric, F.col("histogram")))
        .withColumn("top_values", F.when(~numeric, F.col("top_values")))
    )
    if dataset_id is not None:
        rows = rows.select(F.lit(dataset_id).alias("dataset_id"), *rows.columns)
    return rows


def dataset_completeness(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of filled cells over all columns, 100 for no cells."""
    cells = F.sum("total")
    return stats.groupBy(*by).agg(
        F.when(cells == 0, 100.0).otherwise(F.sum("filled") / cells * 100).alias("completeness")
    )


def type_counts(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of columns per inferred type."""
    return stats.groupBy(*by, "inferred_type").agg(F.count(F.lit(1)).alias("columns"))


def completeness(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Filled and missing cells per column of the given rows, in one pass (P10)."""
    names = _columns(df, cols, by)
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("total"),
            F.count_if(~cell(df, c).missing).alias("filled"),
        ).alias(f"s{i}")
        for i, c in enumerate(names)
    ]
    wide = df.groupBy(*by).agg(*stats)
    rows = wide.select(*by, F.inline(F.array(*[f"s{i}" for i in range(len(names))])))
    return rows.select(
        *by, "column", "filled", (F.col("total") - F.col("filled")).alias("missing"),
        F.when(F.col("total") == 0, 100.0).otherwise(F.col("filled") / F.col("total") * 100).alias("pct"),
    )
