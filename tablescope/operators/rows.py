"""Row operators: filter, search, sort, page (Q1-Q6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablescope.functions.cells import cell, quoted
from tablescope.functions.text import EMPTY_LABEL
from tablescope.session import stored

PAGE_SIZES = (25, 50, 100)
# Rows from the start within which a page is taken directly.
DIRECT_ROWS = 10_000


def _equals(df: DataFrame, name: str, value: str) -> Column:
    """Whether a cell's trimmed text is ``value``.

    Columns of whole numbers, flags and times also get the test in their own
    type, which reaches the scan; the text of a cell stays the authority.
    """
    view, dtype, col = cell(df, name), df.schema[name].dataType, quoted(name)
    test = view.key == value
    if not isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return test
    return (col.isNull() if value == EMPTY_LABEL else col == F.lit(value).try_cast(dtype)) & test


def filter_condition(df: DataFrame, filters: Mapping[str, str]) -> Column:
    """AND of equality tests on trimmed values; ``(empty)`` selects missing cells."""
    return reduce(and_, [_equals(df, name, value) for name, value in filters.items()], F.lit(True))


def apply_filters(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows that pass every filter (Q1)."""
    return df.filter(filter_condition(df, filters)) if filters else df


def drill_down(filters: Mapping[str, str], *steps: tuple[str, str]) -> dict[str, str]:
    """Filters after clicks: a new value replaces the column's old one (Q2)."""
    return {**filters, **dict(steps)}


def search_rows(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the text, in any case, in any column (Q3)."""
    needle = text.strip().lower()
    if not needle:
        return df
    hits = [F.contains(F.lower(cell(df, c).text), F.lit(needle)) for c in columns or df.columns]
    return df.filter(reduce(or_, hits))


def natural_key(text: Column) -> Column:
    """Sort key that ignores case and accents and orders digit runs of any length by value.

    A run becomes its length and its digits without leading zeros.
    """
    def comparable(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    numbered = F.when(text.rlike("[0-9]"), F.array_join(F.transform(runs, comparable), "")).otherwise(text)
    return F.collate(numbered, "UNICODE_CI_AI")


def sort_order(df: DataFrame, column: str, desc: bool = False, kind: str | None = None) -> list[Column]:
    """Ordering by one column with missing cells last in both directions.

    ``kind`` is the inferred type of a text column (``integer``, ``number`` or
    ``date``); other columns sort by their own type, text in natural order.
    """
    view, dtype = cell(df, column), df.schema[column].dataType
    if kind in ("integer", "number") or isinstance(dtype, T.NumericType):
        keys = [view.number, natural_key(view.text)] if isinstance(dtype, T.StringType) else [view.number]
    elif kind == "date" or isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        keys = [view.moment, natural_key(view.text)] if isinstance(dtype, T.StringType) else [view.moment]
    else:
        keys = [natural_key(view.text)]
    directed = [k.desc_nulls_last() if desc else k.asc_nulls_last() for k in keys]
    return [view.missing.asc(), *directed]


def sort_rows(
    df: DataFrame,
    column: str,
    desc: bool = False,
    kind: str | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Rows in a total order, by range partitions (Q4)."""
    return df.orderBy(*sort_order(df, column, desc, kind), *[quoted(c).asc() for c in tie_break])


def numbered_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """All rows with ``row_number`` (from 1) in the given order.

    The sorted rows are written once, in range partitions.  A row's number is
    its place in its partition plus the rows of the partitions before, of which
    there is one count each.
    """
    return placed_rows(df.orderBy(*order))


def placed_rows(df: DataFrame) -> DataFrame:
    """All rows with ``row_number`` (from 1) in the order of their partitions.

    The rows are written once, so that all later readers see the same places.
    """
    place = F.monotonically_increasing_id()
    rows = stored(df.withColumns({
        "_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn("row_number", F.col("_start") + F.col("_at") + 1).drop(
        "_part", "_at", "_start")


def page_rows(
    df: DataFrame,
    page: int,
    size: int = PAGE_SIZES[0],
    order: Sequence[Column] = (),
    clamp: bool = True,
) -> DataFrame:
    """One page of rows in the given order, with ``row_number`` (Q5).

    Pages count from 0; with ``clamp`` a page beyond the end becomes the last
    one.  Pages among the first ``DIRECT_ROWS`` rows come from a distributed
    top-k; deeper ones from rows numbered in range partitions.  Without an
    order rows keep the places they are read at, at any depth: they are
    numbered by partition, without a sort.
    """
    reach = (page + 1) * size
    if not order:
        rows = placed_rows(df)
        held = F.lit(rows.count())
    elif reach <= DIRECT_ROWS:
        number = F.row_number().over(Window.orderBy(*order))
        rows = df.orderBy(*order).limit(reach).withColumn("row_number", number.cast("long"))
        held = F.count("*").over(Window.partitionBy())
    else:
        rows = numbered_rows(df, order)
        held = F.lit(rows.count())
    last = F.greatest(F.floor((held - 1) / size), F.lit(0)) if clamp else F.lit(page)
    chosen = F.least(F.lit(page), last)
    return rows.withColumn("_page", chosen).filter(
        (F.col("row_number") > F.col("_page") * size) & (F.col("row_number") <= (F.col("_page") + 1) * size)
    ).drop("_page")


def filtered_counts(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Selected and total number of rows, in one pass (Q6)."""
    return df.agg(
        F.count_if(filter_condition(df, filters)).alias("filtered"), F.count("*").alias("total")
    )
