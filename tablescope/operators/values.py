"""Mergeable states of columns: one narrow row per distinct value, whatever the values hold.

A native value is counted as it is, a text by a digest of 128 bits with its length
and typed readings; texts stay where they are read.  What the text of a native
value says (its length, its digest) is found once per distinct value.  States of several tables are one
union with one exchange, and states written for some files merge with those of
later ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.functions.cells import cell, cell_text, quoted
from tablescope.functions.text import MISSING_TOKENS, trim_ws
from tablescope.functions.values import finite, parse_boolean, parse_date, parse_number

#: Characters of a value that travel with its digest, for ranking.
HEAD = 64
#: Letters that neither numbers nor dates have; prose shows one at once.
_OTHER_LETTERS = "[A-DF-SU-Ya-df-z]"
_SCALARS = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
READINGS = ("len", "x", "b", "d")
DIGEST = ("h1", "h2")


def is_scalar(df: DataFrame, name: str) -> bool:
    """True for native numbers, booleans and times, whose text is short."""
    return isinstance(df.schema[name].dataType, _SCALARS)


#: What a cell of a column is counted by; the code of a column is its index times ``_KINDS`` and this place.
_LONG, _DOUBLE, _MOMENT, _FLAG, _TEXT, _PARSED = range(6)
_KINDS = 8


def _cell(df: DataFrame, name: str, index: int) -> Column:
    """A cell as it leaves its column: its code, and one of text, whole number (times and booleans too) and number."""
    dtype, col = df.schema[name].dataType, quoted(name)
    types = {"text": "string", "_v": "long", "x": "double"}
    if isinstance(dtype, T.IntegralType):
        kind, own = _LONG, {"_v": col}
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A negative zero counts by its text, as it is written.
        kind, own = _DOUBLE, {"x": col, "text": F.when(col == 0, F.when(col.cast("string").startswith("-"), "-0"))}
    elif isinstance(dtype, T.DecimalType):
        kind, own = _DOUBLE, {"x": col, "text": cell_text(col, dtype)}
    elif isinstance(dtype, T.BooleanType):
        kind, own = _FLAG, {"_v": col.cast("int")}
    elif is_scalar(df, name):
        kind, own = _MOMENT, {"_v": F.unix_micros(col.cast("timestamp"))}
    else:
        kind, own = _PARSED if isinstance(dtype, T.StringType) else _TEXT, {"text": cell_text(col, dtype)}
    return F.struct(F.lit(index * _KINDS + kind).alias("_code"), *[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def _raw(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All cells as rows ``(by, _code, text, _v, x)``; all but the code are null where the cell is missing.

    Cells are trimmed behind the explosion, by one expression for all columns,
    so that the generated code stays short enough to be compiled.
    """
    if not names:
        return _raw(df.withColumn("_none", F.lit("")), ["_none"], by).limit(0)
    rows = df.select(*[quoted(b) for b in by], F.inline(F.array(*[_cell(df, name, i) for i, name in enumerate(names)])))
    rows = rows.withColumns({"text": trim_ws(F.col("text")), "x": finite(F.col("x")) + F.lit(0.0)})
    # The longest token that stands for a missing cell has four letters: long texts are not put in lower case.
    absent = F.when(F.length("text") <= max(map(len, MISSING_TOKENS)), F.lower("text").isin(*MISSING_TOKENS)).otherwise(False)
    return rows.withColumn("text", F.when(~absent, F.col("text")))


def _native(rows: DataFrame) -> DataFrame:
    """The index of the column, and the whole number, time and boolean that ``_v`` stands for."""
    kind, v = F.col("_code") % _KINDS, F.col("_v")
    return rows.withColumns({
        "column_index": F.floor(F.col("_code") / _KINDS).cast("int"), "l": F.when(kind == _LONG, v),
        "d": F.when(kind == _MOMENT, F.timestamp_micros(v)), "b": F.when(kind == _FLAG, v == 1)})


def _hashed(kinds: Sequence[str], *seed: Column) -> Column:
    return F.coalesce(*[F.when(F.col(k).isNotNull(), F.xxhash64(*seed, k)) for k in kinds])


def _written() -> Column:
    """Text of a native value."""
    c = F.col
    return F.when(c("l").isNotNull(), c("l").cast("string")).when(c("x").isNotNull(), cell_text(c("x"), T.DoubleType())).when(
        c("d").isNotNull(), cell_text(c("d"), T.TimestampType())).otherwise(c("b").cast("string"))


def _readings(rows: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Cells with the readings ``len, _rx, _rb, _rd`` of their texts."""
    c = F.col
    parsed = c("_code") % _KINDS == _PARSED
    # A text with letters of prose is neither number nor date; most texts show one at once.
    plain = parsed & c("text").isNotNull() & ~c("text").rlike(_OTHER_LETTERS)
    rows = rows.select(
        *keys, "_code", "text", "_v", "x", plain.alias("_plain"), F.length("text").alias("len"),
        F.when(plain, parse_number(c("text"))).when(c("text").isNotNull(), c("x")).alias("_rx"))
    return rows.select(
        *keys, "_code", "text", "_v", "x", "len", "_rx", F.when(parsed, parse_boolean(c("text"))).alias("_rb"),
        F.when(c("_plain") & c("_rx").isNull(), parse_date(c("text"))).alias("_rd"))


def _state(rows: DataFrame, keys: Sequence[Column | str], *more: str) -> DataFrame:
    """Rows ``(column_index, h1, h2, ..., len, x, b, d)`` of values: texts by ``_v`` and ``h2``, others by ``_v`` or ``x``."""
    c, text = F.col, F.col("h2").isNotNull()
    rows = _native(rows)
    kinds = ("l", "x", "d", "b")
    return rows.select(
        *keys, "column_index", F.when(text, c("_v")).otherwise(_hashed(kinds)).alias("h1"),
        F.when(text, c("h2")).otherwise(_hashed(kinds, F.lit(1))).alias("h2"), *more,
        F.when(text, c("len")).otherwise(F.coalesce(F.length(_written()), F.lit(0))).alias("len"),
        F.when(text, c("_rx")).when(c("l").isNotNull(), c("l").cast("double")).otherwise(c("x")).alias("x"),
        F.when(text, c("_rb")).otherwise(c("b")).alias("b"), F.when(text, c("_rd")).otherwise(c("d")).alias("d"))


def _keyed(rows: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Cells by what they are counted by: ``_v, h2`` of a text, ``_v`` or ``x`` of a native value."""
    filled = F.col("text").isNotNull()
    return rows.select(
        *keys, "_code", F.when(filled, F.xxhash64("text")).otherwise(F.col("_v")).alias("_v"),
        F.when(filled, F.xxhash64(F.lit(1), "text")).alias("h2"), F.when(~filled, F.col("x")).alias("x"), "len", "_rx", "_rb", "_rd")


def cells(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), head: bool = False) -> DataFrame:
    """All cells as rows ``(column_index, h1, h2, ...)``; the digest of a missing cell is null.

    With ``head`` the rows carry the start of the value and whether there is
    ``more`` of it, else length, number, boolean and time.
    """
    keys = [quoted(b) for b in by]
    if not head:
        return _state(_keyed(_readings(_raw(df, names, by), keys), keys), keys)
    rows = _native(_raw(df, names, by))
    kinds = ("text", "l", "x", "d", "b")
    shown = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(_written())
    return rows.select(*keys, "column_index", _hashed(kinds).alias("h1"), _hashed(kinds, F.lit(1)).alias("h2"),
                       F.left(shown, F.lit(HEAD)).alias("head"), (F.length(shown) > HEAD).alias("more"))


def named(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the name of the column of their index."""
    return rows.withColumn("column", F.element_at(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("column_index") + 1))


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of cells: equal values are merged first, and read afterwards where they are native."""
    quoted_keys = [quoted(k) for k in keys]
    rows = _keyed(_readings(rows, quoted_keys), quoted_keys)
    merged = rows.groupBy(*quoted_keys, "_code", "_v", "h2", "x").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(r).alias(r) for r in ("len", "_rx", "_rb", "_rd")])
    return _state(merged, quoted_keys, "n")


def column_values(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """State of columns: rows ``(by, column, column_index, h1, h2, n, len, x, b, d)`` of the distinct values.

    Equal values are merged per task before the shuffle, so a value that fills
    a third of a table travels once per task.
    """
    return named(_counted(_raw(df, names, by), by), names)


def values_of_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """State of the columns of several tables, keyed by ``dataset_id``: one union, one exchange."""
    ids = list(tables)
    rows = [_raw(df, df.columns).select(F.lit(i).alias("_table"), "*") for i, df in enumerate(tables.values())]
    merged = _counted(reduce(DataFrame.unionAll, rows), ["_table"])
    names = F.array(*[F.array(*[F.lit(c) for c in df.columns]) for df in tables.values()])
    return merged.select(
        F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_table") + 1).alias("dataset_id"),
        F.element_at(F.element_at(names, F.col("_table") + 1), F.col("column_index") + 1).alias("column"),
        "column_index", *DIGEST, "n", *READINGS)


def merged_values(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One state from those of several parts of a table (new files, say); columns meet by name.

    A column keeps the smallest index it has in a part.
    """
    rows = reduce(DataFrame.unionByName, states)
    keys = [*by, "column"]
    whole = rows.groupBy(*keys, *DIGEST).agg(
        F.min("column_index").alias("column_index"), F.sum("n").alias("n"), *[F.max(r).alias(r) for r in READINGS])
    return whole.select(*keys, "column_index", *DIGEST, "n", *READINGS)


def head_counts(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by, column_index, h1, h2, head, more, n)`` of the distinct values that are not missing."""
    rows = cells(df, names, by, head=True).filter(F.col("h1").isNotNull())
    return rows.groupBy(*by, "column_index", *DIGEST, "head", "more").agg(F.count(F.lit(1)).alias("n"))


def whole_texts(df: DataFrame, names: Sequence[str], chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by, column_index, h1, h2, text)``: the texts of the chosen digests, from one more scan.

    ``chosen`` has the key columns and the digest; each task hands on each text once.
    """
    parts = []
    for i, name in enumerate(names):
        if not is_scalar(df, name):
            view = cell(df, name)
            text = F.when(~view.missing, trim_ws(view.text))
            parts.append(F.struct(F.lit(i).alias("column_index"), F.xxhash64(text).alias("h1"),
                                  F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")))
    keys = [*by, "column_index", *DIGEST]
    found = df.select(*[quoted(b) for b in by], F.inline(F.array(*parts))).filter(F.col("text").isNotNull())
    same = [found[k].eqNullSafe(chosen[k]) for k in keys]
    return found.join(chosen, reduce(Column.__and__, same), "left_semi").groupBy(*keys).agg(F.min("text").alias("text"))
