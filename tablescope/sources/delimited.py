"""Delimited text files."""

from __future__ import annotations

import csv
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablescope.functions.text import trim_ws
from tablescope.sources.headers import unique_names

# Separators tried on a header line when none is given.
SEPARATORS = (",", "\t", "|", ";")
_MALFORMED = "_malformed"
NO_COLUMNS, NO_ROWS = "There are no columns: the first line must name them.", "There are columns but no rows."


class TableError(ValueError):
    """A file that holds no usable table."""


def _headers(spark: SparkSession, path: str | list[str], sep: str | None) -> list[tuple[list[str], list[str], str]]:
    """Files, column names and separator of each distinct header line (the first line that is not blank)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = lines.filter((F.col("start") == 0) & (trim_ws(F.col("value")) != "")).groupBy("file").agg(
        F.min_by("value", "place").alias("header"))
    files: dict[str, list[str]] = {}
    for row in first.collect():  # one line per file
        files.setdefault(row["header"].lstrip("\ufeff"), []).append(row["file"])
    if not files:
        raise TableError(NO_COLUMNS)
    found = []
    for header, paths in sorted(files.items()):
        own = sep or max(SEPARATORS, key=header.count)
        names = unique_names([f.strip() for f in next(csv.reader([header], delimiter=own))])
        found.append((sorted(paths), names, own))
    return found


def _blank(names: list[str]) -> Column:
    return ~reduce(or_, [trim_ws(F.coalesce(f"c{i}", F.lit(""))) != "" for i in range(len(names))])


def _parts(
    spark: SparkSession, path: str | list[str], sep: str | None, multi_line: bool, blank_rows: bool = False
) -> list[tuple[DataFrame, list[str]]]:
    """Rows and column names of the files of each header."""
    parts = []
    for files, names, own in _headers(spark, path, sep):
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        rows = (
            spark.read.schema(schema.add(_MALFORMED, T.StringType()))
            .options(header=True, enforceSchema=True, sep=own, multiLine=multi_line, mode="PERMISSIVE",
                     columnNameOfCorruptRecord=_MALFORMED, escape='"')
            .csv(files)
        )
        parts.append((rows if blank_rows else rows.filter(~_blank(names)), names))
    return parts


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Rows of delimited files as text; blank rows are skipped.

    Files may differ in their headers: columns meet by name, and a column that
    a file lacks is empty.  One pass over all lines of the files finds the
    header lines.  Files split across tasks unless ``multi_line`` allows line
    breaks inside quotes.
    """
    tables = [
        rows.select(*[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)])
        for rows, names in _parts(spark, path, sep, multi_line)
    ]
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
    return whole if len(tables) == 1 else whole.na.fill("")


def read_issues(
    spark: SparkSession, path: str | list[str], sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Malformed rows of delimited files, whole: too few or too many fields."""
    issues = [
        rows.filter(F.col(_MALFORMED).isNotNull()).select(
            F.lit("The row has more or fewer fields than its header.").alias("message"), F.col(_MALFORMED).alias("row"))
        for rows, _ in _parts(spark, path, sep, multi_line)
    ]
    return reduce(DataFrame.unionByName, issues)


def read_summary(
    spark: SparkSession, path: str | list[str], sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    """One row, from one scan: columns, rows, blank and malformed rows, and the error of a table without rows.

    Rows are those that ``read_delimited`` gives; malformed ones are among them, blank ones (nothing but separators and
    white space) are not.  Files without a header line are an error at once.
    """
    parts = _parts(spark, path, sep, multi_line, blank_rows=True)
    seen = [
        rows.select(_blank(names).alias("blank"), F.col(_MALFORMED).isNotNull().alias("malformed")) for rows, names in parts
    ]
    counts = reduce(DataFrame.unionByName, seen).agg(
        F.count_if(~F.col("blank")).alias("rows"), F.count_if("blank").alias("blank_rows"),
        F.count_if(~F.col("blank") & F.col("malformed")).alias("malformed_rows"))
    columns = len({name for _, names in parts for name in names})
    return counts.select(F.lit(columns).cast("long").alias("columns"), "*", F.when(F.col("rows") == 0, NO_ROWS).alias("error"))


def require_rows(df: DataFrame) -> DataFrame:
    """The table, or an error when it has no columns or no rows."""
    if not df.columns:
        raise TableError(NO_COLUMNS)
    if df.isEmpty():
        raise TableError(NO_ROWS)
    return df

