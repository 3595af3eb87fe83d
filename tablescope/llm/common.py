"""What the text operators share: table access, word rule, folds, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.session import configure, shared_folder

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch handed to Python; texts are a few kB, so a batch stays at some MB.
BATCH_ROWS = "1000"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that results or memory rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts ('' for null).

    One text longer than the limit is a slice of its own: texts are never cut.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        start, size = 0, 0
        for i in range(batch.num_rows):
            long = len(column[i].as_buffer()) if column[i].is_valid else 0
            if size and size + long > limit:
                yield _slice(batch, start, i)
                start, size = i, 0
            size += long
        if start < batch.num_rows:
            yield _slice(batch, start, batch.num_rows)


def _slice(batch: pa.RecordBatch, start: int, stop: int) -> tuple[pa.RecordBatch, list[str]]:
    part = batch.slice(start, stop - start)
    return part, [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: several jobs read them, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Rows as ``row`` (all columns) with a key of their own, ``row_file`` and ``row_at``, that later jobs see again.

    Rows read from files are known by file and place; others are written once.
    """
    try:
        return docs.select(F.xxhash64("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"), F.struct(*docs.columns).alias("row"))
    except AnalysisException:
        numbered = docs.select(F.lit(0).cast("long").alias("row_file"), F.monotonically_increasing_id().alias("row_at"), F.struct(*docs.columns).alias("row"))
        return stored(numbered)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a table after counting it; beyond ``most`` rows the join is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
