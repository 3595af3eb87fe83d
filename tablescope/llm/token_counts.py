"""Operator 6: token counts by a separator scan over flat token files.

A flat file is a run of 16-bit ids in which every document ends with one separator; nothing says where documents
begin.  Files are read as blocks of fixed size.  In each block the separators are found at once; a block is reduced to
its length, its first and last separator and the lengths between neighbours.  Prefix scans over the blocks of a file
(running sums and a running maximum) place the separators in the file, so that a document may span any blocks.

One file's blocks are a window of one row each; a file is what one task wrote, so that a window stays small.  Defined
results: a document without tokens counts 0; tokens behind the last separator are an unfinished document and are not
counted; equal documents count each for itself; empty files and tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablescope.llm.common import documents, stored, text_batches
from tablescope.llm.packing import RANKS, TOKENIZER, Ids

#: The separator, which no text encodes to, and the ids of a block.
SEPARATOR, BLOCK = 50_256, 1 << 17


def flat_blocks(docs: DataFrame, block: int = BLOCK, path: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """The flat token stream of each task as blocks (file, block, data), and the doc_ids of the documents begun in each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([SEPARATOR], dtype="<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, file, number = Ids(path, ranks, ordinary=True), f"part-{TaskContext.get().partitionId():06d}", 0
        held, size, names = [], 0, []

        def row(data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([number], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([names], pa.list_(id_type))],
                ["file", "block", "data", "doc_ids"])

        for batch, texts in text_batches(batches):
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts):
                held += [ids(text).astype("<u2"), end]
                names.append(name)
                size += len(held[-2]) + 1
                if size >= block:
                    whole = np.concatenate(held)
                    for at in range(0, size - block + 1, block):
                        yield row(whole[at : at + block])
                        number, names = number + 1, []
                    held, size = [whole[size - size % block :]], size % block
        if size or names:
            yield row(np.concatenate(held))

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, block long, data binary, doc_ids array<{kind}>")


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Flat files of little-endian unsigned 16-bit ids as blocks (file, block, data)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(data.as_buffer())
                for number, at in enumerate(range(0, len(raw), 2 * block)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([bytes(raw[at : at + 2 * block])], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def _scanned(blocks: DataFrame, separator: int) -> DataFrame:
    """Per block: ids, first and last separator (null: none), lengths between neighbouring separators."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype="<u2")
                ends = np.flatnonzero(ids == separator)
                rows.append((len(ids), int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, (np.diff(ends) - 1).tolist()))
            sizes, first, last, inner = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (sizes, first, last)), pa.array(inner, pa.list_(pa.int64()))],
                ["file", "block", "size", "first", "last", "inner"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, size long, first long, last long, inner array<long>")


def document_lengths(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, document (place in the file, from 0) and tokens of every finished document of the files' blocks."""
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = _scanned(blocks, separator)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    rows = rows.withColumns({
        "previous": F.coalesce(F.max(F.col("offset") + F.col("last")).over(ahead), F.lit(-1)),
        "document": F.coalesce(F.sum(ends).over(ahead), F.lit(0))})
    stitched = F.concat(F.array(F.col("offset") + F.col("first") - F.col("previous") - 1), "inner")
    found = rows.filter("first is not null").select("file", "document", F.posexplode(stitched).alias("at", "tokens"))
    return found.select("file", (F.col("document") + F.col("at")).alias("document"), "tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and tokens of every document, read back from flat token blocks.

    The blocks are written once; the scan reads ids only, and doc_ids join by place in the file.
    """
    blocks = stored(flat_blocks(documents(spark, sf_dir)))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = blocks.select("file", "doc_ids", F.coalesce(F.sum(F.size("doc_ids")).over(ahead), F.lit(0)).alias("before"))
    named = named.select("file", "before", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("before") + F.col("at")).alias("document"), "doc_id")
    return named.join(document_lengths(blocks), ["file", "document"]).select("doc_id", "tokens")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict = {}
