"""Operator 9: sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document's tokens and one end mark are a run; runs longer than a sequence are cut into whole sequences with the
shorter rest in front.  Pieces are dealt into groups by a hash of their key.  In a group, pieces from the longest to
the shortest go where the sum over all residual gaps g of (open sequences with gap g) squared becomes smallest.
Whole sequences need no place in a group.  Only lengths are dealt; ``packed_sequences`` joins the tokens on again.

Groups hold ``group_pieces`` pieces on average, as many as the table has pieces below a whole sequence; a group loses
a few sequences at most.  Defined results: null and empty texts are the end mark alone; equal rows are packed each for itself, and rows
that share a doc_id too; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, stored, text_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, or None to use the tokenizer file alone.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY, END_ID = 2048, 0
GROUP_PIECES = 16_384


class Ids:
    """Token ids of texts by the tokenizer file at ``path``, without special tokens.

    A rank file of the same vocabulary, read by a faster library, gives the same ids for Latin-1 texts, whose
    character classes are the same in every Unicode version; all other texts go through the tokenizer file itself, and
    so do texts that hold the string of one of its added tokens, unless these strings are to be ``ordinary`` text.
    """

    def __init__(self, path: str = TOKENIZER, ranks: str | None = RANKS, ordinary: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.tokenizer.encode_special_tokens = ordinary
        self.added = [] if ordinary else [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids."""
        if self.fast and not any(token in text for token in self.added):
            try:
                text.encode("latin-1")
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except UnicodeEncodeError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a run: whole sequences, the rest in front."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids (bytes) of every document."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path, ranks)
        for batch, texts in text_batches(batches):
            rows, cut = [], []
            for row, text in enumerate(texts):
                body = np.concatenate([ids(text), end]).astype("<u4", copy=False)
                for number, (start, length) in enumerate(pieces_of(len(body), capacity)):
                    part = body[start : start + length].tobytes()
                    rows.append((row, number, start, length, zlib.crc32(part)))
                    cut.append(part if with_ids else None)
            at, *numbers = (np.array(c) for c in zip(*rows))
            arrays = [batch.column(0).take(pa.array(at)), pa.array(numbers[0], pa.int32()), *(pa.array(n, pa.int64()) for n in numbers[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cut, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", ids binary" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long{more}")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the given order.

    Putting a piece into a gap g leaves g - s.  The sum of squares changes by
    [1 - 2 N(g)] (none for a new sequence) + [1 + 2 N(g - s)] (none for a full one); ties go to the smaller gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    numbers, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        change = np.where(counts[size:] > 0, 2 * (counts[: capacity + 1 - size] - counts[size:]) + 2, 1 << 40)
        change[0] -= 1 if counts[size] else 0
        change[-1] = 2 * counts[capacity - size] + 1
        gap = size + int(change.argmin())
        if gap == capacity:
            number = len(used)
            used.append(0)
        else:
            number = open_by_gap[gap].pop()
            counts[gap] -= 1
        numbers[i], offsets[i] = number, used[number]
        used[number] += size
        if left := capacity - used[number]:
            open_by_gap[left].append(number)
            counts[left] += 1
    return numbers, offsets


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        numbers, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group["group"].astype("int64") * (1 << 32) + numbers
        group["offset"] = offsets
        return group.drop(columns="group")

    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return keyed.groupBy("group").applyInPandas(place, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", sequence_id long, offset long")


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Pieces that fill a sequence are one by themselves, with a negative number; only the others are packed.
    """
    pieces = stored(tokenized_pieces(docs, capacity))
    full, rest = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pack(rest, max(1, -(-rest.count() // group_pieces)), capacity).unionByName(alone)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """sequence_id and its ids: the placed pieces meet their tokens again, in the order of their offsets.

    Needs distinct doc_id values, as pieces are known by them.
    """
    placed = packed_pieces(docs, capacity, group_pieces).select("doc_id", "piece", "sequence_id", "offset")
    tokens = tokenized_pieces(docs, capacity, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.join(tokens, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict = {}
