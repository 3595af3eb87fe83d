"""Operator 13: periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that no
neighbouring word extends.  Words are numbered; suffixes are sorted by doubling ranks, which also give the common
prefixes of neighbours.  For each LCP interval of depth q, every suffix i outside its largest child is tested: if the
inverse array puts i + q or i - q into the interval but into another child, a square of period q ends there and cannot
be moved right.  Such squares are rotated left as far as the words allow, again by the ranks; squares that fill the
same stretch are one run, of the smallest period.  Intervals come from one scan with a stack; no tree is built.

The documents of a slice are sorted together: a word counts as another one in another document, so that nothing reaches
over.  A run repeats its first 16 words (with the usual limits) one period later; only documents in which some 16 words
recur, by a hash that can only err towards more documents, are sorted at all.

Everything is decided in one pass over the text, with no shuffle.  Defined results: null, empty and blank texts have
no words and no runs; equal texts get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, text_batches

LEAST, TIMES = 24, 3
#: Suffixes that are tested at once.
_TESTED = 1 << 20


def ranks(ids: np.ndarray) -> list[np.ndarray]:
    """By k, the ranks of the stretches of 2**k ids from each place (-1 beyond the end), until all differ."""
    n = len(ids)
    levels = [np.append(np.unique(ids, return_inverse=True)[1], -1).astype(np.int64)]
    while levels[-1].max() + 1 < n:
        last, step = levels[-1], 1 << (len(levels) - 1)
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(0, n - step)] = last[step:n]
        levels.append(np.append(np.unique(last[:n] * (n + 1) + ahead + 1, return_inverse=True)[1], -1))
    return [level.astype(np.int32) for level in levels]


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """By place in the order, the ids that the suffix shares with the one before (0 for the first)."""
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(order), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) << k
        shared[1:] += same
        a += same
        b += same
    return shared


def smaller_children(shared: np.ndarray) -> np.ndarray:
    """Rows (depth, first and last place of an LCP interval, first and last place of a child) but for largest children."""
    found: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, list[int]]] = []  # depth and the places where children begin
    for at, depth in enumerate([*shared[1:].tolist(), 0], start=1):
        begin = at - 1
        while open_ and open_[-1][0] > depth:
            own, starts = open_.pop()
            begin = starts[0]
            if len(starts) == 2:
                middle = starts[1]
                found.append((own, begin, at - 1, begin, middle - 1) if middle - begin <= at - middle else (own, begin, at - 1, middle, at - 1))
            else:
                ends = [*starts[1:], at]
                sizes = [e - s for s, e in zip(starts, ends)]
                largest = sizes.index(max(sizes))
                found += [(own, begin, at - 1, s, e - 1) for k, (s, e) in enumerate(zip(starts, ends)) if k != largest]
        if depth:
            if open_ and open_[-1][0] == depth:
                open_[-1][1].append(at)
            else:
                open_.append((depth, [begin, at]))
    return np.array(found, dtype=np.int64).reshape(-1, 5)


def branching_squares(children: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares that cannot be moved right."""
    n, starts, periods = len(order), [], []
    sizes = children[:, 4] - children[:, 3] + 1
    ends = np.cumsum(sizes)
    low = 0
    while low < len(children):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _TESTED, side="right")))
        depth, first, last, begin, end = np.repeat(children[low:high], sizes[low:high], axis=0).T
        inner = np.arange(len(begin)) - np.repeat(ends[low:high] - sizes[low:high] - (ends[low - 1] if low else 0), sizes[low:high])
        suffix = order[begin + inner]
        for other, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
            inside = (other >= 0) & (other < n)
            at = place[np.where(inside, other, 0)]
            hit = inside & (at >= first) & (at <= last) & ((at < begin) | (at > end))
            starts.append(start[hit])
            periods.append(depth[hit])
        low = high
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    if len(ids) < 2:
        return np.empty((0, 3), dtype=np.int64)
    levels = ranks(ids)
    place = levels[-1][:-1].astype(np.int64)
    order = np.empty(len(ids), dtype=np.int64)
    order[place] = np.arange(len(ids))
    square, period = branching_squares(smaller_children(common_prefixes(levels, order)), order, place)
    start = square.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = start - (1 << k)
        held = np.maximum(back, 0)
        start = np.where((back >= 0) & (levels[k][held] == levels[k][held + period]), back, start)
    length = square + 2 * period - start
    long = length >= np.maximum(least, times * period)
    rows = np.stack([start, length, period], axis=1)[long]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def shared_words(least: int = LEAST, times: int = TIMES) -> int:
    """Words, rounded down to a power of two, that the first suffix of any run shares with the one a period later."""
    return 1 << min(max(least - q, (times - 1) * q) for q in range(1, least + 1)).bit_length() - 1


def recurring(hashes: np.ndarray, document: np.ndarray, width: int) -> np.ndarray:
    """Documents in which a stretch of ``width`` words (a power of two), of one hash each, may recur."""
    if len(hashes) <= width:
        return np.empty(0, dtype=np.int64)
    held, size = hashes.astype(np.uint64), 1
    while size < width:
        held = held ^ (held >> np.uint64(29))
        held = held[:-size] * np.uint64(0x9E3779B97F4A7C15) + held[size:]
        size *= 2
    whole = document[: len(held)] == document[width - 1 :]
    of = document[: len(held)][whole]
    keys = held[whole] + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(of[order[again]])


def runs_of_texts(lists: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of every list of words."""
    found = [np.empty((0, 3), dtype=np.int64)] * len(lists)
    sizes = np.array([len(words) for words in lists], dtype=np.int64)
    if not sizes.sum():
        return found
    hashes = np.fromiter((hash(w) for words in lists for w in words), dtype=np.int64, count=int(sizes.sum()))
    chosen = recurring(hashes, np.repeat(np.arange(len(lists)), sizes), shared_words(least, times)).tolist()
    if not chosen:
        return found
    numbers: list[np.ndarray] = []
    total = 0
    for k in chosen:
        own: dict[bytes, int] = {}
        numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in lists[k]), dtype=np.int64, count=len(lists[k])) + total)
        total += len(own)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    rows = runs_of(np.concatenate(numbers), least, times)
    cut = np.searchsorted(rows[:, 0], begins)
    for k, begin, low, high in zip(chosen, begins, cut, cut[1:]):
        found[k] = rows[low:high] - np.array([begin, 0, 0])
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one blank, without those that some run repeats."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (structs of start, length and period, by start and period) and the collapsed text of every document.

    ``change`` gets a document's id and words and gives the words to look at instead.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            lists = [t.encode().split() for t in texts]
            if change:
                lists = [change(i, words) for i, words in zip(batch.column(0).to_pylist(), lists)]
            found = runs_of_texts(lists, least, times)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs in found]
            left = [collapsed(words, runs).decode() for words, runs in zip(lists, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct)), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its id, gets a periodic end: the rule of the query (a missing id counts as the empty text)."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def greatest(runs: Column) -> Column:
    """The run with most periods; ties go to the smallest start, then period.  Null without a run."""
    def better(best: Column, r: Column) -> Column:
        # Lengths and periods are numbers of words, so their products stay exact.
        more, less = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (more > less), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, some of which get a periodic end, and digests of the runs and of the collapsed text."""
    found = periodic_runs(documents(spark, sf_dir), change=planted).withColumn("best", greatest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict = {}
