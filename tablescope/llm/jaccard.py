"""Operator 2: n-gram Jaccard join by rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct n-word shingles, as 64-bit hashes.  Equal sets are one class; classes are joined,
and documents take the component of their class.

1. *Shared prefixes.*  In the order of hashes, two sets with enough in common share at least l tokens of their first
   n - a + l (a: least overlap, l: a share of n).  Tokens are dealt into buckets by hash; classes of which too few of these
   tokens occur in another class have no partner and leave.  This spares the rest a full count of their tokens.
2. *Rare-first prefixes.*  For the classes left, document frequencies of all tokens are counted in such buckets.  Sorted
   by frequency, the first n - a + 1 tokens are the prefix; tokens of one class come first and cannot match.
3. *Candidates* share a prefix token and pass the length filter, the positional filter (tokens left after the match) and
   the suffix filter (token counts in hash ranges bound the overlap).  Each pair is verified once on the whole sets.
   In a token's list every class first meets two classes with few tokens of their own.  Then only pairs of a list that
   are still in different components are formed, so that a group of near copies need not be expanded into all pairs.

No bucket, list or group is cut.  What one task holds at a time is bounded: a bucket by ``_bucket_count``, a class by its
text.  Results are right but for hash collisions: among N classes about N^2 / 2^65 pairs.

Defined results: null and empty texts have an empty set and are their own component; texts of fewer words than n are
one shingle; equal texts are linked; a repeated row joins its class; a null doc_id is linked like any other but never
names a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, small, stored, text_batches, with_row_key

#: Words of a shingle, and least similarity in percent, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Share of the set by which the first filter's prefixes are longer.
LONGER = 0.15
BINS = 16
#: Bytes of text that are shingled at once; each takes some 60 bytes of memory meanwhile.
SLICE = 1_500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; a word's hash is a polynomial of its bytes, found from running sums."""

    def __init__(self, words: int) -> None:
        self.words, self.power, self.inverse = words, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            undo = pow(_ODD, -1, 1 << 64)
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _ODD, dtype=np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, undo, dtype=np.uint64))])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8") for t in texts]
        joined = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
        inside = ~_BLANK[joined]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self._powers(len(joined) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[joined] * self.power[: len(joined)])])
        word = _mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        first = np.cumsum([1, *(len(r) + 1 for r in raw)])
        bounds = np.searchsorted(starts, first)
        run = np.zeros(len(word), dtype=np.uint64)
        if len(word) >= self.words:
            last = len(word) - self.words + 1
            for k in range(self.words):
                run[:last] = _mixed(run[:last] * np.uint64(_ODD) + word[k : k + last])
        found = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= self.words:
                found.append(np.unique(run[low : high - self.words + 1]))
            elif high > low:
                one = np.zeros(1, dtype=np.uint64)
                for w in word[low:high]:
                    one = _mixed(one * np.uint64(_ODD) + w)
                found.append(_mixed(one + np.uint64(high - low)))
            else:
                found.append(run[:0])
        return found


def _class_of(tokens: np.ndarray) -> int:
    """64-bit key of a set."""
    with np.errstate(over="ignore"):
        key = _mixed(np.array([np.sum(_mixed(tokens ^ np.uint64(_ODD))) + np.uint64(len(tokens))], dtype=np.uint64))
    return int(key.view(np.int64)[0])


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def _longer(n: int) -> int:
    return int(LONGER * n) + 1


def _sets(docs: DataFrame, words: int, percent: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, class and the tokens of the first filter's prefix (mixed again, to be dealt evenly); carried columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [(c, docs.schema[c].dataType.simpleString()) for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch, texts in text_batches(batches, SLICE):
            sets = shingler(texts)
            prefixes = [_mixed(s[: len(s) - least_overlap(len(s), percent) + _longer(len(s))]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array(prefixes, pa.binary()), *batch.columns[2:]],
                ["doc_id", "n", "class", "tokens", *carried])

    schema = ", ".join([f"doc_id {kind}, n long, class long, tokens binary", *(f"{c} {k}" for c, k in more)])
    return docs.select("doc_id", "text", *carried).mapInArrow(run, schema)


# Document frequencies in buckets of tokens --------------------------------------------------------------

_BLOCK = "bucket int, class binary, n binary, tokens_of binary, tokens binary"
_MAPPED_TOKENS = 1_000_000


def _bucket_count(tokens: int) -> int:
    """Buckets of some 250,000 tokens; of up to 8 million, once there are 4096 buckets."""
    return max(1, min(4096, tokens // 250_000), tokens // 8_000_000)


def _dealt(sets: DataFrame, buckets: int) -> DataFrame:
    """The tokens of (class, n, tokens), or the mixed shingles of (class, n, shingles), by bucket: per block its classes,
    their n, how many tokens of each, the tokens.  A task deals a class once, however many copies it has."""
    column = "tokens" if "tokens" in sets.columns else "shingles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in held_tokens])
            tokens = np.concatenate(held_tokens)
            keys, ns = np.repeat(np.array(held_class, dtype=np.int64), sizes), np.repeat(np.array(held_n, dtype=np.int64), sizes)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, keys, ns = bucket[order], tokens[order], keys[order], ns[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(int(b[0]), *_runs(k, n), t.tobytes()) for b, k, n, t in zip(*(np.split(x, cuts) for x in (bucket, keys, ns, tokens)))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], ["bucket", "class", "n", "tokens_of", "tokens"])

        held_class, held_n, held_tokens, size = [], [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for key, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key in seen:
                    continue
                seen.add(key)
                if column == "tokens":
                    tokens = np.frombuffer(own.as_py(), dtype=np.uint64)
                else:
                    tokens = _mixed(np.asarray(own.values).view(np.uint64))
                if len(tokens):
                    held_class.append(key)
                    held_n.append(n)
                    held_tokens.append(tokens)
                    size += len(tokens)
                if size >= _MAPPED_TOKENS:
                    yield flushed()
                    held_class, held_n, held_tokens, size = [], [], [], 0
        if size:
            yield flushed()

    return sets.select("class", "n", column).mapInArrow(run, _BLOCK)


def _runs(keys: np.ndarray, ns: np.ndarray) -> tuple[bytes, bytes, bytes]:
    begin = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[begin].tobytes(), ns[begin].astype(np.int32).tobytes(), np.diff(np.append(begin, len(keys))).astype(np.int32).tobytes()


def _joined(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, n and token of every posting of a bucket."""
    times = np.frombuffer(b"".join(group["tokens_of"]), dtype=np.int32)
    keys = np.repeat(np.frombuffer(b"".join(group["class"]), dtype=np.int64), times)
    ns = np.repeat(np.frombuffer(b"".join(group["n"]), dtype=np.int32), times)
    return keys, ns, np.frombuffer(b"".join(group["tokens"]), dtype=np.uint64)


def _frequencies(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, n, token and number of classes of each distinct (class, token) whose token more than one class has."""
    keys, ns, tokens = _joined(group)
    order = np.lexsort((keys, tokens))
    keys, ns, tokens = keys[order], ns[order], tokens[order]
    token_begins = np.concatenate([[True], np.diff(tokens) != 0])
    fresh = token_begins | np.concatenate([[True], np.diff(keys) != 0])
    keys, ns, tokens, token_begins = keys[fresh], ns[fresh], tokens[fresh], token_begins[fresh]
    number = np.cumsum(token_begins) - 1
    held = np.bincount(number)[number]
    more = held > 1
    return keys[more], ns[more], tokens[more], held[more]


def _shared_counts(blocks: DataFrame) -> DataFrame:
    """class and how many of its tokens another class has."""
    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys, times = np.unique(_frequencies(group)[0], return_counts=True)
        return pd.DataFrame({"class": keys, "shared": times})

    return blocks.groupBy("bucket").applyInPandas(count, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))


def _prefix_postings(blocks: DataFrame, groups: int, percent: int) -> DataFrame:
    """token, class, n, place (in rare-first order), own (tokens of no other class) and bins of every prefix token that
    several classes have."""
    def back(group: pd.DataFrame) -> pd.DataFrame:
        keys, ns, tokens, held = _frequencies(group)
        to = keys % groups
        order = np.lexsort((keys, to))
        to, keys, ns, tokens, held = (x[order] for x in (to, keys, ns, tokens, held))
        cuts = np.flatnonzero(np.diff(to)) + 1
        rows = [(int(t[0]), *_runs(k, n), w.tobytes(), h.astype(np.int32).tobytes()) for t, k, n, w, h in zip(*(np.split(x, cuts) for x in (to, keys, ns, tokens, held))) if len(t)]
        return pd.DataFrame(rows, columns=["part", "class", "n", "tokens_of", "tokens", "held"])

    def prefixes(group: pd.DataFrame) -> pd.DataFrame:
        keys, ns, tokens = _joined(group)
        held = np.frombuffer(b"".join(group["held"]), dtype=np.int32)
        order = np.lexsort((tokens, held, keys))
        keys, ns, tokens = keys[order], ns[order].astype(np.int64), tokens[order]
        begins = np.concatenate([[True], np.diff(keys) != 0])
        begin = np.flatnonzero(begins)
        number = np.cumsum(begins) - 1
        sizes = np.diff(np.append(begin, len(keys)))
        own = ns - sizes[number]
        place = own + np.arange(len(keys)) - begin[number]
        bins = np.zeros((len(begin), BINS), dtype=np.int32)
        np.add.at(bins, (number, (tokens >> np.uint64(60)).astype(np.int64)), 1)
        keep = place <= ns + (-percent * ns // 100)
        return pd.DataFrame({"token": tokens[keep].view(np.int64), "class": keys[keep], "n": ns[keep], "place": place[keep], "own": own[keep], "bins": list(bins[number[keep]])})

    parts = blocks.groupBy("bucket").applyInPandas(back, "part long, class binary, n binary, tokens_of binary, tokens binary, held binary")
    return parts.groupBy("part").applyInPandas(prefixes, "token long, class long, n long, place long, own long, bins array<int>")


# Candidates, verification, components -------------------------------------------------------------------


def _passes(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter for two postings of one token."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil(percent * (n + m) / (100 + percent))
    length = (100 * n >= percent * m) & (100 * m >= percent * n)
    position = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place")) >= least
    suffix = F.aggregate(F.zip_with(F.col(f"{x}.bins"), F.col(f"{y}.bins"), lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, b: a + b) >= least
    return length & position & suffix


def _pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    one, two = F.col(f"{x}.class"), F.col(f"{y}.class")
    return joined.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return both.filter(100 * common >= percent * (sizes - common)).select("a", "b")


def _first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each class with two classes of each of its tokens: those with the fewest tokens of their own, by a hash."""
    def chosen(seed: int) -> Column:
        return F.min(F.struct("own", F.xxhash64("token", "class", F.lit(seed)).alias("tie"), "class", "n", "place", "bins"))

    hubs = postings.groupBy("token").agg(F.array(chosen(0), chosen(1)).alias("hubs"))
    hubs = hubs.select("token", F.explode(F.array_distinct(F.transform("hubs", lambda h: F.struct(h["class"].alias("class"), h["n"].alias("n"), h["place"].alias("place"), h["bins"].alias("bins"))))).alias("h"))
    hubs = hubs.select("token", "h.*")
    joined = postings.alias("x").join(hubs.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & _passes("x", "y", percent))
    return _pairs(joined, "x", "y")


def _other_pairs(postings: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs of a token's list in different components: classes outside its largest component with all others."""
    rows = postings.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    counts = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    open_ = counts.groupBy("token").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("components")).filter("components > 1")
    rows = stored(rows.join(open_.select("token", "main"), "token"))
    x, y = rows.filter("component <> main").alias("x"), rows.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.class") < F.col("y.class")))
    return _pairs(x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _passes("x", "y", percent)), "x", "y")


def connected(edges: DataFrame) -> DataFrame:
    """class and component (its smallest class) of every class in ``edges`` (a, b).

    In each round every node that has a smaller neighbour moves to the smallest one and the graph is drawn anew between
    the places moved to, until no edge is left.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    place = stored(edges.select(F.explode(F.array("a", "b")).alias("class")).distinct().withColumn("component", F.col("class")))
    while not edges.isEmpty():
        moves = edges.groupBy("a").agg(F.min("b").alias("to"))
        again = moves.select(F.col("a").alias("to"), F.col("to").alias("further"))
        moves = stored(moves.join(again, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        at = moves.select(F.col("a").alias("component"), "to")
        place = stored(place.join(at, "component", "left").select("class", F.coalesce("to", "component").alias("component")))
        ends = edges.join(moves, "a").join(moves.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b", "left").select(F.col("to").alias("a"), F.coalesce("to_b", "b").alias("b"))
        chains = moves.select(F.col("to").alias("b")).distinct().join(moves.select(F.col("a").alias("b"), "to"), "b").select("b", F.col("to").alias("a")).select("a", "b")
        drawn = ends.unionByName(chains)
        edges = stored(drawn.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    return place


def _shingles(docs: DataFrame, words: int) -> DataFrame:
    """class, n and shingles of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for _, texts in text_batches(batches, SLICE):
            sets = shingler(texts)
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             ["class", "n", "shingles"])

    return docs.select("text").mapInArrow(run, "class long, n long, shingles array<long>")


def _tokens_in(sets: DataFrame, column: str) -> int:
    size = F.octet_length(column) / 8 if column == "tokens" else F.size(column)
    return int(sets.agg(F.sum(size)).first()[0] or 0)


@dataclass
class Classes:
    """What a join finds: its documents (doc_id, n, class), the classes of those with shingles (class, smallest, n,
    copies), the sets of the classes that may have partners (class, n, shingles), and the components of linked classes
    (class, component)."""

    rows: DataFrame
    classes: DataFrame
    sets: DataFrame
    component: DataFrame


def classes_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, carried: tuple[str, ...] = ()) -> Classes:
    rows = stored(_sets(docs, words, percent, carried))
    full = rows.filter("n > 0")
    shared = _shared_counts(_dealt(full, _bucket_count(_tokens_in(full, "tokens"))))
    classes = full.groupBy("class").agg(F.min("doc_id").alias("smallest"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    needed = F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) * LONGER) + 1
    partners = stored(classes.join(shared, "class").filter(F.col("shared") >= needed).select("class", "smallest"))
    chosen = small(partners.select(F.col("smallest").alias("_smallest")).distinct(), 1_000_000)
    theirs = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("_smallest")), "left_semi")
    sets = stored(_shingles(theirs, words).dropDuplicates(["class"]).join(partners.select("class"), "class", "left_semi"))
    tokens = _tokens_in(sets, "shingles")
    postings = stored(_prefix_postings(_dealt(sets, _bucket_count(tokens)), _bucket_count(tokens), percent))
    first = stored(_verified(_first_pairs(postings, percent), sets, percent))
    other = _verified(_other_pairs(postings, connected(first), percent), sets, percent)
    return Classes(rows, classes, sets, connected(first.unionByName(other)))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; linked: |A and B| * 100 >= percent * |A or B|.

    The links themselves, and how many each document has, come from ``links``."""
    found = classes_of(docs, words, percent)
    named = found.classes.select("class", "smallest").join(found.component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.join(names, "component").select("class", "component_id")
    out = found.rows.filter("n > 0").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, unchanged, of each component one row: that of the smallest doc_id (null last, equal ids: any one).

    Documents without words have no component and stay, each of its rows.
    """
    own, key = with_row_key(docs), ["row_file", "row_at"]
    found = classes_of(own.select("row.doc_id", "row.text", *key), words, percent, tuple(key))
    rows = found.rows.filter("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *key)).alias("best")
    heads = rows.groupBy("class").agg(best).join(found.component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    stays = heads.groupBy("component").agg(F.min("best").alias("best")).select("best.row_file", "best.row_at")
    dropped = rows.select(*key).join(stays, key, "left_anti")
    return own.join(small(dropped, 1_000_000), key, "left_anti").select("row.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), 4, 85)


def _sql(words: int = 4, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {words} then [{shingle} for i in range(1, len(w) - {words - 2})] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from o join n nx on nx.doc_id = a join n ny on ny.doc_id = b where 100 * o >= {percent} * (nx.n + ny.n - o)),
way as (select a, b from e union all select b, a from e),
reach as (select doc_id as a, doc_id as b from d union select r.a, t.b from reach r join way t on r.b = t.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach where reach.a = d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id"""


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLES = {"op2_ngram_jaccard": _sql()}
