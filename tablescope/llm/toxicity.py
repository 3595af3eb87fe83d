"""Operator 7: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows, ``per_class`` of each label at most, picked by a hash of doc_id.
Every term of an example has its place in the vectors.  A term weighs (1 + ln count) x idf x label weight: document
frequencies are counted over all documents, and the label weight rises from ``FLOOR`` with the likelihood ratio between
term and label, up to the bar that a test over all terms would set, so that it ranks terms and leaves none out.  The
examples' vectors form a block-max inverted index: for each term its postings, and its largest weight in each block of
examples.  The commonest terms, whose maxima would bound nothing, also have a row of weights each: one product gives their
part of all cosines for a group of texts.  A block's bound is the largest such part in it and the maxima of the other
terms.  A search visits blocks by falling bound and leaves out those that can hold no nearer example, so that the
``NEIGHBOURS`` nearest are exact.  Their votes, weighed by squared cosine and by how many labelled rows an example stands
for, are calibrated by isotonic pools fitted to the examples with each left out in turn, joined by straight lines.  The
neighbours are the evidence.

Only the examples, their terms and the counts of these reach the driver, all bounded by the sample.  Defined results: texts
that share no term with an example, also null and empty ones, get the share of label 1 among examples without terms (0 if
there are none), and no evidence; with labels of one kind only, all label weights are equal and the score is that label;
without any labelled row it is 0; ties in cosine go to the smaller example number; a doc_id labelled twice counts with its
higher label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, fold, text_batches

PER_CLASS, NEIGHBOURS, BLOCK, THRESHOLD = 4_000, 15, 256, 0.3
#: Label weight of a term that says nothing about the label; one at the bar weighs 1 more.
FLOOR = 0.05
#: Texts whose answers a worker remembers (by digest), and blocks that a search visits first.
REMEMBERED, FIRST_BLOCKS = 20_000, 8
#: Terms with a row of weights: at most so many, each in one of so many examples; and texts of one product.
COMMON, COMMON_SHARE, GROUP = 256, 16, 256
_TERM = re.compile(r"\w+")

#: Term numbers, rising, and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower().replace("_", " "))


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one range after the other, and the length of each range."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths), lengths


class BlockMaxIndex:
    """Vectors of examples in blocks of ``BLOCK``.

    Postings lie by term and example.  An entry is one term in one block: its largest weight and its first posting.
    """

    def __init__(self, vectors: list[Vector], terms: int) -> None:
        self.examples, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        of = term * max(1, self.blocks) + self.example // BLOCK
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        self.posting = np.append(starts, len(of))
        self.block = self.example[starts] // BLOCK
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.entry = np.searchsorted(term[starts], np.arange(terms + 1))

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each common term (-1 for others), and the rows' weights by example."""
        held = np.diff(self.posting[self.entry])
        chosen = np.argsort(-held, kind="stable")[:COMMON]
        chosen = chosen[held[chosen] * COMMON_SHARE >= max(1, self.examples)]
        row, rows = np.full(len(held), -1), np.zeros((len(chosen), self.examples))
        row[chosen] = np.arange(len(chosen))
        places, lengths = _places(self.posting[self.entry[chosen]], self.posting[self.entry[chosen + 1]])
        rows[np.repeat(np.arange(len(chosen)), lengths), self.example[places]] = self.weight[places]
        return row, rows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "common"}  # each worker builds its own

    def nearest(self, query: Vector, count: int, without: int | None = None) -> list[tuple[float, int]]:
        return self.nearest_of([query], count, None if without is None else [without])[0]

    def nearest_of(self, queries: list[Vector], count: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query, (cosine, example) of the nearest examples with a cosine over 0, by falling cosine and rising
        number; ``without`` names one example to leave out for each."""
        if not self.examples:
            return [[] for _ in queries]
        row, rows = self.common
        found = []
        for low in range(0, len(queries), GROUP):
            group = queries[low : low + GROUP]
            dense, others = np.zeros((len(group), len(rows))), []
            for i, (terms, weights) in enumerate(group):
                of = row[terms]
                dense[i, of[of >= 0]] = weights[of >= 0]
                others.append((terms[of < 0], weights[of < 0]))
            parts = dense @ rows
            found += [self._search(parts[i], *others[i], count, without[low + i] if without else None) for i in range(len(group))]
        return found

    def _search(self, cosines: np.ndarray, terms: np.ndarray, weights: np.ndarray, count: int, without: int | None) -> list[tuple[float, int]]:
        """Nearest examples by the common terms' part of the cosines and the other terms of the query."""
        def least() -> float:
            if without is not None:
                cosines[without] = 0
            return max(1e-12, np.partition(cosines, -count)[-count]) if self.examples > count else 1e-12

        bar = least()
        entries, lengths = _places(self.entry[terms], self.entry[terms + 1])
        of_entry, block = np.repeat(weights, lengths), self.block[entries]
        rest = np.bincount(block, self.most[entries] * of_entry, minlength=self.blocks)
        bound = np.maximum.reduceat(cosines, np.arange(0, self.examples, BLOCK)) + rest
        by_bound = np.argsort(-bound, kind="stable")
        for some in (by_bound[:FIRST_BLOCKS], by_bound[FIRST_BLOCKS:]):
            visited = np.zeros(self.blocks, dtype=bool)
            visited[some] = bound[some] >= bar - 1e-9
            mine = np.flatnonzero(visited[block])
            places, lengths = _places(self.posting[entries[mine]], self.posting[entries[mine] + 1])
            cosines += np.bincount(self.example[places], self.weight[places] * np.repeat(of_entry[mine], lengths), minlength=self.examples)
            bar = least()
        near = np.flatnonzero(cosines >= bar - 1e-9)
        rounded = cosines[near].round(12)
        order = np.lexsort((near, -rounded))[:count]
        return [(c, e) for c, e in zip(rounded[order].tolist(), near[order].tolist()) if c >= 1e-12]


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    ids: list = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    stands_for: tuple[float, float] = (1.0, 1.0)
    #: Mean vote and score of each isotonic pool.
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    without_terms: float = 0.0

    def vector(self, text: str) -> Vector:
        counts = Counter(terms_of(text))
        known = self.terms.get
        found = np.array([known(w, -1) for w in counts], dtype=np.int64)
        times = np.fromiter(counts.values(), dtype=float, count=len(counts))
        order = np.argsort(found)[np.count_nonzero(found < 0) :]
        terms = found[order]
        weights = (1 + np.log(times[order])) * self.weights[terms]
        return terms, weights / max(np.sqrt((weights * weights).sum()), 1e-300)

    def vote(self, nearest: list[tuple[float, int]]) -> float:
        weights = [c * c * self.stands_for[self.labels[e]] for c, e in nearest]
        return sum(w for w, (_, e) in zip(weights, nearest) if self.labels[e]) / sum(weights)

    def score(self, nearest: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(nearest), *self.steps)) if nearest else self.without_terms


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Rising steps through (vote, label, weight): where each step begins, and its weighted mean (pool adjacent violators)."""
    pools: list[list[float]] = []
    for vote, label, weight in sorted(points):
        if pools and pools[-1][0] == vote:
            pools[-1][1] += label * weight
            pools[-1][2] += weight
        else:
            pools.append([vote, label * weight, weight])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            start, total, weight_of = pools.pop()
            pools[-1][1] += total
            pools[-1][2] += weight_of
    return [p[0] for p in pools], [p[1] / p[2] for p in pools]


def centres(points: list[tuple[float, float, float]], starts: list[float]) -> np.ndarray:
    """Weighted mean vote of each isotonic pool."""
    votes, _, weights = np.array(points).T
    pool = np.searchsorted(starts, votes, side="right") - 1
    return np.bincount(pool, votes * weights) / np.bincount(pool, weights)


def _summed(texts: DataFrame, run, names: list[str], schema: str) -> pa.Table:
    """The counts n of all tasks, added up."""
    return texts.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n")).toArrow()


def _term_counts(examples: DataFrame) -> pa.Table:
    """label, term and n, the examples of each label that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            labels, terms = zip(*counts) if counts else ((), ())
            arrays = [pa.array(labels, pa.int32()), pa.array(terms, pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["label", "term", "n"])

        counts: Counter = Counter()
        for batch, texts in text_batches(batches):
            for label, text in zip(batch.column(batch.schema.get_field_index("label")).to_pylist(), texts):
                counts.update((label, t) for t in set(terms_of(text)))
            if len(counts) > 300_000:
                yield flushed()
                counts.clear()
        yield flushed()

    return _summed(examples.select("label", "text"), run, ["label", "term"], "label int, term string, n long")


def _frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> pa.Table:
    """term (its number) and n, the documents that hold it, for the terms of the vocabulary; a task keeps one count a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known) + 1, dtype=np.int64)
        for _, texts in text_batches(batches):
            for text in texts:
                found = set(terms_of(text)) or ("",)
                # terms without a number count in the last place
                counts[[known.get(t, -1) for t in found]] += 1
        terms = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(counts[terms], pa.int64())], ["term", "n"])

    return _summed(docs.select("text"), run, ["term"], "term int, n long")


def likelihood_ratios(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """G of term and label, from the examples of each label (rows) that hold each term (columns), and the labels' sizes."""
    total, both = sizes.sum(), held.sum(axis=0)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    return 2 * sum(part(h, both * n / total) + part(n - h, (total - both) * n / total) for h, n in zip(held, sizes))


def label_weights(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``FLOOR`` for a term that is as frequent under either label, up to 1 more at the bar of 2 ln(20 terms)."""
    if not sizes.all():
        return np.ones(held.shape[1])
    bar = 2 * np.log(20.0 * max(1, held.shape[1]))
    return FLOOR + np.clip(likelihood_ratios(held, sizes) / bar, 0, 1) ** 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from ``labels`` (doc_id, toxic); document frequencies come from all of ``docs``."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    wide = 1 << 30
    least = F.when(F.col("label") == 1, _share(per_class, sizes.get(1, 0), wide)).otherwise(_share(per_class, sizes.get(0, 0), wide))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("examples")), F.lit(wide)) < least)
    # At most about 2 * per_class rows: a parameter bounds what is broadcast.
    examples = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").cache()
    taken = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = Model(stands_for=tuple(sizes.get(k, 0) / max(1, taken.get(k, 0)) for k in (0, 1)))
    counts = _term_counts(examples)
    words = counts["term"].to_pylist()
    model.terms = {t: i for i, t in enumerate(sorted(set(words)))}
    held = np.zeros((2, len(model.terms)))
    held[counts["label"].to_numpy(), [model.terms[t] for t in words]] = counts["n"].to_numpy()
    frequencies, frequency = _frequencies(docs, model.terms), np.zeros(len(model.terms))
    frequency[frequencies["term"].to_numpy()] = frequencies["n"].to_numpy()
    idf = np.log((1 + docs.count()) / (1 + frequency)) + 1
    model.weights = idf * label_weights(held, np.array([taken.get(k, 0) for k in (0, 1)], dtype=float))
    vectors = _vectors(examples, model)
    examples.unpersist()
    # Examples with the same strongest term share blocks, which makes the bounds sharp.
    filled = sorted((v for v in vectors if len(v[2][0])), key=lambda v: (v[2][0][v[2][1].argmax()], v[0]))
    model.ids, model.labels = [v[0] for v in filled], [v[1] for v in filled]
    model.index = BlockMaxIndex([v[2] for v in filled], len(model.terms))
    bare = [model.stands_for[v[1]] * np.array([1, v[1]]) for v in vectors if not len(v[2][0])]
    model.without_terms = float(sum(b[1] for b in bare) / sum(b[0] for b in bare)) if bare else 0.0
    found = zip(model.index.nearest_of([v[2] for v in filled], NEIGHBOURS, list(range(len(filled)))), model.labels)
    points = [(round(model.vote(near), 9), label, model.stands_for[label]) for near, label in found if near]
    if points:
        starts, values = isotonic(points)
        model.steps = centres(points, starts), np.array(values)
    else:
        model.steps = np.zeros(1), np.array([model.without_terms])
    return model


def _share(bound: int, size: int, wide: int):
    return F.lit(int(min(1.0, bound / max(1, size)) * wide))


def _vectors(examples: DataFrame, model: Model) -> list[tuple]:
    """(doc_id, label, vector) of every example, by doc_id."""
    kind = examples.schema["doc_id"].dataType.simpleString()
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            vectors = [shared.value.vector(t) for t in texts]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "label")]
            lists = [pa.array([v[k] for v in vectors], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *lists], ["doc_id", "label", "terms", "weights"])

    rows = examples.mapInArrow(run, f"doc_id {kind}, label int, terms array<bigint>, weights array<double>").toArrow()
    vectors = [(t.values.to_numpy(), w.values.to_numpy(zero_copy_only=False)) for t, w in zip(rows["terms"], rows["weights"])]
    return sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), vectors), key=lambda v: (v[0], v[1], len(v[2][0]), v[2][0].tolist(), v[2][1].tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the evidence: array of (doc_id, cosine, label) of the nearest examples."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, remembered = shared.value, {}

        def answers(texts: list[str]) -> list[tuple]:
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in remembered}
            vectors = [model.vector(t) for t in new.values()]
            for key, nearest in zip(new, model.index.nearest_of(vectors, NEIGHBOURS) if model.index else [[]] * len(new)):
                remembered[key] = model.score(nearest), [{"doc_id": model.ids[e], "cosine": c, "label": model.labels[e]} for c, e in nearest]
            return [remembered[k] for k in keys]

        for batch, texts in text_batches(batches):
            ids = batch.column(0)
            example = pa.struct([("doc_id", ids.type), ("cosine", pa.float64()), ("label", pa.int32())])
            scores, evidence = zip(*answers(texts))
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(evidence, pa.list_(example))],
                                             ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double,label:int>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with their evidence, as JSON."""
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2).select("doc_id", "toxic")
    return score(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict = {}
