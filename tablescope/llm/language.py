"""Operator 3: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language.  The probability of a word is the sum,
over all ways to segment it into pieces, of the product of the pieces' probabilities; a forward pass adds them up.
A text's score is the sum of its words' log probabilities.  Piece probabilities come from expected counts over all
segmentations (forward-backward), in ``ROUNDS`` rounds from equal ones.

Fitting uses a bounded sample of labelled rows (``rows_per_language``, picked by a hash of doc_id); word counts and
expected counts are summed by Spark, and only pieces x languages numbers reach the driver.  Scoring covers every word
of every text; workers remember the scores of up to ``REMEMBERED`` words.

Words are runs of letters, lower-cased; runs over ``LONGEST`` letters are scored in stretches of that length.  Letters
outside the vocabulary count as one unknown piece.  Defined results: ``und`` and score 0 where the text is null or has
no letter, or nothing was learned; equal texts get equal results; ties go to the first language by name; an empty
table gives an empty result; other columns are kept, except that new columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, fold, text_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
ROWS_PER_LANGUAGE, ROUNDS, SMOOTHING = 5_000, 2, 0.1
UNKNOWN_LOGP, LONGEST, REMEMBERED = -14.0, 24, 300_000
#: Words scored at once; each takes some 4 kB of memory meanwhile.
AT_ONCE = 4_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    found = _LETTERS.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


class Pieces:
    """The vocabulary as hashes of code points, for looking up many substrings at once."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        text = sorted({model.id_to_piece(i).lower() for i in usable})
        self.longest = max(map(len, text))
        hashes = np.array([self._hash(t) for t in text], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.count = hashes[order], order.astype(np.int32), len(text)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def hits(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
        """For words of one length at a time: their indexes, symbols, and (start, end, rows, piece) of each substring
        that is a piece; single symbols outside the vocabulary have the number ``count``."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            index = np.flatnonzero(lengths == n)
            codes = np.array(["▁" + words[i] for i in index.tolist()]).view(np.uint32).reshape(len(index), n + 1).astype(np.uint64)
            ahead = np.zeros((n + 2, len(index)), dtype=np.uint64)
            for j in range(n + 1):
                ahead[j + 1] = ahead[j] * _BASE + codes[:, j] + np.uint64(1)
            power, found = [np.uint64(1)], []
            for _ in range(n + 1):
                power.append(np.uint64(int(power[-1]) * int(_BASE) & (2**64 - 1)))
            for end in range(1, n + 2):
                for size in range(1, min(end, self.longest) + 1):
                    hashes = ahead[end] - ahead[end - size] * power[size]
                    at = np.searchsorted(self.hashes, hashes)
                    at[at == self.count] = 0
                    known = self.hashes[at] == hashes
                    if size == 1:
                        found.append((end - 1, end, np.arange(len(index)), np.where(known, self.numbers[at], self.count)))
                    elif known.any():
                        rows = np.flatnonzero(known)
                        found.append((end - size, end, rows, self.numbers[at[rows]]))
            yield index, n + 1, found

    def forward(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        out = np.empty((len(words), logp.shape[1]))
        for index, n, found in self.hits(words):
            out[index] = self._ahead(len(index), n, found, logp)[n]
        return out

    @staticmethod
    def _ahead(rows: int, n: int, found: list, logp: np.ndarray) -> np.ndarray:
        a = np.full((n + 1, rows, logp.shape[1]), -np.inf)
        a[0] = 0.0
        for start, end, at, piece in found:
            a[end][at] = np.logaddexp(a[end][at], a[start][at] + logp[piece])
        return a

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts in each language, given word counts (words x languages)."""
        total = np.zeros_like(logp)
        for index, n, found in self.hits(words):
            a = self._ahead(len(index), n, found, logp)
            b = np.full_like(a, -np.inf)
            b[n] = 0.0
            for start, end, at, piece in reversed(found):
                b[start][at] = np.logaddexp(b[start][at], b[end][at] + logp[piece])
            for start, end, at, piece in found:
                share = np.exp(a[start][at] + logp[piece] + b[end][at] - a[n][at])
                np.add.at(total, piece, share * counts[index][at])
        return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logp: np.ndarray  # pieces and the unknown one x languages
    path: str = VOCABULARY


def _word_counts(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

        counts: Counter = Counter()
        for batch, texts in text_batches(batches):
            for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts):
                counts.update((lang, w) for w in words_of(text))
            if len(counts) > 300_000:
                yield flushed()
                counts.clear()
        yield flushed()

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS, path: str = VOCABULARY) -> Model:
    """Learns from rows with lang and text; at most about ``rows_per_language`` of each language are read closely."""
    usable = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    vocabulary = Pieces(path)
    logp = np.full((vocabulary.count + 1, max(1, len(languages))), -np.log(vocabulary.count))
    logp[-1] = UNKNOWN_LOGP
    if not languages:
        return Model(languages, logp, path)
    wide = 1 << 30
    least = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, rows_per_language / sizes[k]) * wide)))])
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(wide)) < least[F.col("lang")])
    words = _word_counts(sample).cache()
    for _ in range(rounds):
        logp = _maximised(words, languages, logp, path)
    words.unpersist()
    return Model(languages, logp.astype(np.float32), path)


def _maximised(words: DataFrame, languages: tuple[str, ...], logp: np.ndarray, path: str) -> np.ndarray:
    place = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = Pieces(path), np.zeros_like(logp)
        for batch in batches:
            langs, texts, n = (batch.column(i).to_pylist() for i in range(3))
            counts = np.zeros((len(texts), len(languages)))
            counts[np.arange(len(texts)), [place[k] for k in langs]] = n
            total += vocabulary.expected(texts, counts, logp)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang], pa.float64())], ["piece", "lang", "n"])

    found = words.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
    counts = np.full_like(logp, SMOOTHING)
    for r in found:
        counts[r["piece"], r["lang"]] += r["n"]
    new = np.log(counts / counts[:-1].sum(axis=0))
    new[-1] = UNKNOWN_LOGP
    return new.round(9)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.vocabulary = model, Pieces(model.path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.languages)), dtype=np.float32)

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.known) > REMEMBERED:
            self._forget()
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        split = [words_of(t) if self.model.languages and any(map(str.isalpha, t)) else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.known})
        new.sort()
        for at in range(0, len(new), AT_ONCE):
            block = new[at : at + AT_ONCE]
            self.known.update(zip(block, range(len(self.known), len(self.known) + len(block))))
            self.scores = np.concatenate([self.scores, self.vocabulary.forward(block, self.model.logp).astype(np.float32)])
        for row, words in enumerate(split):
            if words:
                total = self.scores[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                langs[row], scores[row] = self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())
        return langs, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in text_batches(batches):
            langs, scores = scorer(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, score double")


def in_known_language(docs: DataFrame, least: float = 0.5, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The documents, unchanged, whose language is found with a score of at least ``least``; fitted on their own labels."""
    model = fit(docs.filter(fold("doc_id", modulus) != held_out))
    return identify(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict = {}
