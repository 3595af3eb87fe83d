"""Operator 12: SentencePiece encoding and decoding for merge-type vocabularies.

A text starts as single characters, blanks written as a visible mark and one mark put in front.  An agenda holds the
adjacent pairs whose joined string is a piece, best score first and leftmost among equals; the top pair is joined, and
its new neighbours enter the agenda.  Characters without a piece become byte pieces.  In every Arrow batch the
sentencepiece library encodes each span that is new to the worker and decodes all ids; ``agrees`` says whether it has
the same ids for all spans of a text and the same decoded text.

Texts fall into spans that no piece crosses: between a mark and a character before it, and around characters that are
in no longer piece.  Joins in one span never touch another, so that spans are encoded by themselves, and frequent ones
are remembered (about ``REMEMBERED`` a worker; a span of any length is encoded whole).  The rule is derived from the
vocabulary, which is refused if it breaks it; tests compare whole texts with the library.

Defined results: null texts are empty, and an empty text has the end id alone; equal texts get equal results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, text_batches

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Spans that a worker remembers before it starts anew; spans up to ``SHORT`` characters are encoded many at once.
MARK, REMEMBERED, SHORT = "▁", 1 << 19, 32


def _without(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The table without one column of each row."""
    return table[np.arange(table.shape[1]) != at[:, None]].reshape(len(table), -1)


class Remembered(dict):
    """Numbers of spans; ``ids`` has what each stands for, and ``new`` the spans whose ids are still to be found."""

    def __init__(self) -> None:
        super().__init__()
        self.ids: list[tuple[int, ...]] = []
        self.new: list[str] = []

    def __missing__(self, span: str) -> int:
        self[span] = number = len(self.ids)
        self.ids.append(())
        self.new.append(span)
        return number


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that is not UTF-8 becomes a replacement character of its own."""
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Vocabulary:
    """Pieces of a model file of the merge type, with byte pieces for everything else."""

    def __init__(self, path: str = MODEL, check: bool = True) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trained, normal, kinds = model.trainer_spec, model.normalizer_spec, proto.ModelProto.SentencePiece
        if trained.model_type != proto.TrainerSpec.BPE or not trained.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError(f"{path} is not a merge-type vocabulary with byte pieces and plain normalization.")
        if not normal.add_dummy_prefix or not normal.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path} does not mark the blanks in front of words.")
        self.ids: dict[str, int] = {}
        #: Minus the score, so that the best pair is the least.
        self.costs: dict[str, float] = {}
        self.byte_ids = [0] * 256
        #: What each id stands for; ids whose blank in front is their own, and control ids.
        self.surfaces: list[bytes] = []
        self.raw: set[int] = set()
        self.control: set[int] = set()
        for number, piece in enumerate(model.pieces):
            surface = b""
            if piece.type == kinds.NORMAL:
                self.ids[piece.piece], self.costs[piece.piece] = number, -piece.score
                surface = piece.piece.replace(MARK, " ").encode()
            elif piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_ids[value], surface = number, bytes([value])
                self.raw.add(number)
            elif piece.type == kinds.UNKNOWN:
                surface = trained.unk_surface.encode()
                self.raw.add(number)
            elif piece.type == kinds.CONTROL:
                self.control.add(number)
            else:
                raise ValueError(f"{path} has pieces of a kind that is not read here.")
            self.surfaces.append(surface)
        self.end = trained.eos_id
        longer = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError(f"{path} has pieces that go on behind a blank.")
        inner = "".join(sorted(set("".join(longer)) - {MARK}))
        inside = f"[{re.escape(inner)}]"
        self.spans = re.compile(f"{MARK}+{inside}*|{inside}+|.", re.DOTALL)
        self.known, self.differs = Remembered(), set()
        normal.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString()) if check else None
        singles = [p for p in self.ids if len(p) == 1]
        self.plain = re.compile(f"[{re.escape(''.join(singles))}]*")
        self.of_char = np.zeros(0x110000, dtype=np.int32)
        for char in singles:
            self.of_char[ord(char)] = self.ids[char]
        #: Pairs of pieces that join to a piece, as left id * size + right id; the last entry is for all other pairs.
        self.size = len(model.pieces)
        halves = [(self.ids.get(p[:k]), self.ids.get(p[k:]), p) for p in longer for k in range(1, len(p))]
        joins = [(a * self.size + b, self.ids[p], self.costs[p]) for a, b, p in halves if a is not None and b is not None]
        self.pairs = pd.Index(np.array([j[0] for j in joins], dtype=np.int64))
        self.pair_ids = np.array([*(j[1] for j in joins), -1], dtype=np.int32)
        self.pair_costs = np.array([*(j[2] for j in joins), np.inf], dtype=np.float32)

    def joined_alike(self, spans: list[str]) -> list[list[int]]:
        """The ids that the agenda leaves of spans of one length whose characters are all pieces.

        Each span has an agenda of one cost for each adjacent pair, and all spans take their best pair at once.
        """
        rows = np.frombuffer("".join(spans).encode("utf-32-le"), dtype="<u4").reshape(len(spans), -1)
        symbols = self.of_char[rows]
        costs = self._cost(symbols[:, :-1], symbols[:, 1:])
        left: list[list[int]] = [[]] * len(spans)
        of = np.arange(len(spans))
        while len(of):
            # A column less each round: spans without a joinable pair are done, all others join one.
            if costs.shape[1]:
                best = costs.argmin(axis=1)
                done = costs[np.arange(len(of)), best] == np.inf
            else:
                best, done = np.zeros(len(of), dtype=np.int64), np.ones(len(of), dtype=bool)
            for k, ids in zip(of[done].tolist(), symbols[done].tolist()):
                left[k] = ids
            of, symbols, costs, best = of[~done], symbols[~done], costs[~done], best[~done]
            if not len(of):
                break
            at = np.arange(len(of))
            pairs = self._pair(symbols[at, best], symbols[at, best + 1])
            symbols = _without(symbols, best + 1)
            symbols[at, best] = self.pair_ids[self.pairs.get_indexer(pairs)]
            costs = _without(costs, best)
            before, behind = best > 0, best < costs.shape[1]
            costs[at[before], best[before] - 1] = self._cost(symbols[at[before], best[before] - 1], symbols[at[before], best[before]])
            costs[at[behind], best[behind]] = self._cost(symbols[at[behind], best[behind]], symbols[at[behind], best[behind] + 1])
        return left

    def _cost(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pair_costs[self.pairs.get_indexer(self._pair(left, right).ravel())].reshape(left.shape)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) * self.size + right

    def joined(self, span: str) -> list[str]:
        """The pieces that the agenda leaves of any span: a heap; pairs of which one side has been joined meanwhile are passed over."""
        size = len(span)
        pieces, before, after = list(span), list(range(-1, size - 1)), list(range(1, size + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            whole = pieces[left] + pieces[right]
            if (cost := self.costs.get(whole)) is not None:
                heapq.heappush(agenda, (cost, left, right, len(whole)))

        for left in range(size - 1):
            propose(left, left + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            if not pieces[left] or not pieces[right] or len(pieces[left]) + len(pieces[right]) != length:
                continue
            pieces[left] += pieces[right]
            pieces[right] = ""
            after[left] = last = after[right]
            if last < size:
                before[last] = left
                propose(left, last)
            if before[left] >= 0:
                propose(before[left], left)
        return [p for p in pieces if p]

    def span_ids(self, span: str) -> list[int]:
        ids: list[int] = []
        for piece in self.joined(span):
            number = self.ids.get(piece)
            ids += [number] if number is not None else [self.byte_ids[b] for b in piece.encode()]
        return ids

    def spans_of(self, texts: list[str]) -> list[list[int]]:
        """The numbers of every text's spans; the ids of new spans are found and compared with the library's."""
        if len(self.known) > REMEMBERED:
            self.known, self.differs = Remembered(), set()
        known, recall = self.known, self.known.__getitem__
        found = [list(map(recall, self.spans.findall(MARK + t.replace(" ", MARK)))) if t else [] for t in texts]
        alike: dict[int, list[str]] = {}
        for span in known.new:
            if len(span) <= SHORT and self.plain.fullmatch(span):
                alike.setdefault(len(span), []).append(span)
            else:
                known.ids[known[span]] = tuple(self.span_ids(span))
        for spans in alike.values():
            for span, ids in zip(spans, self.joined_alike(spans)):
                known.ids[known[span]] = tuple(ids)
        if self.library and known.new:
            theirs = self.library.encode([span.replace(MARK, " ") for span in known.new], num_threads=1)
            self.differs.update(known[span] for span, ids in zip(known.new, theirs) if known.ids[known[span]] != tuple(ids))
        known.new.clear()
        return found

    def ids_of(self, found: list[list[int]], end: bool = True) -> list[list[int]]:
        """The ids of texts from the numbers of their spans."""
        recall, tail = self.known.ids.__getitem__, [self.end] if end else []
        return [[*itertools.chain.from_iterable(map(recall, spans)), *tail] for spans in found]

    def encode(self, texts: list[str], end: bool = True) -> list[list[int]]:
        return self.ids_of(self.spans_of(texts), end)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of some ids: the blank put in front goes, control ids say nothing and end a run of byte pieces."""
        while len(ids) and ids[-1] in self.control:
            ids = ids[:-1]
        runs: list[list[bytes]] = [[]]
        if self.control.isdisjoint(ids):
            runs = [list(map(self.surfaces.__getitem__, ids))]
        else:
            for number in ids:
                if number in self.control:
                    runs.append([])
                else:
                    runs[-1].append(self.surfaces[number])
        text = "".join(b"".join(run).decode("utf-8", "each_byte") for run in runs)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first not in self.raw and self.surfaces[first].startswith(b" ") else text


@functools.lru_cache(maxsize=1)
def vocabulary(path: str, check: bool = True) -> Vocabulary:
    """One vocabulary, with the spans it remembers, for all tasks of a worker."""
    return Vocabulary(path, check)


def encoded(docs: DataFrame, path: str = MODEL, end: bool = True, check: bool = True) -> DataFrame:
    """doc_id, ids and decoded of every document, and agrees: the library has the same (null if not checked)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        own, library = vocabulary(path, check), SentencePieceProcessor(model_file=path) if check else None
        for batch, texts in text_batches(batches, 1_000_000):
            spans = own.spans_of(texts)
            ids = own.ids_of(spans, end)
            texts_again = [own.decode(i) for i in ids]
            agrees = [None] * len(ids)
            if library:
                agrees = [own.differs.isdisjoint(s) and d == t for s, d, t in zip(spans, texts_again, library.decode(ids, num_threads=1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts_again, pa.string()), pa.array(agrees, pa.bool_())],
                ["doc_id", "ids", "decoded", "agrees"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of ``tokens`` (ids array<int>) with their text as ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(i or []) for i in ids], pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema.fields)}, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text they give again."""
    found = encoded(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
ORACLES: dict = {}
