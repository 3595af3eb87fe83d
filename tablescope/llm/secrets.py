"""Operator 4: secret scans over a trigram inverted index.

Each rule is a regular expression.  ``trigram_query`` derives from its syntax tree a Boolean query over
trigrams that every match must contain.  The documents of one Arrow batch form an index shard: postings
(trigram -> rows) of the trigrams that occur in any query.  Queries intersect and unite postings; only the rows
that are left are verified by the expression itself.  Rules without a mandatory trigram scan every row.
Shards need no shuffle, and a lost task rebuilds its own.

Defined results: null and empty texts have no spans; a repeated row is scanned like any other; an empty table
gives an empty result; other columns are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, text_batches


def either_case(word: str) -> str:
    """Pattern for an ASCII word with letters in either case (no Unicode folding)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
_BREAK, _END_OF_TOKEN = r"(?:\s|\\[nr])", r"(?![^\s\\\"',])"
#: A whole key: its header, header fields, and base64 up to END or, without END, to the last line of base64.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*\n[A-Za-z][A-Za-z-]*: [^\n]*)*"
    rf"(?:(?:[A-Za-z0-9+/=]|{_BREAK})*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BREAK}+[A-Za-z0-9+/]{{16,}}={{0,2}}{_END_OF_TOKEN})+(?:{_BREAK}[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:\n|\\|\Z)))?"
    rf"|)"
)
#: Published token formats beyond the base kinds.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES

# Boolean queries: ("all",), ("tri", code), ("and", queries), ("or", queries) ------------------------------

ALL = ("all",)
_MOST_STRINGS = 64


def _both(kind: str, parts: list) -> tuple:
    if kind == "or" and ALL in parts:
        return ALL
    kept = list(dict.fromkeys(p for p in parts if p != ALL))
    if not kept:
        return ALL
    return kept[0] if len(kept) == 1 else (kind, tuple(kept))


def _codes(text: str) -> list[int]:
    raw = text.encode("utf-8")
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


def _contains_one(strings: set[str]) -> tuple:
    """Query for texts that hold one of the strings; ALL if one of them is too short to tell."""
    return _both("or", [_both("and", [("tri", c) for c in _codes(s)]) for s in sorted(strings)]) if strings else ALL


class _Sequence:
    """Reads a concatenation: ``strings`` is what the run of exactly known pieces up to here can spell."""

    def __init__(self) -> None:
        self.strings: set[str] | None = {""}
        self.queries: list = []

    def exact(self, strings: set[str]) -> None:
        joined = {a + b for a in self.strings for b in strings}
        if len(joined) > _MOST_STRINGS:
            self.flush()
            joined = strings
        self.strings = joined

    def flush(self) -> None:
        self.queries.append(_contains_one(self.strings))
        self.strings = {""}


def _characters(items: list) -> set[str] | None:
    """Members of a small character class, lower-cased; None if it is large or negated."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 16:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 16 else None


def _read(tree, into: _Sequence) -> bool:
    """Adds a parsed pattern to a sequence; True if it is known exactly."""
    whole = True
    for op, value in tree:
        if op is sre.LITERAL:
            into.exact({chr(value).lower()})
        elif op is sre.IN and (members := _characters(value)) is not None:
            into.exact(members)
        elif op is sre.SUBPATTERN:
            whole &= _read(value[3], into)
        elif op is sre.BRANCH:
            parts = [_Sequence() for _ in value[1]]
            known = [_read(branch, part) for branch, part in zip(value[1], parts)]
            if all(known) and all(not p.queries for p in parts):
                into.exact(set().union(*(p.strings for p in parts)))
            else:
                into.flush()
                for p in parts:
                    p.flush()
                into.queries.append(_both("or", [_both("and", p.queries) for p in parts]))
                whole = False
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            part = _Sequence()
            known = _read(body, part) and not part.queries
            if known and low == high and low <= 8:
                for _ in range(low):
                    into.exact(part.strings)
            elif known and low == 0 and high == 1:
                into.exact(part.strings | {""})
            else:
                if low > 0 and known:
                    into.exact(part.strings)
                into.flush()
                if low > 0:
                    part.flush()
                    into.queries.append(_both("and", part.queries))
                whole = False
        elif op is sre.AT:
            pass
        else:
            into.flush()
            whole = False
    return whole


def trigram_query(pattern: str) -> tuple:
    """Boolean query over lower-cased trigrams that every text with a match satisfies."""
    sequence = _Sequence()
    _read(sre_parser.parse(pattern), sequence)
    sequence.flush()
    return _both("and", sequence.queries)


def _trigrams(query: tuple) -> set[int]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*map(_trigrams, query[1])) if len(query) > 1 else set()


def _answer(query: tuple, postings: dict[int, np.ndarray], rows: np.ndarray) -> np.ndarray:
    if query[0] == "all":
        return rows
    if query[0] == "tri":
        return postings.get(query[1], rows[:0])
    parts = [_answer(q, postings, rows) for q in query[1]]
    result = parts[0]
    for part in parts[1:]:
        result = np.intersect1d(result, part, True) if query[0] == "and" else np.union1d(result, part)
    return result


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Shard:
    """Postings of the wanted trigrams over the texts of one batch."""

    def __init__(self, texts: list[str], wanted: np.ndarray) -> None:
        raw = [t.encode("utf-8") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        joined = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
        self.rows = np.arange(len(texts))
        first = np.zeros(256, dtype=bool)
        first[wanted >> 16] = True
        at = np.flatnonzero(first[joined[:-2]]) if len(joined) > 2 else np.empty(0, dtype=np.int64)
        code = joined[at].astype(np.int32) << 16 | joined[at + 1].astype(np.int32) << 8 | joined[at + 2]
        hit = np.isin(code, wanted)
        code, at = code[hit], at[hit]
        pairs = np.unique(np.stack([code, np.searchsorted(ends, at, side="right")]), axis=1) if len(at) else np.empty((2, 0), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(pairs[0])) + 1
        self.postings = {int(c[0]): r for c, r in zip(np.split(pairs[0], cuts), np.split(pairs[1], cuts)) if len(c)}

    def candidates(self, query: tuple) -> np.ndarray:
        return _answer(query, self.postings, self.rows)


def _finder(rule: Rule) -> tuple[re.Pattern, int, int]:
    """A lone repeated class with a least length only matches runs, so the length can go into the pattern."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]\\^]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}"), 0, 0
    return re.compile(rule.pattern), rule.group, rule.least


def _scan(texts: list[str], rules: tuple[Rule, ...], finders: list, queries: list, wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end) in order."""
    shard = Shard(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (finder, group, least) in enumerate(finders):
        for row in shard.candidates(queries[k]).tolist():
            for m in finder.finditer(texts[row]):
                if m.end(group) - m.start(group) >= least:
                    found[row].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def _ready(rules: tuple[Rule, ...]) -> tuple[list, list, np.ndarray]:
    queries = [trigram_query(r.pattern) for r in rules]
    return [_finder(r) for r in rules], queries, np.array(sorted(set().union(*map(_trigrams, queries))), dtype=np.int32)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end), code points, end exclusive, by start and order of the rules."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, queries, wanted = _ready(rules)
        for batch, texts in text_batches(batches):
            found = _scan(texts, rules, finders, queries, wanted)
            spans = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in row] for row in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each span (overlapping ones as one) is replaced, and n_chars follows if it is there."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, queries, wanted = _ready(rules)
        for batch, texts in text_batches(batches):
            columns = dict(zip(names, batch.columns))
            given = columns["text"].to_pylist()
            for row, spans in enumerate(_scan(texts, rules, finders, queries, wanted)):
                if not spans:
                    continue
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [texts[row][at:start], mark]
                    at = max(at, end)
                given[row] = "".join([*parts, texts[row][at:]])
            changed = pa.array(given, pa.string())
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in given]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            columns["text"] = changed
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


# Query -------------------------------------------------------------------------------------------------


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in BASE_RULES])
    return found.select("doc_id", *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Matches and the text between them give the places: both lists come from the same leftmost matches.

    Whole private keys are beyond DuckDB's patterns, which cannot look ahead; tests check them by themselves.
    """
    parts = []
    for k, r in enumerate(RULES):
        if r.kind == "private_key":
            continue
        pattern = r.pattern.replace("'", "''")
        length = f"length(regexp_extract(m, '{pattern}', {r.group}))" if r.group else "length(m)"
        parts.append(f"""
select doc_id, {k} as k, '{r.kind}' as kind, unnest(s) as s, unnest(e) as e, unnest(ok) as ok from (
 select doc_id, [{length} >= {r.least} for m in ms] as ok,
        [list_sum([length(p) for p in ps[1:i]]) + coalesce(list_sum([length(m) for m in ms[1:i-1]]), 0) for i in range(1, len(ms) + 1)] as s,
        [list_sum([length(p) for p in ps[1:i]]) + list_sum([length(m) for m in ms[1:i]]) for i in range(1, len(ms) + 1)] as e
 from (select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps
       from (select doc_id, coalesce(text, '') as t from documents)) where len(ms) > 0)""")
    count = ", ".join(f"coalesce(count(*) filter (kind = '{r.kind}'), 0) as n_{r.kind}" for r in BASE_RULES)
    one = "kind || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    return f"""
with spans as (select * from ({' union all '.join(parts)}) where ok),
per as (select doc_id, {count}, string_agg({one}, ',' order by s, k) filter (k < {len(BASE_RULES)}) as b,
               string_agg({one}, ',' order by s, k) as a from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from documents d left join per on per.doc_id = d.doc_id"""


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES = {"op4_secret_scan": _sql()}
