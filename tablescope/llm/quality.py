"""Operator 10: quality rules, line-first cleaning.

Rules are tried on each line; lines that fail one are removed: symbols or separators in place of words, navigation,
shouting, boilerplate phrases, a short line with no closing punctuation, or a repeat of an earlier line.  Then a document is rejected
if the lines that are left hold too small a share of its words.  Before that, base measures of the whole text reject
short and self-repeating documents.

Everything is decided in one pass over the text, with no shuffle.  Defined results: null and empty texts have no words
and are rejected; lines without a word are neither tried nor counted; equal texts get equal results; an empty table
gives an empty result; other columns are ignored by ``measure`` and kept by ``cleaned``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import WORD, documents, text_batches


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    most_repeat_percent: int = 50
    #: Symbols, or doubled marks, per hundred words of a line.
    most_symbol_percent: int = 30
    #: Capitals per hundred Latin letters of a line that has at least ``shout_words`` words.
    most_capital_percent: int = 70
    shout_words: int = 4
    #: Lines of fewer words must end in closing punctuation; longer ones are prose anyway.
    open_words: int = 12
    #: Words of the document that removed lines may hold, in percent.
    most_lost_percent: int = 40


LIMITS = Limits()
SYMBOL, DOUBLED, CLOSED = r"[#*$%&|<>]", r"[!?]{2,}", r"[.!?:;…][\"')\]”»]*[\x20\x09-\x0D]*$"
#: A whole line of menu entries.
NAVIGATION = (
    r"^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|search|next|previous|back|contact|about|share|skip to content|"
    r"read more|top|sitemap|help|faq)([\x20\x09-\x0D]*[|>/»•·-]+[\x20\x09-\x0D]*[a-z0-9 ]+)*[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"(all rights reserved|terms of (use|service)|privacy policy|cookie policy|(accept|use|uses) cookies|enable javascript|"
    r"lorem ipsum|subscribe to our newsletter|click here|powered by wordpress|copyright \(c\)|©)"
)
_SYMBOL, _DOUBLED, _CLOSED, _NAVIGATION, _BOILERPLATE = map(re.compile, (SYMBOL, DOUBLED, CLOSED, NAVIGATION, BOILERPLATE))
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CAPITAL, _SMALL = re.compile("[A-Z]"), re.compile("[a-z]")
_BLANKS = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    pairs = ids[:-2] * len(numbers) + ids[1:-1]
    if len(numbers) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    inside = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        inside[at + shift] = True
    return int(inside.sum())


def line_fails(line: str, words: int, limits: Limits = LIMITS) -> bool:
    """Whether a line with so many words breaks a rule (repeats are seen by the caller)."""
    if words < limits.open_words and not _CLOSED.search(line):
        return True
    marks = len(_SYMBOL.findall(line)) + len(_DOUBLED.findall(line))
    if 100 * marks > limits.most_symbol_percent * words:
        return True
    if words >= limits.shout_words:
        capitals = len(_CAPITAL.findall(line))
        if 100 * capitals > limits.most_capital_percent * (capitals + len(_SMALL.findall(line))):
            return True
    low = line.translate(_ASCII_LOWER)
    return bool(_BOILERPLATE.search(low) or _NAVIGATION.search(low))


def read(text: str, limits: Limits = LIMITS) -> tuple[dict, list[bool]]:
    """Measures and verdict of a text; for each of its lines, whether it stays."""
    raw = text.encode("utf-8")
    words = raw.split()
    seen: set[str] = set()
    stays, duplicates, kept_words = [], 0, 0
    for line in text.split("\n"):
        size = len(line.encode("utf-8").split())
        if not size:
            stays.append(True)
        elif line in seen:
            duplicates += 1
            stays.append(False)
        else:
            seen.add(line)
            stays.append(not line_fails(line, size, limits))
            kept_words += size * stays[-1]
    repeats = repeated_words(words)
    failed = len(words) < limits.least_words or 100 * repeats > limits.most_repeat_percent * len(words)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(raw.count(b) for b in _BLANKS), "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": duplicates, "n_repeat_words": repeats, "base_failed": failed,
        "kept": not failed and 100 * (len(words) - kept_words) <= limits.most_lost_percent * len(words),
    }, stays


_KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
          "base_failed": pa.bool_(), "kept": pa.bool_()}
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every document."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = [read(t, limits)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[n] for f in found], k) for n, k in _KINDS.items())], ["doc_id", *_KINDS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, {_SCHEMA}")


def cleaned(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The kept documents without their failing lines; all columns, n_chars follows if it is there."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            rows, left = [], []
            for row, text in enumerate(texts):
                found, stays = read(text, limits)
                if found["kept"]:
                    rows.append(row)
                    left.append("\n".join(line for line, stay in zip(text.split("\n"), stays) if stay))
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = dict(zip(names, kept.columns)) | {"text": pa.array(left, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in left], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))


def _sql(limits: Limits = LIMITS) -> str:
    def count(pattern: str, of: str) -> str:
        return f"len(regexp_extract_all({of}, '{pattern}'))"

    closed, navigation, boilerplate = (p.replace("'", "''") for p in (CLOSED, NAVIGATION, BOILERPLATE))
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as place from d),
tried as (select *, {count(WORD, 'line')} as words, row_number() over (partition by doc_id, line order by place) > 1 as again,
  {count('[A-Z]', 'line')} as capitals, {count('[a-z]', 'line')} as smalls, {count(SYMBOL, 'line')} + {count(DOUBLED, 'line')} as marks
  from lines where regexp_matches(line, '{WORD}')),
judged as (select *, again or (words < {limits.open_words} and not regexp_matches(line, '{closed}')) or 100 * marks > {limits.most_symbol_percent} * words
  or (words >= {limits.shout_words} and 100 * capitals > {limits.most_capital_percent} * (capitals + smalls))
  or regexp_matches({low}, '{boilerplate}') or regexp_matches({low}, '{navigation}') as fails from tried),
by_line as (select doc_id, count(*) filter (again) as n_dup_lines, coalesce(sum(words) filter (not fails), 0) as kept_words from judged group by doc_id),
windows as (select doc_id, place, w from (select doc_id, unnest(range(1, len(ws) - 1)) as place,
  unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) as w from d where len(ws) > 2)),
twice as (select doc_id, place from windows qualify count(*) over (partition by doc_id, w) > 1),
repeats as (select doc_id, count(distinct place + s) as n_repeat_words from twice, (values (0), (1), (2)) v(s) group by doc_id),
base as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum([length(w) for w in ws]), 0) as bigint) as word_chars,
  cast({count(SYMBOL, 't')} as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(kept_words, 0) as kept_words
  from d left join by_line using (doc_id) left join repeats using (doc_id)),
failed as (select *, n_words < {limits.least_words} or 100 * n_repeat_words > {limits.most_repeat_percent} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (n_words - kept_words) <= {limits.most_lost_percent} * n_words as kept from failed"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _sql()}
