"""Turn rule patterns into Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

_LETTER = r"[\p{L}\p{N}_]"


def spark_regex(pattern: str) -> str:
    """Case-insensitive Java form of a rule pattern.

    ``$`` becomes an end-of-input test, and ``\\b`` next to a letter outside
    ASCII becomes an explicit test, since engines disagree on such boundaries.
    """
    out = pattern.replace("$", r"\z")
    if not out.isascii():
        parts = out.split(r"\b")
        if len(parts) == 3 and not parts[0] and not parts[2]:
            out = f"(?<!{_LETTER}){parts[1]}(?!{_LETTER})"
    return "(?iu)" + out


def required_text(pattern: str) -> str | None:
    """Longest text that every match of a pattern without alternatives holds.

    None when no text of three letters or more is certain.
    """
    plain = re.sub(r"\(\?:[^()]*\)[?*+]?|\[[^\]]*\][?*+]?|\\.[?*+]?|\{[^}]*\}", "\0", pattern)
    plain = re.sub(r".[?*]", "\0", plain)  # an optional letter is not certain
    pieces = re.split(r"[\0^$.+()|]", plain)
    longest = max(pieces, key=len).lower()
    return longest if len(longest) >= 3 else None


def needed_texts(patterns: Iterable[str]) -> list[str] | None:
    """Texts of which one is in each lower-case text that a pattern matches; None when that is not certain.

    A pattern with groups inside its alternatives, or without a certain text,
    leaves it open.
    """
    needed = set()
    for pattern in patterns:
        parts = pattern.split("|") if "(" not in pattern else [pattern]
        if "|" in re.sub(r"\(\?:[^()]*\)", "", pattern) and len(parts) == 1:
            return None
        for part in parts:
            text = required_text(part)
            if text is None:
                return None
            needed.add(text)
    return sorted(t for t in needed if not any(o != t and o in t for o in needed))


def may_match(col: Column, patterns: Iterable[str]) -> Column:
    """False only where no pattern can match: a cheap test before the patterns."""
    short = needed_texts(patterns)
    if short is None:
        return F.lit(True)
    return reduce(or_, [F.contains(F.lower(col), F.lit(t)) for t in short])


def any_match(col: Column, patterns: Iterable[str]) -> Column:
    """True when one of the patterns matches."""
    joined = "|".join(spark_regex(p)[len("(?iu)"):] for p in patterns)
    return col.rlike(f"(?iu)(?:{joined})")


def first_match(col: Column, rules: Iterable[tuple[str, str]], default: Column) -> Column:
    """Name of the first (name, pattern) rule that matches."""
    rules = list(rules)
    chosen = F.when(~may_match(col, [pattern for _, pattern in rules]), default)
    for name, pattern in rules:
        chosen = chosen.when(any_match(col, (pattern,)), name)
    return chosen.otherwise(default)


def first_match_reader(rules: Iterable[tuple[str, str]], default: str) -> Callable[[str], str]:
    """``first_match`` for plain texts, in Python.

    Both engines agree on rules without word tests and end tests, the only ones
    taken; white space is the engine's in Java.
    """
    rules = list(rules)
    odd = [pattern for _, pattern in rules if re.search(r"\\[^s]|[$.\[]", pattern)]
    if odd:
        raise ValueError(f"not read alike by both engines: {odd}")
    short = needed_texts([pattern for _, pattern in rules])
    tests = [(name, re.compile(pattern.replace(r"\s", r"[ \t\n\x0b\f\r]"), re.IGNORECASE).search) for name, pattern in rules]

    def read(text: str) -> str:
        lower = text.lower()
        if short is None or any(t in lower for t in short):
            for name, found in tests:
                if found(text):
                    return name
        return default

    return read
