"""Text helpers: trimming, squeezing, missing-value test, display formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters that count as white space when trimming.
SPACE_CHARS = (
    " \t\n\u000b\u000c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a regular-expression class (Java and RE2 syntax).
SPACE_CLASS = (
    r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
# Tokens, compared in lower case, that stand for a missing cell.
MISSING_TOKENS = ("", "na", "n/a", "null", "nil", "nan", "-", "--")
# Fixed value: label of the group of missing cells.
EMPTY_LABEL = "(empty)"


def trim_ws(col: Column) -> Column:
    """Trim all Unicode white space, also no-break spaces."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def squeeze(col: Column) -> Column:
    """Replace each run of white space by one blank and trim."""
    return F.btrim(F.regexp_replace(col, SPACE_CLASS + "+", " "), F.lit(" "))


_SPACE_RUN = re.compile(f"[{re.escape(SPACE_CHARS)}]+")


def squeezed(text: str) -> str:
    """``squeeze`` for a plain text, in Python."""
    return _SPACE_RUN.sub(" ", text).strip(" ")


def truncate(col: Column, limit: int) -> Column:
    """Cut text to ``limit`` characters, the last three being dots."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.substring(col, 1, limit - 3), F.lit("..."))
    )


def is_missing(col: Column) -> Column:
    """True for null and for the missing-value tokens (F1)."""
    return F.coalesce(F.lower(trim_ws(col)).isin(*MISSING_TOKENS), F.lit(True))


def dim_key(col: Column) -> Column:
    """Grouping key of a text cell: trimmed value, or ``(empty)``."""
    return F.when(is_missing(col), EMPTY_LABEL).otherwise(trim_ws(col))


def normalize_header_text(col: Column) -> Column:
    """Lower-case a header and turn other characters into blanks."""
    return F.regexp_replace(F.lower(trim_ws(col)), "[^a-z0-9]+", " ")


def split_lines(col: Column) -> Column:
    """Array of the non-blank lines of a text, white space squeezed."""
    lines = F.transform(F.split(col, r"\r?\n"), squeeze)
    return F.filter(lines, lambda line: line != "")


def format_int(col: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.round(col), 0)


def format_decimal(col: Column, digits: int) -> Column:
    """Number with thousands separators and at most ``digits`` decimals."""
    text = F.format_number(F.round(col, digits), digits)
    return F.regexp_replace(text, r"\.?0+\z", "") if digits else text


def format_percent(col: Column) -> Column:
    """Percentage with at most one decimal."""
    return F.concat(format_decimal(col, 1), F.lit("%"))


def title_from_name(col: Column) -> Column:
    """Report title from a file name.

    The extension goes, ``_`` and ``-`` become blanks, and words start with a
    capital unless they are short (up to three letters) and all lower case.
    """
    base = trim_ws(F.regexp_replace(F.regexp_replace(col, r"\.[^.]+\z", ""), "[_-]+", " "))
    words = F.transform(
        F.split(base, r"\s+"),
        lambda w: F.when((F.length(w) <= 3) & (w == F.lower(w)), w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
        ),
    )
    return F.when(base == "", "Untitled report").otherwise(F.array_join(words, " "))


def describe_span(days: Column) -> Column:
    """Words for a length of time in days; empty when it is negative."""
    return (
        F.when(days < 0, "")
        .when(days == 0, "a single point in time")
        .when(days < 45, F.concat(F.lit("about "), days.cast("long").cast("string"), F.lit(" days")))
        .when(
            days < 730,
            F.concat(F.lit("about "), F.floor(days / 30 + 0.5).cast("string"), F.lit(" months")),
        )
        .otherwise(
            F.concat(F.lit("about "), F.format_string("%.1f", F.round(days / 365, 1)), F.lit(" years"))
        )
    )


def bin_label(start: Column, end: Column) -> Column:
    """Label of a histogram bin: up to one decimal for whole or large bounds,
    else up to two (F28)."""

    def bound(x: Column) -> Column:
        coarse = (F.abs(x) >= 1000) | (x == F.floor(x))
        return F.when(coarse, format_decimal(x, 1)).otherwise(format_decimal(x, 2))

    return F.concat(bound(start), F.lit(" – "), bound(end))
