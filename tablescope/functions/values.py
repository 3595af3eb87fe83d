"""Value parsing: numbers, booleans and dates in raw text cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tablescope.functions.text import SPACE_CHARS, trim_ws

# Currency signs that do not matter, and the words read as booleans.
CURRENCY_SIGNS = "$€£¥"
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")

# The date shapes that are accepted.
ISO_DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(\.[0-9]+)?Z?)?"
YEAR_MONTH = r"[0-9]{4}[-/](0?[1-9]|1[0-2])"
MONTH_DAY_YEAR = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}"

_SIGN = "[" + CURRENCY_SIGNS + "]*"
_DIGIT = f"[0-9]{_SIGN}"
_SIZE = (
    rf"{_SIGN}(?:[-+]{_SIGN})?(?:(?:{_DIGIT}){{1,3}}(?:,{_SIGN}(?:{_DIGIT}){{3}})+|(?:{_DIGIT})+)"
    rf"(?:\.{_SIGN}(?:{_DIGIT})+)?(?:[eE]{_SIGN}(?:[-+]{_SIGN})?(?:{_DIGIT})+)?"
)
# Grammar of a number whose white space is gone; currency signs may stand anywhere.
NUMBER_PATTERN = rf"\A(?:\([-+]?{_SIZE}\)|[-+]?{_SIZE})\z"
_SECOND_MINUS = rf"\A\(?(?:[-+]{_SIGN}|[{CURRENCY_SIGNS}]+)-"


def finite(value: Column) -> Column:
    """The value, or null when it is infinite or not a number."""
    return F.when(F.abs(value) <= 1.7976931348623157e308, value)


def packed_number(col: Column) -> Column:
    """A text cell without white space, as ``parse_packed`` reads it several times."""
    return F.translate(col, SPACE_CHARS, "")


def parse_packed(packed: Column) -> Column:
    """``parse_number`` of a text whose white space is gone."""
    size = F.ltrim(F.translate(packed, "()," + CURRENCY_SIGNS, ""), F.lit("-+")).try_cast("double")
    negated = F.left(packed, F.lit(1)).isin("(", "-") != packed.rlike(_SECOND_MINUS)
    return F.when(
        packed.rlike(NUMBER_PATTERN), finite(size) * F.when(negated, -1.0).otherwise(1.0) + 0.0
    )


def parse_number(col: Column) -> Column:
    """Read a text cell as a double, or null (F2).

    White space and currency signs do not matter; brackets or a leading minus
    negate, and a second minus negates again.
    """
    return parse_packed(packed_number(col))


_PLAIN_NUMBER = re.compile(r"-?(?:[0-9]{1,30}|[0-9]{1,3}(?:,[0-9]{3}){1,9})(?:\.[0-9]{1,30})?")


def plain_number(text: str) -> float | None:
    """``parse_number`` of a number in plain notation, in Python; None where ``parse_number`` has to read the text."""
    return float(text.replace(",", "")) + 0.0 if _PLAIN_NUMBER.fullmatch(text) else None


def parse_boolean(col: Column) -> Column:
    """Read a text cell as a boolean, or null; 0 and 1 stay numbers."""
    word = F.lower(trim_ws(col))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_date(col: Column) -> Column:
    """Read a text cell as a UTC timestamp, or null.

    Needs a session time zone of UTC.  Slash and dash dates are month first;
    two-digit years below 50 belong to the 2000s.
    """
    text = trim_ws(col)
    iso = F.regexp_replace(text, r"\A([0-9]{4})/", "$1-")
    for year, prefix in ((r"[0-9]{4}", ""), (r"[0-9]{3}", "0"), (r"[0-4][0-9]", "20"), (r"[5-9][0-9]", "19")):
        iso = F.regexp_replace(iso, rf"\A([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]({year})\z", f"{prefix}$3-$1-$2")
    shaped = text.rlike(rf"\A(?:{ISO_DATE}|{YEAR_MONTH}|{MONTH_DAY_YEAR})\z")
    return F.when(shaped, iso.try_cast("timestamp"))


def is_whole(value: Column) -> Column:
    """True when a number has no fraction."""
    return value == F.floor(value)


def infer_number_kind(whole_count: Column, number_count: Column) -> Column:
    """``integer`` when every number is whole, else ``number``."""
    return F.when(whole_count == number_count, "integer").otherwise("number")


def is_numeric_type(inferred: Column) -> Column:
    """True for the two numeric column types."""
    return inferred.isin("integer", "number")
