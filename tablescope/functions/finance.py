"""Financial scalars: amounts, periods, currency, labels, concepts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tablescope import rules as R
from tablescope.functions.patterns import any_match, first_match, may_match
from tablescope.functions.text import SPACE_CHARS, squeeze, squeezed, trim_ws
from tablescope.functions.values import finite, parse_number

# A year of the 1900s or 2000s, alone or after "FY".
YEAR_IN_TEXT = r"(?i)\b(?:FY\s*)?((?:19|20)[0-9]{2})\b"
YEAR_ANYWHERE = r"((?:19|20)[0-9]{2})"
YEAR_WORD = r"\b((?:19|20)[0-9]{2})\b"

# Fixed value: an amount in running text.  One amount uses one grouping sign.
AMOUNT_TOKEN = (
    r"[-−–]?\(?-?(?:[0-9]{1,3}(?:[ \x{a0}'][0-9]{3})+(?:[.,][0-9]{1,2})?(?![.,]?[0-9])"
    r"|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?(?![0-9])"
    r"|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?(?![0-9])"
    r"|[0-9]+(?:[.,][0-9]+)?)\)?"
)

# Currency codes and signs, and the four scale patterns in order.
CURRENCY_PATTERN = r"(?i)\b(?:NOK|EUR|USD|GBP|SEK|DKK)\b|[$€£]"
CURRENCY_OF_SIGN = {"$": "USD", "€": "EUR", "£": "GBP"}
SCALE_RULES = (
    ("millions", r"(?i)\b(amounts?\s+in|in)\b.{0,40}\b(million|millions|mn|m)\b"),
    ("thousands", r"(?i)\b(amounts?\s+in|in)\b.{0,40}\b(thousand|thousands|000|tusen)\b"),
    ("thousands", r"(?i)\b(?:nok|eur|usd|gbp|sek|dkk)\s*(?:'|’)?000\b"),
    ("millions", r"(?i)\b(?:nok|eur|usd|gbp|sek|dkk)\s*(?:m|mn|million)\b"),
)


def parse_financial_number(col: Column) -> Column:
    """Read an amount in US or European notation, or null.

    With both signs present the later one marks decimals.  A lone comma marks
    decimals only before one or two final digits; a lone dot before exactly
    three final digits groups thousands.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"
    packed = F.translate(col, "−–" + letters + letters.upper() + "$€£'" + SPACE_CHARS, "--")
    simple = packed.rlike(r"\A[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?\z")
    return F.when(simple, F.translate(packed, ",", "").try_cast("double")).otherwise(
        _marked_value(_mark_signs(packed))
    )


# Steps that mark what a sign in an amount means: n negative, p decimal point,
# d dropped dot, x no number.  Letters are free, as they were removed before.
_SIGN_STEPS = (
    (r"\A\(-?(.*)\)\z", "n$1"),  # brackets, also around a minus
    (r"\A-", "n"),
    (r"\A(.*,.*)\.([^,.]*)\z", "$1p$2"),  # both signs, the dot is last
    (r",(?=[^p]*p)", ""),
    (r"\.(?=[^p]*,[^.p]*\z)", "d"),  # both signs, the comma is last
    (r"\A([^,]*d[^,]*),", "$1p"),
    (r"\A([^,.d]*),([0-9]{1,2})\z", "$1p$2"),  # a lone comma before one or two digits
    (r"\A[^.d]*,[^.d]*,[0-9]{1,2}\z", "x"),
    (r",(?=[^.dp]*\z)", ""),
    (r"\A([^.p]*)\.([^.p]{0,2}|[^.p]{4,})\z", "$1p$2"),  # a lone dot, not before three digits
    (r"\.(?=[^p]*\z)", ""),
)


def _mark_signs(packed: Column) -> Column:
    for pattern, mark in _SIGN_STEPS:
        packed = F.regexp_replace(packed, pattern, mark)
    return packed


def _marked_value(marked: Column) -> Column:
    """Value of a marked amount; the marks are worked out once."""

    def value(text: Column) -> Column:
        size = finite(F.translate(text, "pdn", ".").try_cast("double"))
        signed = F.when(text.startswith("n"), F.lit(0.0) - size).otherwise(size)
        return F.when(text.rlike(r"\An?[-+]?(?:[0-9][0-9d]*p?[0-9]*|p[0-9]+)\z"), signed)

    return F.get(F.transform(F.array(marked), value), F.lit(0))


def amount_tokens(col: Column) -> Column:
    """Raw amount tokens of a text, in order."""
    return F.regexp_extract_all(col, F.lit("(" + AMOUNT_TOKEN + ")"), F.lit(1))


def text_between_tokens(col: Column) -> Column:
    """Text before, between and after the amount tokens; one piece more than tokens."""
    return F.split(col, AMOUNT_TOKEN, -1)


def number_tokens(col: Column) -> Column:
    """Amounts in a text as ``array<struct<raw, value, pos>>``; pos counts from 0."""
    pieces, raws = text_between_tokens(col), amount_tokens(col)
    empty = F.array().cast("array<struct<raw:string,value:double,pos:int>>")

    def step(state: Column, pair: Column) -> Column:
        pos = state["end"] + F.length(pair["before"])
        token = F.struct(
            pair["raw"].alias("raw"),
            parse_financial_number(pair["raw"]).alias("value"),
            pos.alias("pos"),
        )
        return F.struct(
            F.array_append(state["found"], token).alias("found"),
            (pos + F.length(pair["raw"])).alias("end"),
        )

    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(raws)),
        raws,
        lambda before, raw: F.struct(before.alias("before"), raw.alias("raw")),
    )
    start = F.struct(empty.alias("found"), F.lit(0).alias("end"))
    return F.aggregate(pairs, start, step, lambda state: state["found"])


def is_year_token(raw: Column, years: Column) -> Column:
    """True when a token is one of the given years (F8)."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.coalesce(
        digits.rlike(r"\A(?:19|20)[0-9]{2}\z") & F.array_contains(years, digits.try_cast("int")),
        F.lit(False),
    )


def years_in(col: Column) -> Column:
    """Distinct years mentioned in a text, newest first."""
    found = F.regexp_extract_all(col, F.lit(YEAR_IN_TEXT), F.lit(1))
    return F.sort_array(F.array_distinct(found).cast("array<int>"), asc=False)


def period_label(year: Column) -> Column:
    """``FY 2024`` from a year."""
    return F.concat(F.lit("FY "), year.cast("string"))


def _year_or_null(col: Column, pattern: str) -> Column:
    found = F.regexp_extract(col, pattern, 1)
    return F.when(found != "", F.concat(F.lit("FY "), found))


def period_of(col: Column) -> Column:
    """Period of the first year in a value, with no word boundary, or null."""
    return _year_or_null(col, YEAR_ANYWHERE)


def year_from_text(col: Column) -> Column:
    """Period of the first whole-word year in a text, or null (F16)."""
    return _year_or_null(col, YEAR_WORD)


def sheet_period_label(text: Column, number: Column) -> Column:
    """Period a sheet cell stands for, or null.

    A year as a number, a year alone as text, or a year beside a period word.
    """
    trimmed = trim_ws(text)
    year_number = (number == F.floor(number)) & number.between(1900, 2200)
    alone = F.regexp_extract(trimmed, r"(?i)\A(?:FY\s*)?((?:19|20)[0-9]{2})\z", 1)
    dated = year_from_text(trimmed)
    return (
        F.when(year_number, F.concat(F.lit("FY "), number.cast("long").cast("string")))
        .when(alone != "", F.concat(F.lit("FY "), alone))
        .when(trimmed.rlike("(?i)year|period|ended|december|quarter|fy"), dated)
    )


def reported_period_label(start: Column, end: Column, instant: Column) -> Column:
    """Period of a reporting context from its dates."""
    start_year = F.regexp_extract(start, YEAR_WORD, 1)
    end_year = F.regexp_extract(end, YEAR_WORD, 1)
    instant_year = F.regexp_extract(instant, YEAR_WORD, 1)
    return (
        F.when(
            (start != "") & (end != ""),
            F.when(
                (end_year != "") & (end_year == start_year), F.concat(F.lit("FY "), end_year)
            ).otherwise(F.concat(start, F.lit(" to "), end)),
        )
        .when(
            instant != "",
            F.when(instant_year != "", F.concat(F.lit("As of "), instant_year)).otherwise(instant),
        )
        .otherwise("Unspecified period")
    )


_YEAR = re.compile(YEAR_WORD)


def plain_period_label(start: str, end: str, instant: str) -> str | None:
    """``reported_period_label`` for plain texts, in Python; None where they are not ASCII.

    The engines agree on the bounds of words in ASCII only.
    """
    if not (start.isascii() and end.isascii() and instant.isascii()):
        return None
    if start and end:
        first, last = _YEAR.search(start), _YEAR.search(end)
        same = first is not None and last is not None and first[1] == last[1]
        return f"FY {last[1]}" if same else f"{start} to {end}"
    if instant:
        year = _YEAR.search(instant)
        return instant if year is None else f"As of {year[1]}"
    return "Unspecified period"


def period_year(period: Column) -> Column:
    """First four digits of a period as an integer, or null."""
    return F.regexp_extract(period, "([0-9]{4})", 1).try_cast("int")


def currency_of(col: Column) -> Column:
    """First currency code or sign in a text, as a code, or null."""
    found = F.regexp_extract(col, "(" + CURRENCY_PATTERN + ")", 1)
    chosen = F.when(found == "", None)
    for sign, code in CURRENCY_OF_SIGN.items():
        chosen = chosen.when(found == sign, code)
    return chosen.otherwise(F.upper(found))


def scale_of(col: Column) -> Column:
    """``millions``, ``thousands`` or ``unknown``."""
    chosen = F.when(col.rlike(SCALE_RULES[0][1]), SCALE_RULES[0][0])
    for name, pattern in SCALE_RULES[1:]:
        chosen = chosen.when(col.rlike(pattern), name)
    return chosen.otherwise("unknown")


def currency_scale(col: Column) -> Column:
    """``struct<currency, scale, confidence>`` detected in a text."""
    currency, scale = currency_of(col), scale_of(col)
    confidence = F.when(currency.isNotNull(), 0.45).otherwise(0.0) + F.when(
        scale != "unknown", 0.45
    ).otherwise(0.0)
    return F.struct(
        currency.alias("currency"), scale.alias("scale"), confidence.alias("confidence")
    )


def unit_of(col: Column) -> Column:
    """Unit named after ``amounts in``, or null."""
    found = F.regexp_extract(trim_ws(col), r"(?i)amounts?\s+in\s+([^.;]+)", 1)
    cut = F.regexp_replace(F.regexp_replace(found, r"(?s)\s*\(.*\z", ""), r"(?is)\s+except.*\z", "")
    return F.when(found != "", trim_ws(cut))


def clean_label(col: Column) -> Column:
    """Label without note numbers, extra blanks and trailing punctuation."""
    bare = F.regexp_replace(col, r"(?i)\bnote\s+[0-9]+\b", "")
    return trim_ws(F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"[.\-:;,\s]+\z", ""))


def signed_value(value: Column, label: Column, kind: Column) -> Column:
    """Amount without sign for liabilities and equity of a balance sheet."""
    unsigned = (kind == "balance_sheet") & any_match(label, (R.UNSIGNED_LABELS,))
    return F.when(unsigned, F.abs(value)).otherwise(value)


def concept_local_name(col: Column) -> Column:
    """Concept without document, path and taxonomy prefix."""
    anchor = F.element_at(F.split(col, "#"), -1)
    last = F.element_at(F.split(anchor, "/"), -1)
    name = F.regexp_replace(last, r"\A[^:]*:", "")
    prefixes = "|".join(R.TAXONOMY_PREFIXES)
    return F.regexp_replace(name, rf"(?i)\A(?:{prefixes})_(?=.)", "")


def humanize_concept(col: Column) -> Column:
    """Words of a concept name, split at case changes."""
    words = F.regexp_replace(concept_local_name(col), "[_-]+", " ")
    words = F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1 $2")
    return squeeze(F.regexp_replace(words, "([A-Z]+)([A-Z][a-z])", "$1 $2"))


_LINE_END = "\n\r\x85\u2028\u2029"
_TAXONOMY = re.compile(rf"\A(?:{'|'.join(R.TAXONOMY_PREFIXES)})_(?=[^{_LINE_END}])", re.IGNORECASE | re.ASCII)
_DASHES, _LOWER_UPPER, _UPPER_WORD = (re.compile(p) for p in ("[_-]+", "([a-z0-9])([A-Z])", "([A-Z]+)([A-Z][a-z])"))


def concept_words(concept: str) -> str:
    """``humanize_concept`` for a plain text, in Python."""
    name = concept.rpartition("#")[2].rpartition("/")[2]
    name = _TAXONOMY.sub("", name.partition(":")[2] if ":" in name else name, count=1)
    words = _LOWER_UPPER.sub(r"\1 \2", _DASHES.sub(" ", name))
    return squeezed(_UPPER_WORD.sub(r"\1 \2", words))


def short_uri(col: Column) -> Column:
    """Last segment of a URI in words."""
    last = F.regexp_extract(col, r"([^/#]+)[/#]*\z", 1)
    words = humanize_concept(last)
    return F.when(words != "", words).when(last != "", last).otherwise(col)


def scaled_number(number: Column, scale: Column, sign: Column) -> Column:
    """Amount times ten to the scale; a ``-`` sign makes it negative."""
    exponent = F.coalesce(trim_ws(scale).try_cast("double"), F.lit(0.0))
    scaled = number * F.pow(F.lit(10.0), exponent)
    return F.when(trim_ws(sign) == "-", -F.abs(scaled)).otherwise(scaled)


def scaled_fact_value(text: Column, scale: Column, sign: Column) -> Column:
    """Reported amount of a text, scaled and signed."""
    return scaled_number(parse_number(text), scale, sign)


def signed_change(current: Column, prior: Column) -> Column:
    """``struct<change, change_pct>``; the percentage is null when prior is 0."""
    change = current - prior
    return F.struct(
        change.alias("change"),
        F.try_divide(change, F.abs(prior)).__mul__(100.0).alias("change_pct"),
    )


def _by_priority(rules: Sequence[R.ConceptRule]) -> list[R.ConceptRule]:
    return sorted(rules, key=lambda r: -r.priority)


def classify_concept(label: Column, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES) -> Column:
    """Concept of a label, or null.

    Rules become one CASE in order of priority, so the work stays in the scan:
    no join on labels, where a common label would be a hot key.  A search for
    plain texts spares the patterns where none can match.
    """
    chosen = None
    for rule in _by_priority(rules):
        hit = any_match(label, rule.patterns)
        chosen = F.when(hit, rule.concept) if chosen is None else chosen.when(hit, rule.concept)
    return F.when(may_match(label, [p for r in rules for p in r.patterns]), chosen)


def _lookup(key: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    entries = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def concept_kind(concept: Column, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES) -> Column:
    """Statement kind of a concept, or null."""
    return _lookup(concept, [(r.concept, r.kind) for r in rules])


def canonical_label(concept: Column, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES) -> Column:
    """Display label of a concept; an unknown concept stays as it is."""
    return F.coalesce(_lookup(concept, [(r.concept, r.label) for r in rules]), concept)


def statement_title(kind: Column) -> Column:
    """Display title of a statement kind."""
    return _lookup(kind, list(R.STATEMENT_TITLES.items()))


def heading_kind(text: Column) -> Column:
    """Statement kind a heading opens, or null."""
    chosen = None
    for kind, patterns in R.HEADING_RULES:
        hit = any_match(text, patterns)
        chosen = F.when(hit, kind) if chosen is None else chosen.when(hit, kind)
    return F.when(may_match(text, [p for _, patterns in R.HEADING_RULES for p in patterns]), chosen)


def label_kind(label: Column, rules: Sequence[R.ConceptRule] = R.CONCEPT_RULES) -> Column:
    """Statement kind of a label: its concept's, else by keyword (D3)."""
    by_keyword = first_match(label, R.LABEL_KIND_RULES, F.lit("unknown"))
    return F.coalesce(concept_kind(classify_concept(label, rules), rules), by_keyword)
