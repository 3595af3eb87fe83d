"""Page texts: positioned fragments, text status, merged OCR results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescope import rules as R
from tablescope.functions.finance import statement_title
from tablescope.functions.patterns import any_match
from tablescope.functions.text import SPACE_CLASS

# Height tolerance of a line, and the gap shown as three blanks.
LINE_TOLERANCE = 3.0
WIDE_GAP = 6.0
# Fewest characters of a page with text, and messages.
MIN_PAGE_CHARS = 80
NO_TEXT = "Little or no embedded text on this page; it may be scanned or image-based."
NO_OCR_TEXT = "OCR produced no readable text for this page."
NO_DOCUMENT_TEXT = "No extractable PDF text was found."


def _placed(fragments: Column) -> Column:
    """Fragments from the top down with the number of their line.

    A fragment opens a line when it lies more than the tolerance below the
    fragment that opened the current one.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("opened"), F.lit(-1).alias("line"),
        F.array().cast("array<struct<line:int,x:double,w:double,str:string>>").alias("out"))

    def add(seen: Column, f: Column) -> Column:
        opens = seen["opened"].isNull() | (seen["opened"] + f["down"] > LINE_TOLERANCE)
        line = F.when(opens, seen["line"] + 1).otherwise(seen["line"])
        placed = F.struct(line.alias("line"), f["x"].alias("x"), f["w"].alias("w"), f["str"].alias("str"))
        return F.struct(
            F.when(opens, -f["down"]).otherwise(seen["opened"]).alias("opened"), line.alias("line"),
            F.concat(seen["out"], F.array(placed)).alias("out"))

    return F.aggregate(F.array_sort(fragments), start, add)["out"]


def _joined(placed: Column) -> Column:
    """Lines of placed fragments, from left to right, with blanks for the gaps."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("line"),
        F.lit(None).cast("double").alias("end"))

    def add(seen: Column, f: Column) -> Column:
        same, beside = seen["line"] == f["line"], seen["end"].isNotNull()
        gap = F.when(f["x"] - seen["end"] > WIDE_GAP, "   ").when(
            seen["text"].endswith(" ") | f["str"].startswith(" "), "").otherwise(" ")
        text = F.when(same & beside, F.concat(seen["text"], gap, f["str"])).otherwise(f["str"])
        done = F.when(same, seen["done"]).otherwise(F.array_append(seen["done"], seen["text"]))
        return F.struct(done.alias("done"), text.alias("text"), f["line"].alias("line"), (f["x"] + f["w"]).alias("end"))

    lines = F.aggregate(F.array_sort(placed), start, add, lambda seen: F.array_append(seen["done"], seen["text"]))
    trimmed = F.transform(lines, lambda line: F.regexp_replace(line, SPACE_CLASS + r"+\z", ""))
    return F.array_join(F.filter(trimmed, lambda line: F.regexp_replace(line, SPACE_CLASS, "") != ""), "\n")


def fragments_to_lines(fragments: DataFrame) -> DataFrame:
    """Page texts from fragments ``(doc_id, page_no, x, y, w, str)``.

    The rule is sequential within a page, so a page's fragments are gathered;
    they are bounded by what is printed on it.
    """
    shown = F.col("str").isNotNull() & ((F.regexp_replace("str", SPACE_CLASS, "") != "") | (F.col("w") > 0))
    x, y, w = (F.col(n).cast("double") for n in ("x", "y", "w"))
    piece = F.struct((-y).alias("down"), x.alias("x"), w.alias("w"), F.col("str").alias("str"))
    pages = fragments.groupBy("doc_id", "page_no").agg(F.collect_list(F.when(shown, piece)).alias("_pieces"))
    return pages.withColumn("_placed", _placed(F.col("_pieces"))).select(
        "doc_id", "page_no", _joined(F.col("_placed")).alias("text"))


def page_text_status(pages: DataFrame) -> DataFrame:
    """Add ``mode`` and ``warnings``: does a page hold enough text?"""
    packed = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_CLASS, ""))
    has_text = packed > MIN_PAGE_CHARS
    return pages.withColumn("mode", F.when(has_text, "embedded_text").otherwise("none")).withColumn(
        "warnings", F.when(has_text, F.array().cast("array<string>")).otherwise(F.array(F.lit(NO_TEXT)))
    )


def merge_ocr(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages with recognized text where there is some.

    ``results`` has one row ``(doc_id, page_no, text, confidence)`` per
    recognized page.  Useful text replaces the page's own and clears the
    warning about scans; blank text adds one.
    """
    found = results.select(
        "doc_id", "page_no", F.col("text").alias("ocr_text"), F.col("confidence").alias("_conf")
    )
    rows = pages.join(found, ["doc_id", "page_no"], "left")
    recognized = F.col("ocr_text").isNotNull()
    useful = recognized & (F.regexp_replace("ocr_text", SPACE_CLASS, "") != "")
    kept = F.filter("warnings", lambda w: ~w.rlike("(?i)scanned or image-based"))
    given = F.col("confidence") if "confidence" in pages.columns else F.lit(None).cast("double")
    others = [c for c in pages.columns if c not in ("text", "mode", "warnings", "confidence")]
    return rows.select(
        *others,
        F.when(useful, F.col("ocr_text")).otherwise(F.coalesce("text", "ocr_text", F.lit(""))).alias("text"),
        F.when(useful, "ocr").otherwise(F.col("mode")).alias("mode"),
        F.when(useful, kept).when(recognized, F.array_append("warnings", F.lit(NO_OCR_TEXT)))
        .otherwise(F.col("warnings")).alias("warnings"),
        F.when(recognized, F.col("_conf")).otherwise(given).alias("confidence"),
    )


def page_quality(text: Column, confidence: Column | None = None) -> Column:
    """Quality of a page: given confidence within limits, else from its text."""
    lines = F.size(F.filter(F.split(text, r"\r?\n"), lambda line: line.rlike(r"[^\s\x{a0}\x{feff}]")))
    estimate = F.least(
        F.lit(0.96),
        F.least(F.lit(0.5), F.length(text) / 3000) + F.least(F.lit(0.3), lines / 80)
        + F.when(any_match(text, (R.PAGE_SIGNALS,)), 0.16).otherwise(0.0),
    )
    if confidence is None:
        return estimate
    limited = F.greatest(F.lit(0.05), F.least(F.lit(0.96), confidence))
    return F.when(confidence.isNotNull(), limited).otherwise(estimate)


def document_mode(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """How each document's text was obtained, and whether OCR may help."""
    flags = pages.groupBy(doc).agg(
        F.bool_or(F.col("mode") == "embedded_text").alias("_text"),
        F.bool_or(F.col("mode") == "ocr").alias("_ocr"),
        F.bool_or(F.col("mode") == "none").alias("suggest_ocr"),
    )
    mode = (
        F.when(F.col("_text") & F.col("_ocr"), "mixed").when(F.col("_ocr"), "ocr")
        .when(F.col("_text"), "embedded_text").otherwise("none")
    )
    return flags.select(doc, mode.alias("mode"), "suggest_ocr")


def lines_as_table(raw_lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Raw lines as a plain table of text columns."""
    page = F.col("page_no") if "page_no" in raw_lines.columns else F.lit(None)
    mode = F.col("mode") if "mode" in raw_lines.columns else F.lit("embedded_text")
    return raw_lines.select(
        doc,
        F.coalesce(page.cast("string"), F.lit("")).alias("Page"),
        mode.alias("Mode"),
        statement_title(F.col("kind")).alias("Statement"),
        F.when(F.col("parsed"), "yes").otherwise("no").alias("Parsed"),
        F.round(F.col("confidence") * 100).cast("int").cast("string").alias("Confidence"),
        F.col("text").alias("Text"),
    )


def empty_documents(documents: DataFrame, table: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The row shown for documents without any line."""
    missing = documents.select(doc).distinct().join(table.select(doc).distinct(), doc, "left_anti")
    return missing.select(
        doc, F.lit("").alias("Page"), F.lit("none").alias("Mode"),
        F.lit(R.STATEMENT_TITLES["unknown"]).alias("Statement"), F.lit("no").alias("Parsed"),
        F.lit("0").alias("Confidence"), F.lit(NO_DOCUMENT_TEXT).alias("Text"),
    )


