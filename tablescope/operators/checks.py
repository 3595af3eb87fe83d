"""Accounting and quality checks of reconstructed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescope import rules as R

# Tolerance of the equation, quality limits.
TOLERANCE = 0.01
GOOD_QUALITY, USABLE_QUALITY = 0.65, 0.35


def balance_equation_check(
    items: DataFrame, periods: DataFrame, doc: str = "doc_id", newest_periods: int | None = None
) -> DataFrame:
    """Assets against equity and liabilities in each period, or the newest ones.

    Per concept and period the most confident item with a value counts; amounts
    are taken without sign.
    """
    c = F.col
    names = ("total_assets", "total_equity_and_liabilities", "total_equity", "total_liabilities")
    known = items.filter(c("concept").isin(*names) & c("value").isNotNull())
    order = F.struct((-c("confidence")).alias("c"), c("line_id").alias("l"))

    def amount(concept: str) -> Column:
        return F.abs(F.min_by("value", F.when(c("concept") == concept, order))).alias(concept)

    values = known.groupBy(doc, "period").agg(*[amount(n) for n in names])
    newest = (periods if newest_periods is None else periods.filter(c("rank") <= newest_periods)).select(doc, "period")
    expected = F.coalesce(
        c("total_equity_and_liabilities"), c("total_equity") + c("total_liabilities")
    )
    rows = newest.join(values, [doc, "period"], "left").select(
        doc, "period", c("total_assets").alias("lhs"), expected.alias("rhs")
    ).withColumn("diff", c("lhs") - c("rhs"))
    tied = F.abs(c("diff")) <= F.greatest(F.lit(1.0), c("lhs") * TOLERANCE)
    status = F.when(c("diff").isNull(), "not_available").when(tied, "pass").otherwise("fail")
    return rows.select(
        doc, F.lit("balance_sheet_equation").alias("kind"), status.alias("status"), "period",
        "lhs", "rhs", "diff",
    )


def period_consistency_check(summary: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Periods found, and all primary statements present.

    ``documents`` has ``period_count``; ``summary`` is the statement summary.
    """
    c = F.col
    present = summary.filter((c("row_count") > 0) & c("statement").isin(*R.PRIMARY_KINDS)).groupBy(doc).agg(
        F.collect_set("statement").alias("_present"))
    primary = F.array(*[F.lit(k) for k in R.PRIMARY_KINDS])
    missing = F.array_except(primary, F.coalesce("_present", F.array().cast("array<string>")))
    rows = documents.join(present, doc, "left").withColumn("_missing", missing)
    status = (
        F.when(c("period_count") == 0, "fail").when(F.size("_missing") == 0, "pass").otherwise("warn")
    )
    return rows.select(
        doc, F.lit("period_consistency").alias("kind"), status.alias("status"),
        F.array_join("_missing", ", ").alias("missing"),
    )


def quality_status(confidence: Column) -> Column:
    """pass, warn or fail by confidence."""
    return (
        F.when(confidence >= GOOD_QUALITY, "pass").when(confidence >= USABLE_QUALITY, "warn").otherwise("fail")
    )


def extraction_quality_check(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Is the confidence of a document sufficient?"""
    return documents.select(
        doc, F.lit("extraction_quality").alias("kind"), quality_status(F.col("confidence")).alias("status")
    )


def document_checks(items: DataFrame, periods: DataFrame, summary: DataFrame, documents: DataFrame,
                    doc: str = "doc_id") -> DataFrame:
    """All checks of each document."""
    equation = balance_equation_check(items, periods, doc)
    others = period_consistency_check(summary, documents, doc).unionByName(
        extraction_quality_check(documents, doc), allowMissingColumns=True)
    return equation.unionByName(others, allowMissingColumns=True)
