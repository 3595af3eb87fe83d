"""Choose a reader for files by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.sources.delimited import read_delimited
from tablescope.sources.xml import parse_documents, read_documents

# File extensions and media types of the formats.
SHEET_EXTENSIONS = ("xlsx", "xlsm", "xlsb", "xls", "ods", "fods", "numbers")
SHEET_TYPES = (
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/vnd.ms-excel.sheet.macroEnabled.12",
    "application/vnd.ms-excel.sheet.binary.macroEnabled.12",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.apple.numbers",
    "application/x-iwork-numbers-sffnumbers",
)
XML_EXTENSIONS = ("xml", "xbrl", "xhtml")
XML_TYPES = ("application/xml", "text/xml", "application/xbrl+xml", "application/xhtml+xml")
PDF_EXTENSIONS = ("pdf",)
PDF_TYPES = ("application/pdf",)
# Formats without a decoder here: they enter as cell tables or page texts.
EXTERNAL = ("sheet", "pdf")


def file_kind(name: str, media_type: str = "") -> str:
    """Format of a file: by extension, by media type only without one; else delimited."""
    ext = name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    tests = (
        ("pdf", PDF_EXTENSIONS, PDF_TYPES), ("sheet", SHEET_EXTENSIONS, SHEET_TYPES),
        ("xml", XML_EXTENSIONS, XML_TYPES),
    )
    for kind, extensions, types in tests:
        if (ext in extensions) if ext else (media_type in types):
            return kind
    return "delimited"


def files_by_extension(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of a path by lower-case extension ('' for none); reads names, not contents."""
    names = spark.read.format("binaryFile").load(path).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("ext")
    found: dict[str, list[str]] = {}
    for row in names.select(ext, "path").collect():
        found.setdefault(row["ext"], []).append(row["path"])
    return {e: sorted(files) for e, files in sorted(found.items())}


def read_any(spark: SparkSession, path: str, media_type: str = "") -> dict[str, DataFrame]:
    """One table per extension, in any case, of the files found under a path.

    Delimited files come as rows, XML files as elements.  Workbooks and PDF
    files need a decoder outside and are refused.
    """
    tables: dict[str, DataFrame] = {}
    for ext, files in files_by_extension(spark, path).items():
        kind = file_kind(f"x.{ext}" if ext else "x", media_type)
        if kind in EXTERNAL:
            raise ValueError(f"{kind} files must be given as cells or page texts: .{ext}")
        if kind == "xml":
            tables[ext or "xml"] = parse_documents(read_documents(spark, files))
        else:
            tables[ext or "delimited"] = read_delimited(spark, files, "\t" if ext == "tsv" else None)
    return tables
