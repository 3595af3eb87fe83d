"""Rule tables: fixed values that decide how statements are read.

Patterns are case-insensitive regular expressions, written without flags.
Callers may pass their own tables of the same shape to the operators.
"""

from __future__ import annotations

from typing import NamedTuple


class ConceptRule(NamedTuple):
    """A canonical line-item concept and the labels that mean it."""

    concept: str
    label: str
    kind: str
    priority: int
    patterns: tuple[str, ...]


class MetricRule(NamedTuple):
    """A headline metric: label patterns, best first, and statement hints."""

    label: str
    patterns: tuple[str, ...]
    hints: tuple[str, ...]


# Concept, display label, statement kind, priority, patterns.
# The highest priority wins; among equals the earlier rule.
CONCEPT_RULES: tuple[ConceptRule, ...] = (
    ConceptRule("revenue", "Revenue", "income_statement", 100,
                (r"^revenue$", r"\bsales\b", r"\bdriftsinntekter\b", r"revenue from contracts")),
    ConceptRule("cost_of_sales", "Cost of sales", "income_statement", 75,
                (r"cost of sales", r"cost of goods sold", r"varekost")),
    ConceptRule("gross_profit", "Gross profit", "income_statement", 85,
                (r"gross profit", r"bruttoresultat")),
    ConceptRule("ebitda", "EBITDA", "income_statement", 82, (r"\bebitda\b",)),
    ConceptRule("operating_profit", "Operating profit / EBIT", "income_statement", 90,
                (r"operating profit", r"operating income", r"\bebit\b", r"\bdriftsresultat\b")),
    ConceptRule("profit_before_tax", "Profit before tax", "income_statement", 88,
                (r"profit before tax", r"income before tax", r"resultat.*før skatt")),
    ConceptRule("income_tax", "Income tax expense", "income_statement", 70,
                (r"income tax", r"tax expense", r"\bskatt\b")),
    ConceptRule("net_income", "Profit for the year / net income", "income_statement", 95,
                (r"profit for the (?:year|period)", r"\bnet income\b", r"^profit\s*\(loss\)$",
                 r"\bårsresultat\b")),
    ConceptRule("total_comprehensive_income", "Total comprehensive income", "income_statement", 78,
                (r"total comprehensive income",)),
    ConceptRule("non_current_assets", "Non-current assets", "balance_sheet", 75,
                (r"non-current assets", r"non current assets", r"\banleggsmidler\b")),
    ConceptRule("current_assets", "Current assets", "balance_sheet", 75,
                (r"current assets", r"\bomløpsmidler\b")),
    ConceptRule("cash_and_cash_equivalents", "Cash and cash equivalents", "balance_sheet", 90,
                (r"cash and cash equivalents", r"^cash$", r"kontanter.*bank", r"bankinnskudd")),
    ConceptRule("trade_receivables", "Trade receivables", "balance_sheet", 65,
                (r"trade receivables", r"accounts receivable", r"kundefordringer")),
    ConceptRule("inventories", "Inventories", "balance_sheet", 65, (r"inventor", r"varelager")),
    ConceptRule("total_assets", "Total assets", "balance_sheet", 100,
                (r"^total assets$", r"\bsum eiendeler\b")),
    ConceptRule("total_equity", "Total equity", "balance_sheet", 95,
                (r"^total equity$", r"\bsum egenkapital\b")),
    ConceptRule("total_liabilities", "Total liabilities", "balance_sheet", 95,
                (r"^total liabilities$", r"\bsum gjeld\b")),
    ConceptRule("total_equity_and_liabilities", "Total equity and liabilities", "balance_sheet", 100,
                (r"total equity and liabilities", r"total liabilities and equity",
                 r"sum egenkapital.*gjeld")),
    ConceptRule("share_capital", "Share capital", "balance_sheet", 60,
                (r"share capital", r"issued capital", r"aksjekapital")),
    ConceptRule("retained_earnings", "Retained earnings", "balance_sheet", 60,
                (r"retained earnings", r"annen egenkapital")),
    ConceptRule("current_liabilities", "Current liabilities", "balance_sheet", 70,
                (r"current liabilities", r"kortsiktig gjeld")),
    ConceptRule("non_current_liabilities", "Non-current liabilities", "balance_sheet", 70,
                (r"non-current liabilities", r"non current liabilities", r"langsiktig gjeld")),
    ConceptRule("trade_payables", "Trade payables", "balance_sheet", 62,
                (r"trade payables", r"accounts payable", r"leverandørgjeld")),
    ConceptRule("borrowings", "Borrowings", "balance_sheet", 62,
                (r"borrowings", r"interest-bearing debt", r"long term debt", r"loans", r"\blån\b")),
    ConceptRule("operating_cash_flow", "Operating cash flow", "cash_flow", 95,
                (r"net cash.*operating activities", r"cash.*from.*operating", r"operating cash flow")),
    ConceptRule("investing_cash_flow", "Investing cash flow", "cash_flow", 85,
                (r"net cash.*investing activities", r"cash.*from.*investing", r"investing cash flow")),
    ConceptRule("financing_cash_flow", "Financing cash flow", "cash_flow", 85,
                (r"net cash.*financing activities", r"cash.*from.*financing", r"financing cash flow")),
    ConceptRule("net_increase_cash", "Net increase in cash", "cash_flow", 80,
                (r"net increase.*cash", r"increase.*decrease.*cash")),
    ConceptRule("cash_beginning", "Cash at beginning of period", "cash_flow", 70,
                (r"cash.*beginning", r"cash.*start")),
    ConceptRule("cash_end", "Cash at end of period", "cash_flow", 88,
                (r"cash.*end", r"cash.*closing")),
)

# Statement kinds and the heading patterns that open them, in order.
HEADING_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("income_statement", (r"consolidated income statement", r"income statement",
                          r"statement of profit or loss", r"profit and loss account",
                          r"statement of comprehensive income", r"resultatregnskap")),
    ("balance_sheet", (r"balance sheet", r"statement of financial position",
                       r"statement of financial condition", r"\bbalanse\b")),
    ("cash_flow", (r"cash flow statement", r"statement of cash flows",
                   r"kontantstrømoppstilling", r"kontantstromoppstilling")),
    ("notes", (r"notes? to the", r"^notes?$", r"accounting policies", r"note \d+")),
)

# Keywords that place a label without a concept, in order.
LABEL_KIND_RULES: tuple[tuple[str, str], ...] = (
    ("income_statement", r"revenue|sales|profit|loss|income|expense|cost|tax|ebit|resultat"),
    ("balance_sheet", r"assets?|liabilit|equity|inventory|receivable|payable|borrowings?|cash|gjeld"
                      r"|eiendeler|egenkapital"),
    ("cash_flow", r"cash flow|operating activities|investing activities|financing activities"
                  r"|kontantstrøm"),
)

# Display titles of the statement kinds.
STATEMENT_TITLES = {
    "income_statement": "Income Statement",
    "balance_sheet": "Balance Sheet",
    "cash_flow": "Cash Flow Statement",
    "notes": "Notes deferred",
    "unknown": "Unclassified / Review Needed",
}
PRIMARY_KINDS = ("income_statement", "balance_sheet", "cash_flow")

# Order of the leading key figures.
KEY_FIGURE_ORDER = (
    "revenue", "gross_profit", "operating_profit", "profit_before_tax", "net_income",
    "total_assets", "total_equity", "total_liabilities", "cash_and_cash_equivalents",
    "operating_cash_flow",
)

# Balance-sheet labels whose sign is dropped.
UNSIGNED_LABELS = r"liabilit|equity|payable|borrowings?|debt|gjeld|egenkapital"

# Headline metrics, their label patterns and statement hints.
METRIC_RULES: tuple[MetricRule, ...] = (
    MetricRule("Revenue", (r"^revenue$", r"\btotal revenue and income\b", r"revenue from contracts",
                           r"^net sales$", r"^sales revenue$"), (r"income", r"revenue")),
    MetricRule("EBITDA", (r"\bebitda\b",), (r"income", r"ebitda")),
    MetricRule("Operating income", (r"operating income", r"operating profit", r"\bebit\b"),
               (r"income",)),
    MetricRule("Profit before tax", (r"profit before tax", r"^pre-?tax profit$"), (r"income",)),
    MetricRule("Net income", (r"^net income(\s*\(loss\))?$",
                              r"^net profit(\s*(?:for the (?:year|period)|\(loss\)))?$",
                              r"profit .* period"), (r"income",)),
    MetricRule("Total assets", (r"^total assets$",), (r"balance",)),
    MetricRule("Total liabilities and equity", (r"^total liabilities and equity$",), (r"balance",)),
    MetricRule("Total equity", (r"^total equity$", r"equity to .* shareholders"),
               (r"balance", r"equity")),
    MetricRule("Cash and cash equivalents", (r"cash and cash equivalents",), (r"balance",)),
    MetricRule("Operating cash flow", (r"net cash .* operating activities",
                                       r"cash provided by operating activities"), (r"cash",)),
)
# Fixed value: labels that are poor headline metrics.
WEAK_METRIC_LABELS = r"per share|share capital|treasury shares"

# Statement type of a sheet from its name and first rows, in order.
SHEET_TYPE_RULES: tuple[tuple[str, str], ...] = (
    ("Cash flow statement", r"cash\s*flow|cash provided|cash used"),
    ("Balance sheet", r"balance sheet|total assets|liabilities and equity"),
    ("Income statement", r"income statement|net income|profit\s*\(loss\)|revenue and income"),
    ("Comprehensive income statement", r"comprehensive income"),
    ("Equity statement", r"changes? in equity|share capital|treasury shares"),
    ("Revenue note", r"revenue from contracts|external revenue|customer location"),
    ("Performance note", r"ebit|ebitda|depreciation|amortization|impairment"),
    ("Tax note", r"tax|deferred tax"),
    ("Financing note", r"debt|liabilit|cash flows from financing|financial income|derivative|hedge"),
    ("Balance sheet note", r"inventor|receivable|payable|provision|lease|goodwill|assets"),
    ("Financial note", r"pension|employee benefit|remuneration|dividend|subsidiar"),
)

# Statement type of a reported concept, in order.
CONCEPT_TYPE_RULES: tuple[tuple[str, str], ...] = (
    ("Cash flow statement", r"cash\s*flows?|cashflows?|operating\s+activities|investing\s+activities"
                            r"|financing\s+activities"),
    ("Comprehensive income statement", r"comprehensive\s+income"),
    ("Balance sheet", r"assets?|liabilit|equity|inventory|receivable|payable|debt|current|noncurrent"),
    ("Income statement", r"revenue|profit|loss|income|expense|cost|sales|ebit|tax"),
    ("Equity statement", r"share|dividend|treasury"),
)

# Statement type of a flat table from all its labels, in order.
TABLE_TYPE_RULES: tuple[tuple[str, str], ...] = (
    ("Cash flow statement", r"operating activities|investing activities|financing activities"),
    ("Balance sheet", r"total assets|liabilit|equity|receivable|payable|retained earnings"),
    ("Income statement", r"revenue|sales|gross profit|operating profit|net (?:profit|income)|ebit|tax"),
)

# Column headers of statement tables.
YEAR_HEADER = r"^(?:FY[\s_-]*)?((?:19|20)[0-9]{2})$"
LABEL_HEADER = r"(line item|account|description|name|label|metric|post|konto)"
PERIOD_HEADER = r"(period|year|date|fy|month)"
VALUE_HEADER_FIRST = r"(balance|amount|value|closing)"
VALUE_HEADER = r"(amount|balance|value|closing|debit|credit|actual|202\d|201\d)"
CLASS_HEADER = r"class|type|category"
FINANCE_KEYWORDS = (
    r"revenue|sales|income|profit|loss|ebit|tax|expense|cost|asset|liabilit|equity|cash|receivable"
    r"|payable|debt|capital|earnings|deprecia|amorti|gross|operating|dividend|inventor|reserve|\bnet\b"
)

# Fixed value: phrases that show a page holds a statement.
PAGE_SIGNALS = (
    r"(income statement|statement of financial position|balance sheet|cash flow|revenue|total assets"
    r"|profit before tax|kontantstrøm|balanse|resultatregnskap)"
)
# Fixed value: taxonomy prefixes dropped from concept names.
TAXONOMY_PREFIXES = ("ifrs-full", "us-gaap", "dei", "srt", "ecd", "esef_cor", "salmar")

# Names with an identifier part.
IDENTIFIER_NAME = (
    r"(^|[_\s-])(id|ids|uuid|guid|key|code|ref|no|num|number|hash|sku|isbn|ean)([_\s-]|$)"
)
