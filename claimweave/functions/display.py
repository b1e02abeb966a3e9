"""What a reader sees: names, values, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import lookup

# Dispute codes, their labels, severities and descriptions.
DISPUTES = {
    "DISPUTE_GENUINE_CONFLICT": ("Genuine conflict", "urgent", "Irreconcilable figures reported for the same metric and context across sources."),
    "DISPUTE_SIGN_MISMATCH": ("Sign mismatch (profit vs loss)", "urgent", "One document reports positive performance while another reports negative."),
    "DISPUTE_ORDER_OF_MAGNITUDE": ("Scale error (>10x discrepancy)", "urgent", "Values differ by more than an order of magnitude, likely due to scale conversion errors."),
    "DISPUTE_TEMPORAL_DRIFT": ("Different reporting period", "moderate", "Values represent different fiscal years, quarters, or balance dates."),
    "DISPUTE_UNIT_MISMATCH": ("Unit or currency mismatch", "moderate", "Figures are denominated in differing units or currencies (e.g. % vs bps, INR vs USD)."),
    "DISPUTE_SCOPE_DIFFERENCE": ("Consolidated vs Standalone boundary", "moderate", "One source reports group consolidated figures while another reports standalone entity figures."),
    "DISPUTE_ACCOUNTING_BASIS": ("Accounting basis difference", "moderate", "Discrepancy caused by accounting standard differences (e.g., GAAP vs Non-GAAP, pre-tax vs post-tax)."),
    "DISPUTE_ROUNDING": ("Rounding variance (<1%)", "neutral", "Minor variance within normal reporting rounding tolerance."),
    "AGREEMENT_EXACT": ("Exact numerical match", "neutral", "Identical canonical values verified across independent documents."),
    "AGREEMENT_APPROXIMATE": ("Approximate match", "neutral", "Values match within standard financial reporting tolerance."),
    "UNRESOLVED": ("Unresolved discrepancy", "moderate", "Reason for variance could not be definitively determined."),
    "DISPUTE_CUSTOM": ("Domain-specific dispute", "moderate", "Specific domain difference noted in audit context."),
}
# Label, severity and description without a code, and severity and description of an unknown one.
NO_CODE = ("Uncategorized", "neutral", "Dispute category not specified.")
UNKNOWN = ("moderate", "Domain dispute classification.")


def metric_name(predicate: Column) -> Column:
    return F.initcap(F.replace(predicate, F.lit("_"), F.lit(" ")))


def value_text(value: Column, unit: Column) -> Column:
    """A value with its unit, unless it names it already; a dash for no value."""
    named = F.coalesce(unit, F.lit(""))
    return F.when(value.isNull(), "—").when((named == "") | F.lower(value).contains(F.lower(named)), value).otherwise(F.concat_ws(" ", value, named))


def canonical_text(value: Column, unit: Column) -> Column:
    """A number with thousands apart and two decimals at most, and its unit; null without a number."""
    plain = F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 2), 2), r"(\.\d)0$", "$1"), r"\.0$", "")
    return F.when(value.isNotNull(), F.concat_ws(" ", plain, F.when(unit != "", unit)))


def percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def _of_code(code: Column, part: int, unknown: Column) -> Column:
    known = lookup({k: v[part] for k, v in DISPUTES.items()}, code)
    return F.when(F.coalesce(code, F.lit("")) == "", NO_CODE[part]).otherwise(F.coalesce(known, unknown))


def dispute_label(code: Column) -> Column:
    return _of_code(code, 0, F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" ")))))


def dispute_severity(code: Column) -> Column:
    return _of_code(code, 1, F.lit(UNKNOWN[0]))


def dispute_description(code: Column) -> Column:
    return _of_code(code, 2, F.lit(UNKNOWN[1]))
