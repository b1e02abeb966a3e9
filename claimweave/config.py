"""Thresholds and fixed tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """What a caller may tune; the defaults give the standard results."""

    epsilon: float = 1e-4  # relative difference below which two numbers are equal
    nli_threshold: float = 0.7
    cluster_similarity: float = 0.65  # of terms, when building a graph
    pair_similarity: float = 0.55  # of terms, when comparing two documents
    damping: float = 0.15
    iterations: int = 3
    anchors: int = 10
    batch: int = 50  # clusters over this size compare anchors and chunks only
    nli_pairs: int = 10
    exact_pairs: bool = False  # compare every pair, whatever the cluster's size
    fuzzy_quote: float = 0.8
    scanned_chars: int = 20
    header_share: float = 0.6
    header_pages: int = 3
    chunk_tokens: int = 2500
    batch_tokens: int = 4500
    batch_pages: int = 8
    max_facts: int | None = None  # refuse to build a graph of more facts; None: any number


# Scale words and what they multiply by.
SCALES = {
    "hundred": 1e2,
    "thousand": 1e3,
    "k": 1e3,
    "million": 1e6,
    "mn": 1e6,
    "mln": 1e6,
    "mm": 1e6,
    "billion": 1e9,
    "bn": 1e9,
    "bln": 1e9,
    "trillion": 1e12,
    "tn": 1e12,
    "trn": 1e12,
    "lakh": 1e5,
    "lac": 1e5,
    "lakhs": 1e5,
    "lacs": 1e5,
    "crore": 1e7,
    "cr": 1e7,
    "crores": 1e7,
    "crs": 1e7,
}

# Currency signs and words.
CURRENCY_SIGNS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_WORDS = {"rs": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "usd": "USD", "us$": "USD", "eur": "EUR", "gbp": "GBP", "jpy": "JPY", "cny": "CNY", "rmb": "CNY"}

# Texts that hold one of these are dates, not numbers.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Conditions hidden in metric names, in the order of the search.
PREDICATE_CONDITIONS = (
    ("_?pre[_-]?tax", "pre-tax"),
    ("_?after[_-]?tax", "after-tax"),
    ("_?post[_-]?tax", "after-tax"),
    ("_?restated", "restated"),
    ("_?excluding[_-]?esop", "excluding ESOP"),
    ("_?proforma", "pro-forma"),
    ("_?pro[_-]?forma", "pro-forma"),
    ("_?adjusted", "adjusted"),
    ("_?unaudited", "unaudited"),
    ("_?audited", "audited"),
)

# Conditions that rule out a comparison with an unconditioned value.
ONE_SIDED = ("adjusted", "pre-tax", "after-tax", "core", "diluted", "basic", "constant currency", "pro forma", "standalone", "consolidated")

# Conditions that exclude one another.
EXCLUSIVE = (
    (("pre-tax", "pre tax"), ("after-tax", "after tax", "post-tax")),
    (("standalone",), ("consolidated",)),
    (("diluted",), ("basic",)),
    (("real", "constant prices", "constant"), ("nominal", "current prices", "current")),
    (("gross",), ("net",)),
    (("adjusted",), ("unadjusted", "standard", "as reported")),
)

# How far a kind of document is to be trusted, by words of its file name, in the order of the search.
AUTHORITY = (
    ("annual report", 0.95),
    ("audited financial", 0.95),
    ("10 k", 0.95),
    ("20 f", 0.95),
    ("registration statement", 0.95),
    ("prospectus", 0.90),
    ("offering memorandum", 0.90),
    ("drhp", 0.90),
    ("red herring", 0.90),
    ("economic survey", 0.90),
    ("central bank", 0.90),
    ("monetary policy", 0.90),
    ("article iv", 0.90),
    ("world economic outlook", 0.90),
    ("white paper", 0.85),
    ("10 q", 0.85),
    ("quarterly report", 0.85),
    ("interim report", 0.85),
    ("earnings", 0.80),
    ("investor presentation", 0.80),
    ("earnings call", 0.80),
    ("shareholder letter", 0.80),
    ("research report", 0.78),
    ("analyst report", 0.78),
    ("press release", 0.70),
    ("news release", 0.70),
    ("blog", 0.60),
    ("presentation", 0.65),
)
DEFAULT_AUTHORITY = 0.75

# Legal forms that are dropped from a company's name, in order.
LEGAL_FORMS = ("limited", "ltd", "inc", "corp", "corporation", "plc", "llc", "pvt", "private")

# Words that make a metric a rate.
RATE_WORDS = ("growth", "rate", "share", "ratio", "pct", "percentage", "change")

# Parts of a unit or value that make it money.
MONEY_HINTS = ("$", "₹", "rs", "usd", "inr", "eur", "euro", "gbp", "billion", "million", "crore", "lakh")
DIMENSIONS = ("count", "area", "ratio", "duration", "weight", "volume", "length")

# Scale words that do not belong into a base unit.
LEAKED_SCALES = ("million", "mn", "billion", "bn", "crore", "cr", "lakh", "thousand")

# Powers of ten with a name.
SCALE_NAMES = {3: "thousand", 5: "lakh", 6: "million", 7: "crore", 9: "billion", 12: "trillion"}

# What a quote's kind of match says about a fact.
CONFIDENCE = {"exact": 1.0, "normalized": 0.95, "fuzzy": 0.80}
UNVERIFIED, OTHER_MATCH = 0.10, 0.50

# Rank of a case in a listing.
CASE_ORDER = {"contradicted": 0, "reconciled_temporal": 1, "reconciled_scope": 2, "reconciled_conditions": 3, "reconciled_unit": 4, "corroborated": 5}
