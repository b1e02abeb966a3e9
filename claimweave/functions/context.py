"""Periods, conditions, subjects, metrics, dimensions and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AUTHORITY, DEFAULT_AUTHORITY, DIMENSIONS, EXCLUSIVE, LEGAL_FORMS, MONEY_HINTS, ONE_SIDED, PREDICATE_CONDITIONS, RATE_WORDS
from .numeric import blank_to_null, strip

SPAN = r"\b(?:fy\s*)?(\d{4})[-/](\d{2,4})\b"
SHORT_YEAR = r"\bfy\s*(\d{2})\b"
LONG_YEAR = r"\bfy\s*(\d{4})\b"
PART = r"\b(q[1-4]|h[1-2])\b"


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def period_key(text: Column) -> Column:
    """One spelling for a fiscal year and its part: fy2024-25 q1; other texts in lower case."""
    s = F.lower(strip(text))
    part = blank_to_null(F.regexp_extract(s, PART, 1))
    first, last = F.regexp_extract(s, SPAN, 1), F.regexp_extract(s, SPAN, 2)
    short, long = F.regexp_extract(s, SHORT_YEAR, 1), F.regexp_extract(s, LONG_YEAR, 1)
    year = lambda digits, add: (digits.try_cast("int") + add).cast("string")
    base = (
        F.when(first != "", F.concat(F.lit("fy"), first, F.lit("-"), F.right(last, F.lit(2))))
        .when(short != "", F.concat(F.lit("fy"), year(short, 1999), F.lit("-"), short))
        .when(long != "", F.concat(F.lit("fy"), year(long, -1), F.lit("-"), F.right(long, F.lit(2))))
    )
    # Named once: a branch's test and value would each search the text again.
    return F.when(text != "", F.coalesce(F.concat(base, F.coalesce(F.concat(F.lit(" "), part), F.lit(""))), s))


def same_period(a: Column, b: Column, key_a: Column | None = None, key_b: Column | None = None) -> Column:
    """Equal keys; a missing period equals only a missing one.  Keys made beforehand save making them for each pair."""
    keys = (period_key(a) if key_a is None else key_a).eqNullSafe(period_key(b) if key_b is None else key_b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(keys)


def standard_predicate(name: Column) -> Column:
    """struct(predicate, condition): a metric's name without the first condition found in it."""
    low = F.lower(strip(name))
    clean, condition = low, F.lit(None).cast("string")
    for pattern, label in reversed(PREDICATE_CONDITIONS):
        hit = low.rlike(pattern)
        clean = F.when(hit, F.regexp_replace(F.regexp_replace(low, pattern, ""), r"^[_\- ]+|[_\- ]+$", "")).otherwise(clean)
        condition = F.when(hit, label).otherwise(condition)
    return F.struct(clean.alias("predicate"), condition.alias("condition"))


def merged_condition(explicit: Column, mined: Column) -> Column:
    return F.coalesce(blank_to_null(explicit), mined)


def subject_key(subject: Column) -> Column:
    """A name in lower case without possessives, hyphens and legal forms."""
    s = F.lower(strip(subject))
    for old, new in (("'s", ""), ("'", ""), ("-", " ")):
        s = F.replace(s, F.lit(old), F.lit(new))
    for form in LEGAL_FORMS:
        s = strip(F.regexp_replace(s, rf"\b{form}\.?\b", ""))
    return F.regexp_replace(s, r"^[. ]+|[. ]+$", "")


def is_rate(predicate: Column) -> Column:
    return F.arrays_overlap(F.split(F.replace(F.lower(predicate), F.lit("-"), F.lit("_")), "_"), F.array(*map(F.lit, RATE_WORDS)))


def dimension_of(dimension: Column, canonical_unit: Column, base_unit: Column, unit: Column, value: Column) -> Column:
    """percentage, monetary, one of the known kinds, or other: as declared, else by the unit's and value's text."""
    said = strip(F.lower(F.coalesce(dimension, F.lit(""))))
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (canonical_unit, base_unit, unit, value))))
    return (
        F.when(said.contains("percent") | (said == "%"), "percentage")
        .when(any_of([said.contains(w) for w in ("monetary", "money", "currency", "amount")]), "monetary")
        .when(said.isin(*DIMENSIONS), said)
        .when(text.contains("%") | text.contains("percent"), "percentage")
        .when(any_of([text.contains(w) for w in MONEY_HINTS]), "monetary")
        .otherwise("other")
    )


def dimensions_compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a == "other") | (b == "other")


def condition_parts(text: Column) -> Column:
    """What a comparison of conditions needs, once for each fact: the text, whether it rules out unconditioned values,
    and on which side of each exclusive pair it stands (a bit for each pair)."""
    low = F.lower(strip(text))
    has = lambda words: any_of([low.contains(w) for w in words])
    bits = lambda side: reduce(Column.__add__, [F.when(has(pair[side]), 1 << k).otherwise(0) for k, pair in enumerate(EXCLUSIVE)])
    return F.when(text.isNotNull(), F.struct(low.alias("text"), has(ONE_SIDED).alias("marked"), bits(0).alias("left"), bits(1).alias("right")))


def compatible_parts(a: Column, b: Column) -> Column:
    """Whether two conditions may describe one metric, from their parts."""
    clash = (a["left"].bitwiseAND(b["right"]) != 0) | (a["right"].bitwiseAND(b["left"]) != 0)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull(), ~b["marked"]).when(b.isNull(), ~a["marked"]).when(a["text"] == b["text"], True).otherwise(~clash)


def conditions_compatible(a: Column, b: Column) -> Column:
    return compatible_parts(condition_parts(a), condition_parts(b))


def authority(filename: Column) -> Column:
    """Trust in a document by the first known words of its file name."""
    name = strip(F.regexp_replace(F.lower(filename), r"[\s_\-./]+", " "))
    out = F.lit(DEFAULT_AUTHORITY)
    for words, score in reversed(AUTHORITY):
        out = F.when(name.contains(words), F.lit(score)).otherwise(out)
    return out


def claim_text(subject: Column, temporal: Column, predicate: Column, value: Column, conditions: Column, scope: Column) -> Column:
    """A claim as a sentence, for a scorer that reads text."""
    around = lambda c, left, right: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(left), c, F.lit(right)))
    return F.concat_ws(" ", subject, around(temporal, "(", ")"), F.replace(predicate, F.lit("_"), F.lit(" ")), F.lit("is"), value, around(conditions, "(", ")"), around(scope, "[", "]"))


def term_key(term: Column) -> Column:
    return F.replace(F.lower(strip(term)), F.lit("_"), F.lit(" "))
