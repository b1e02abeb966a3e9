"""Numbers, scales, currencies and units in value strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIDENCE, CURRENCY_SIGNS, CURRENCY_WORDS, MONTHS, OTHER_MATCH, SCALE_NAMES, SCALES, UNVERIFIED

#: Opening parenthesis, sign, digits with commas, closing parenthesis.
NUMBER = r"(\()?([-+])?([\d,]+\.?\d*|\.?\d+)(\))?"
SIGN = "^[₹$€£¥]"
LONGEST_SCALES = sorted(SCALES, key=len, reverse=True)
SCALE_WORD = r"\b(" + "|".join(LONGEST_SCALES) + r")\b"
CURRENCY_WORD = r"\b(rs\.?|inr|usd|us\$|eur|gbp|jpy|cny|rmb|rupees?)\b"
PERIOD_LIKE = r"^(fy|cy|q[1-4])\s*\d{2,4}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def parse_numeric(text: Column) -> Column:
    """struct(base, scale_word, canonical); all null where the text holds no number or is a date."""
    clean = strip(text)
    low = F.lower(clean)
    date = low.rlike("|".join(MONTHS)) | low.rlike(PERIOD_LIKE)
    body = strip(F.regexp_replace(clean, SIGN, ""))
    digits = F.replace(F.regexp_extract(body, NUMBER, 3), F.lit(","), F.lit(""))
    number = F.when(~date & digits.rlike(r"\d"), digits).try_cast("double")
    paired = (F.regexp_extract(body, NUMBER, 1) != "") & (F.regexp_extract(body, NUMBER, 4) != "")
    base = F.when(paired | (F.regexp_extract(body, NUMBER, 2) == "-"), -F.abs(number)).otherwise(number)
    rest = F.regexp_extract(body, "(?s)^.*?" + NUMBER + "(.*)$", 5)
    word = F.when(number.isNotNull(), blank_to_null(F.lower(F.regexp_extract(rest, "(?i)" + SCALE_WORD, 1))))
    return F.struct(base.alias("base"), word.alias("scale_word"), (base * F.coalesce(lookup(SCALES, word), F.lit(1.0))).alias("canonical"))


def scale_in_unit(unit: Column) -> Column:
    """What the longest scale word in a unit multiplies by; 1 without one."""
    low = F.lower(strip(unit))
    out = F.lit(1.0)
    for word in reversed(LONGEST_SCALES):
        out = F.when(low.rlike(rf"\b{word}s?\b"), F.lit(SCALES[word])).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def currency(text: Column) -> Column:
    """ISO code by a leading sign, else by the first currency word."""
    word = F.lower(F.regexp_extract(text, "(?i)" + CURRENCY_WORD, 1))
    return F.when(text.rlike(SIGN), lookup(CURRENCY_SIGNS, F.substring(text, 1, 1))).otherwise(lookup(CURRENCY_WORDS, blank_to_null(F.regexp_replace(word, r"\.$", ""))))


_UNIT_SCALES = r"(?i)\b(?:" + "|".join(LONGEST_SCALES) + r")s?\b"
_UNIT_CURRENCIES = r"(?i)\b(?:rs\.|rs|inr|rupees|rupee|usd|us\$|eur|gbp|jpy|cny|rmb)\b"


def canonical_unit(unit: Column, iso: Column) -> Column:
    """A unit without its scale and currency words; the currency where nothing is left."""
    left = strip(F.regexp_replace(strip(unit), _UNIT_SCALES, ""))
    left = strip(F.regexp_replace(left, _UNIT_CURRENCIES, ""))
    left = F.regexp_replace(F.regexp_replace(left, SIGN, ""), r"^[\s.]+|[\s.]+$", "")
    named = F.when((left == "") | (iso.isNotNull() & (F.lower(left) == "in")), iso).otherwise(left)
    return F.when(F.coalesce(unit, F.lit("")) == "", iso).otherwise(named)


def canonical_value(value: Column, numeric_value: Column, scale: Column) -> Column:
    """The value's own number and scale word; without a scale word, the number times the extracted power of ten."""
    parsed = parse_numeric(value)
    return F.when(parsed["scale_word"].isNotNull(), parsed["canonical"]).otherwise(F.coalesce(parsed["base"], numeric_value) * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0))))


def display_unit(base_unit: Column, scale: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", blank_to_null(base_unit), lookup(SCALE_NAMES, scale)))


def unit_of_fact(base_unit: Column, value: Column) -> Column:
    return F.coalesce(blank_to_null(base_unit), currency(value), currency(base_unit))


def calibrated(verified: Column, match_type: Column) -> Column:
    """Confidence by how a fact's quote was found."""
    tiers = reduce(lambda out, kind: F.when(match_type == kind, CONFIDENCE[kind]).otherwise(out), CONFIDENCE, F.lit(OTHER_MATCH))
    return F.when(~F.coalesce(verified, F.lit(False)), UNVERIFIED).otherwise(tiers)


def nearly_equal(a: Column, b: Column, epsilon: float) -> Column:
    """Both zero, or a relative difference below epsilon."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most == 0, True).otherwise(F.abs(a - b) / F.when(most != 0, most) < epsilon)
