from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimweave.functions import context, display, numeric, text, vectors


def values(spark, rows, schema, column):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_numbers(spark):
    cases = {
        "13,087": (13087, None, 13087), "₹48,105.30": (48105.30, None, 48105.30), "$1,500 million": (1500, "million", 1.5e9), "$1.5 billion": (1.5, "billion", 1.5e9),
        "₹2.5 crore": (2.5, "crore", 2.5e7), "₹50 lakh": (50, "lakh", 5e6), "(8,911.39)": (-8911.39, None, -8911.39), "-500.5": (-500.5, None, -500.5),
        "14.5%": (14.5, None, 14.5), "₹48,105.30 mn": (48105.30, "mn", 4.81053e10), "$2.1 bn": (2.1, "bn", 2.1e9), "Rs. 100 cr": (100, "cr", 1e9),
        "Not applicable": (None,) * 3, "": (None,) * 3, None: (None,) * 3, "August 2021": (None,) * 3, "FY2022": (None,) * 3, "Q3 2021": (None,) * 3,
        "market share 5%": (None,) * 3, "$76.69B": (76.69, None, 76.69), "  .5 ": (0.5, None, 0.5), "Rs, 500": (None,) * 3,
    }
    got = values(spark, list(cases), "v string", numeric.parse_numeric(F.col("v")))
    for want, have in zip(cases.values(), got, strict=True):
        assert have["scale_word"] == want[1]
        assert have["base"] == pytest.approx(want[0]) if want[0] is not None else have["base"] is None
        assert have["canonical"] == pytest.approx(want[2]) if want[2] is not None else have["canonical"] is None


def test_currencies_and_units(spark):
    cases = {"₹48,105.30": "INR", "$1,500 million": "USD", "€100": "EUR", "£100": "GBP", "Rs. 500 crore": "INR", "INR 1000": "INR", "14.5%": None, "13087": None, None: None}
    assert values(spark, list(cases), "v string", numeric.currency(F.col("v"))) == list(cases.values())
    units = [("INR million", "INR", "INR"), ("Rs. crore", "INR", "INR"), ("%", None, "%"), ("locations", None, "locations"), (None, "USD", "USD"), (None, None, None), ("INR mn", "INR", "INR")]
    assert values(spark, [u[:2] for u in units], "u string, c string", numeric.canonical_unit(F.col("u"), F.col("c"))) == [u[2] for u in units]
    scales = {"INR million": 1e6, "million square ft": 1e6, "INR crore": 1e7, "%": 1.0, None: 1.0}
    assert values(spark, list(scales), "u string", numeric.scale_in_unit(F.col("u"))) == list(scales.values())


def test_canonical_value_and_confidence(spark):
    rows = [("₹2.5 crore", 9.0, 6), ("2.5", 9.0, 6), ("n/a", 9.0, 3), ("n/a", None, 3)]
    assert values(spark, rows, "v string, n double, s int", numeric.canonical_value(F.col("v"), F.col("n"), F.col("s"))) == [2.5e7, 2.5e6, 9000.0, None]
    tiers = [(True, "exact"), (True, "normalized"), (True, "fuzzy"), (True, "odd"), (False, "exact")]
    assert values(spark, tiers, "v boolean, m string", numeric.calibrated(F.col("v"), F.col("m"))) == [1.0, 0.95, 0.8, 0.5, 0.1]


def test_periods(spark):
    cases = {"2024-25": "fy2024-25", "2024/25": "fy2024-25", "FY25": "fy2024-25", "FY2025": "fy2024-25", "Q1:2024-25": "fy2024-25 q1", "Q1 FY25": "fy2024-25 q1", "H1 FY25": "fy2024-25 h1", "FY26": "fy2025-26", "March 31, 2024": "march 31, 2024", "2024-12-31": "fy2024-12", None: None, "": None, "FY2024/25": "fy2024-25", "2024-2025": "fy2024-25"}
    assert values(spark, list(cases), "v string", context.period_key(F.col("v"))) == list(cases.values())
    same = [("FY25", "2024-25", True), ("FY25", None, False), (None, None, True), ("FY25", "FY26", False)]
    assert values(spark, [s[:2] for s in same], "a string, b string", context.same_period(F.col("a"), F.col("b"))) == [s[2] for s in same]


def test_predicates(spark):
    cases = {"operating_profit_pre_tax": ("operating_profit", "pre-tax"), "net_profit_after_tax": ("net_profit", "after-tax"), "revenue_restated": ("revenue", "restated"), "revenue_from_contracts": ("revenue_from_contracts", None), "ebitda": ("ebitda", None), "profit_before_tax": ("profit_before_tax", None), "": ("", None), "unadjusted_x": ("un_x", "adjusted")}
    assert [tuple(x) for x in values(spark, list(cases), "v string", context.standard_predicate(F.col("v")))] == list(cases.values())
    rates = {"exports_annual_growth": True, "exports": False, "tax-rate": True, "growth rate": False}
    assert values(spark, list(rates), "v string", context.is_rate(F.col("v"))) == list(rates.values())


def test_subjects_authority_dimension(spark):
    names = {"X Limited": "x", "Apple Inc.": "apple", "Tesla Corp": "tesla", "Tesla's": "tesla", "Coca-Cola": "coca cola"}
    assert values(spark, list(names), "v string", context.subject_key(F.col("v"))) == list(names.values())
    files = {"01-x-economic-survey-2024.pdf": 0.90, "x-annual-report.pdf": 0.95, "x_annual_report.pdf": 0.95, "x_10_k.pdf": 0.95, "x-quarterly-report": 0.85, "x-press-release": 0.70, "prospectus.pdf": 0.90, "misc": 0.75, "earnings-presentation": 0.80}
    assert values(spark, list(files), "v string", context.authority(F.col("v"))) == list(files.values())
    rows = [("monetary", None, None, None, "5", "monetary"), ("percent", None, None, None, "5", "percentage"), (None, "%", None, None, "5", "percentage"), (None, "USD", None, None, "5", "monetary"), (None, None, None, None, "5", "other"), ("area", None, None, None, "5 %", "area")]
    assert values(spark, [r[:5] for r in rows], "d string, c string, b string, u string, v string", context.dimension_of(*map(F.col, "dcbuv"))) == [r[5] for r in rows]


def test_conditions(spark):
    rows = [(None, None, True), ("adjusted", None, False), (None, "in cash", True), ("Pre-tax", "pre-tax", True), ("pre-tax", "after-tax", False), ("standalone", "consolidated", False), ("diluted", "basic", False), ("in cash", "in kind", True), ("gross", "net", False)]
    assert values(spark, [r[:2] for r in rows], "a string, b string", context.conditions_compatible(F.col("a"), F.col("b"))) == [r[2] for r in rows]


def test_texts(spark):
    assert values(spark, ["a  B\n c"], "v string", text.normal_space(F.col("v"))) == ["a b c"]
    assert values(spark, ["a    b\n\n  \nc"], "v string", text.layout_space(F.col("v"))) == ["a  b\nc"]
    rows = [("one two", "zero one two three", "exact"), ("One  TWO", "zero one two", "normalized"), ("one two three four nine", "one x two three y four", "fuzzy"), ("nine one two", "one two", None), ("  ", "x", None)]
    assert values(spark, [r[:2] for r in rows], "q string, p string", text.quote_tier(F.col("q"), F.col("p"), 0.8)) == [r[2] for r in rows]
    assert values(spark, [([1, 2, 3, 9, 1],)], "v array<int>", text.packed_bins(F.col("v"), 5)) == [[0, 0, 1, 2, 3]]
    table = spark.createDataFrame([(["a", "b"], [["1"], ["2", "3", "4"]])], "headers array<string>, rows array<array<string>>").select(F.struct("headers", "rows").alias("t"))
    assert table.select(text.markdown(F.col("t"), F.lit(4))).first()[0] == "Table on page 4\n| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert tuple(values(spark, [("say Hello there", "hello")], "t string, p string", text.highlight(F.col("t"), F.col("p")))[0]) == ("say ", "Hello", " there")


def test_display_and_vectors(spark):
    assert values(spark, ["net_profit"], "v string", display.metric_name(F.col("v"))) == ["Net Profit"]
    assert values(spark, [("5", "USD"), ("USD 5", "usd"), ("5", None)], "v string, u string", display.value_text(F.col("v"), F.col("u"))) == ["5 USD", "USD 5", "5"]
    assert values(spark, ["DISPUTE_ROUNDING", "odd_code", None], "v string", display.dispute_label(F.col("v"))) == ["Rounding variance (<1%)", "Odd Code", "Uncategorized"]
    assert values(spark, [1234567.0, 0.1, 1.255, -3.5], "v double", display.canonical_text(F.col("v"), F.lit("INR"))) == ["1,234,567 INR", "0.1 INR", "1.26 INR", "-3.5 INR"]
    assert values(spark, [None], "v string", display.value_text(F.col("v"), F.lit("INR"))) == ["—"]
    got = values(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b")))
    assert got == [pytest.approx(0.70710678), 0.0]
