"""Scalar functions over strings made from the tables' keys and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUTHORITY, CONFIDENCE, CURRENCY_SIGNS, CURRENCY_WORDS, DEFAULT_AUTHORITY, DIMENSIONS, EXCLUSIVE, LEGAL_FORMS, MONEY_HINTS, MONTHS, ONE_SIDED, PREDICATE_CONDITIONS, RATE_WORDS, SCALE_NAMES, SCALES
from ..functions import context, display, numeric
from ..functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rows(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*columns)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else repr(v)}" for k, v in table.items()) + " END"


def sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"


def trim(text: str) -> str:
    return sub(text, r"^\s+|\s+$")


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


_AMOUNT = "CAST(abs(c_acctbal) AS string)"
VALUE = f"""CASE c_custkey % 11 WHEN 0 THEN concat('$', {_AMOUNT}) WHEN 1 THEN concat('(', {_AMOUNT}, ')') WHEN 2 THEN concat('₹', {_AMOUNT}, ' crore')
 WHEN 3 THEN concat({_AMOUNT}, ' million') WHEN 4 THEN 'FY2022' WHEN 5 THEN concat({_AMOUNT}, '%') WHEN 6 THEN concat('Rs. ', {_AMOUNT}, ' lakh')
 WHEN 7 THEN 'March 2021' WHEN 8 THEN concat('-', {_AMOUNT}) WHEN 9 THEN concat('  €', {_AMOUNT}, ' bn ') ELSE 'Not applicable' END"""
_MULTIPLIER = case("w", SCALES)

PARSED = f"""
SELECT *, CASE WHEN (regexp_extract(body, {q(numeric.NUMBER)}, 1) <> '' AND regexp_extract(body, {q(numeric.NUMBER)}, 4) <> '') OR regexp_extract(body, {q(numeric.NUMBER)}, 2) = '-' THEN -abs(n) ELSE n END AS base,
  CASE WHEN n IS NOT NULL THEN nullif(lower(regexp_extract(regexp_extract(body, {q("(?s)^.*?" + numeric.NUMBER + "(.*)$")}, 5), {q("(?i)" + numeric.SCALE_WORD)}, 1)), '') END AS w
FROM (SELECT *, CASE WHEN NOT dated AND regexp_matches(digits, '\\d') THEN TRY_CAST(digits AS DOUBLE) END AS n
  FROM (SELECT *, replace(regexp_extract(body, {q(numeric.NUMBER)}, 3), ',', '') AS digits
    FROM (SELECT *, {trim(sub(trim('v'), numeric.SIGN))} AS body, regexp_matches(lower({trim('v')}), {q("|".join(MONTHS))}) OR regexp_matches(lower({trim('v')}), {q(numeric.PERIOD_LIKE)}) AS dated
      FROM (SELECT c_custkey, c_acctbal, {VALUE} AS v FROM customer))))"""


@query("fn_parse_numeric", f"SELECT c_custkey, v, base, w AS scale_word, base * coalesce({_MULTIPLIER}, 1.0) AS canonical FROM ({PARSED})")
def parse_numeric(spark, sf):
    return rows(spark, sf, "customer", "c_custkey", f"{VALUE} AS v").withColumn("p", numeric.parse_numeric(F.col("v"))).select("c_custkey", "v", "p.*")


@query(
    "fn_canonical_value",
    f"SELECT c_custkey, round(CASE WHEN w IS NOT NULL THEN base * {_MULTIPLIER} ELSE coalesce(base, c_acctbal) * pow(10.0, c_custkey % 4) END, 2) AS canonical_value FROM ({PARSED})",
)
def canonical_value(spark, sf):
    df = rows(spark, sf, "customer", "c_custkey", "c_acctbal", f"{VALUE} AS v")
    return df.select("c_custkey", F.round(numeric.canonical_value(F.col("v"), F.col("c_acctbal"), F.col("c_custkey") % 4), 2).alias("canonical_value"))


def _currency(text: str) -> str:
    word = sub(f"lower(regexp_extract({text}, {q('(?i)' + numeric.CURRENCY_WORD)}, 1))", r"\.$")
    return f"CASE WHEN regexp_matches({text}, {q(numeric.SIGN)}) THEN {case(f'substring({text}, 1, 1)', CURRENCY_SIGNS)} ELSE {case(word, CURRENCY_WORDS)} END"


@query("fn_currency", f"SELECT c_custkey, {_currency('v')} AS currency FROM (SELECT c_custkey, {VALUE} AS v FROM customer)")
def currency(spark, sf):
    return rows(spark, sf, "customer", "c_custkey", f"{VALUE} AS v").select("c_custkey", numeric.currency(F.col("v")).alias("currency"))


UNIT = "CASE s_suppkey % 8 WHEN 0 THEN 'INR million' WHEN 1 THEN 'Rs. crore' WHEN 2 THEN '%' WHEN 3 THEN 'locations' WHEN 4 THEN CAST(NULL AS string) WHEN 5 THEN 'USD mn' WHEN 6 THEN 'million square ft' ELSE 'customers' END"
ISO = "CASE s_suppkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE CAST(NULL AS string) END"
_LEFT = sub(sub(trim(sub(trim(sub(trim("u"), numeric._UNIT_SCALES)), numeric._UNIT_CURRENCIES)), numeric.SIGN), r"^[\s.]+|[\s.]+$")


@query("fn_canonical_unit", f"SELECT s_suppkey, CASE WHEN coalesce(u, '') = '' THEN c WHEN l = '' OR (c IS NOT NULL AND lower(l) = 'in') THEN c ELSE l END AS canonical_unit FROM (SELECT *, {_LEFT} AS l FROM (SELECT s_suppkey, {UNIT} AS u, {ISO} AS c FROM supplier))")
def canonical_unit(spark, sf):
    return rows(spark, sf, "supplier", "s_suppkey", f"{UNIT} AS u", f"{ISO} AS c").select("s_suppkey", numeric.canonical_unit(F.col("u"), F.col("c")).alias("canonical_unit"))


_SCALE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(u), {q(rf'\b{w}s?\b')}) THEN {SCALES[w]}" for w in numeric.LONGEST_SCALES) + " ELSE 1.0 END"


@query("fn_scale_in_unit", f"SELECT s_suppkey, CAST({_SCALE_CASE} AS DOUBLE) AS scale FROM (SELECT s_suppkey, {UNIT} AS u FROM supplier)")
def scale_in_unit(spark, sf):
    return rows(spark, sf, "supplier", "s_suppkey", f"{UNIT} AS u").select("s_suppkey", numeric.scale_in_unit(F.col("u")).alias("scale"))


@query("fn_display_unit", f"SELECT s_suppkey, nullif(concat_ws(' ', nullif(u, ''), {case('s_suppkey % 13', SCALE_NAMES)}), '') AS unit FROM (SELECT s_suppkey, {UNIT} AS u FROM supplier)")
def display_unit(spark, sf):
    return rows(spark, sf, "supplier", "s_suppkey", f"{UNIT} AS u").select("s_suppkey", numeric.display_unit(F.col("u"), (F.col("s_suppkey") % 13).cast("int")).alias("unit"))


PERIOD = """CASE o_orderkey % 9 WHEN 0 THEN concat(CAST(year(o_orderdate) AS string), '-', CAST(year(o_orderdate) % 100 AS string)) WHEN 1 THEN concat('FY', CAST(year(o_orderdate) % 100 AS string))
 WHEN 2 THEN concat('FY', CAST(year(o_orderdate) AS string)) WHEN 3 THEN concat('Q1 FY', CAST(year(o_orderdate) % 100 AS string)) WHEN 4 THEN concat('H1:', CAST(year(o_orderdate) AS string), '/', CAST(year(o_orderdate) + 1 AS string))
 WHEN 5 THEN 'March 31, 1995' WHEN 6 THEN CAST(NULL AS string) WHEN 7 THEN '' ELSE concat(CAST(year(o_orderdate) AS string), '-12-31') END"""


def period_sql(t: str) -> str:
    s = f"lower({trim(t)})"
    got = lambda p, g: f"regexp_extract({s}, {q(p)}, {g})"
    base = f"""CASE WHEN {got(context.SPAN, 1)} <> '' THEN concat('fy', {got(context.SPAN, 1)}, '-', right({got(context.SPAN, 2)}, 2))
 WHEN {got(context.SHORT_YEAR, 1)} <> '' THEN concat('fy', CAST(TRY_CAST({got(context.SHORT_YEAR, 1)} AS INT) + 1999 AS VARCHAR), '-', {got(context.SHORT_YEAR, 1)})
 WHEN {got(context.LONG_YEAR, 1)} <> '' THEN concat('fy', CAST(TRY_CAST({got(context.LONG_YEAR, 1)} AS INT) - 1 AS VARCHAR), '-', right({got(context.LONG_YEAR, 1)}, 2)) END"""
    return f"CASE WHEN {t} <> '' THEN CASE WHEN {base} IS NOT NULL THEN concat_ws(' ', {base}, nullif({got(context.PART, 1)}, '')) ELSE {s} END END"


@query("fn_temporal", f"SELECT o_orderkey, {period_sql('t')} AS period FROM (SELECT o_orderkey, {PERIOD} AS t FROM orders)")
def temporal(spark, sf):
    return rows(spark, sf, "orders", "o_orderkey", f"{PERIOD} AS t").select("o_orderkey", context.period_key(F.col("t")).alias("period"))


PREDICATE = "concat(lower(replace(p_type, ' ', '_')), CASE p_partkey % 9 WHEN 0 THEN '_pre_tax' WHEN 1 THEN '_after_tax' WHEN 2 THEN '_restated' WHEN 3 THEN '_adjusted' WHEN 4 THEN '_pro_forma' WHEN 5 THEN '_unaudited' WHEN 6 THEN '_growth_rate' WHEN 7 THEN '_excluding-esop' ELSE '' END)"
_P = f"lower({trim('p')})"
_CLEAN = "CASE " + " ".join(f"WHEN regexp_matches({_P}, {q(x)}) THEN {sub(sub(_P, x), r'^[_\- ]+|[_\- ]+$')}" for x, _ in PREDICATE_CONDITIONS) + f" ELSE {_P} END"
_CONDITION = "CASE " + " ".join(f"WHEN regexp_matches({_P}, {q(x)}) THEN {q(c)}" for x, c in PREDICATE_CONDITIONS) + " END"


@query("fn_predicate", f"SELECT p_partkey, {_CLEAN} AS predicate, {_CONDITION} AS condition FROM (SELECT p_partkey, {PREDICATE} AS p FROM part)")
def predicate(spark, sf):
    return rows(spark, sf, "part", "p_partkey", f"{PREDICATE} AS p").withColumn("s", context.standard_predicate(F.col("p"))).select("p_partkey", "s.*")


@query("fn_rate_flag", f"SELECT p_partkey, len(list_intersect(string_split(replace(lower(p), '-', '_'), '_'), [{', '.join(map(q, RATE_WORDS))}])) > 0 AS is_rate FROM (SELECT p_partkey, {PREDICATE} AS p FROM part)")
def rate_flag(spark, sf):
    return rows(spark, sf, "part", "p_partkey", f"{PREDICATE} AS p").select("p_partkey", context.is_rate(F.col("p")).alias("is_rate"))


SUBJECT = "concat(s_name, CASE s_suppkey % 7 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Inc.' WHEN 2 THEN '''s' WHEN 3 THEN ' Pvt Ltd' WHEN 4 THEN '-Works Corp' WHEN 5 THEN ' Private Corporation' ELSE '' END)"


def subject_sql(t: str) -> str:
    s = f"replace(replace(replace(lower({trim(t)}), '''s', ''), '''', ''), '-', ' ')"
    for form in LEGAL_FORMS:
        s = trim(sub(s, rf"\b{form}\.?\b"))
    return sub(s, r"^[. ]+|[. ]+$")


@query("fn_subject", f"SELECT s_suppkey, {subject_sql('n')} AS subject FROM (SELECT s_suppkey, {SUBJECT} AS n FROM supplier)")
def subject(spark, sf):
    # The quote in the shared text is doubled for SQL; Spark reads it as an escaped one, too.
    return rows(spark, sf, "supplier", "s_suppkey", SUBJECT.replace("'''s'", '"\'s"') + " AS n").select("s_suppkey", context.subject_key(F.col("n")).alias("subject"))


_D = "CASE c_custkey % 5 WHEN 0 THEN 'Monetary' WHEN 1 THEN 'percent' WHEN 2 THEN 'area' ELSE CAST(NULL AS string) END"
_DIMENSION = f"""CASE WHEN contains(d, 'percent') OR d = '%' THEN 'percentage' WHEN {has('d', ('monetary', 'money', 'currency', 'amount'))} THEN 'monetary'
 WHEN d IN ({', '.join(map(q, DIMENSIONS))}) THEN d WHEN contains(x, '%') OR contains(x, 'percent') THEN 'percentage' WHEN {has('x', MONEY_HINTS)} THEN 'monetary' ELSE 'other' END"""


@query("fn_dimension", f"SELECT c_custkey, {_DIMENSION} AS dimension FROM (SELECT c_custkey, lower(coalesce({_D}, '')) AS d, lower(concat_ws(' ', '', '', '', {VALUE})) AS x FROM customer)")
def dimension(spark, sf):
    null = F.lit(None).cast("string")
    return rows(spark, sf, "customer", "c_custkey", f"{_D} AS d", f"{VALUE} AS v").select("c_custkey", context.dimension_of(F.col("d"), null, null, null, F.col("v")).alias("dimension"))


FILE = "concat(CAST(p_partkey AS string), CASE p_partkey % 8 WHEN 0 THEN '_annual-report.pdf' WHEN 1 THEN '-Economic_Survey-2024.pdf' WHEN 2 THEN '_10-k.pdf' WHEN 3 THEN ' press release.txt' WHEN 4 THEN '-earnings-presentation' WHEN 5 THEN '.blog' WHEN 6 THEN '_presentation.pdf' ELSE '.pdf' END)"
_FILE = trim(sub("lower(f)", r"[\s_\-./]+", " "))


@query("fn_authority", f"SELECT p_partkey, CAST(CASE {' '.join(f'WHEN contains({_FILE}, {q(w)}) THEN {a}' for w, a in AUTHORITY)} ELSE {DEFAULT_AUTHORITY} END AS DOUBLE) AS authority FROM (SELECT p_partkey, {FILE} AS f FROM part)")
def authority(spark, sf):
    return rows(spark, sf, "part", "p_partkey", f"{FILE} AS f").select("p_partkey", context.authority(F.col("f")).alias("authority"))


@query("fn_claim_text", f"SELECT o_orderkey, concat_ws(' ', concat('Order#', CAST(o_orderkey AS VARCHAR)), CASE WHEN t <> '' THEN concat('(', t, ')') END, 'order total', 'is', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '(adjusted)' END, concat('[', o_orderpriority, ']')) AS claim FROM (SELECT *, {PERIOD} AS t FROM orders)")
def claim_text(spark, sf):
    df = rows(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", f"{PERIOD} AS t", "concat('Order#', CAST(o_orderkey AS string)) AS s", "CASE WHEN o_orderkey % 2 = 0 THEN 'adjusted' END AS c")
    return df.select("o_orderkey", context.claim_text(F.col("s"), F.col("t"), F.lit("order_total"), F.col("o_orderstatus"), F.col("c"), F.col("o_orderpriority")).alias("claim"))


_CONDITIONS = ("adjusted", "pre-tax", "after tax", "basic", "in cash", "gross", "net", "Standalone", "consolidated")
_A = "CASE c_custkey % 11 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CONDITIONS)) + " ELSE CAST(NULL AS string) END"
_B = "CASE c_nationkey % 10 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CONDITIONS)) + " ELSE CAST(NULL AS string) END"
_CLASH = " OR ".join(f"({has('x', a)} AND {has('y', b)}) OR ({has('x', b)} AND {has('y', a)})" for a, b in EXCLUSIVE)


@query("flt_conditions", f"SELECT c_custkey, CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN NOT {has('coalesce(x, y)', ONE_SIDED)} WHEN x = y THEN true ELSE NOT ({_CLASH}) END AS compatible FROM (SELECT *, lower(trim(a)) AS x, lower(trim(b)) AS y FROM (SELECT c_custkey, {_A} AS a, {_B} AS b FROM customer))")
def conditions(spark, sf):
    return rows(spark, sf, "customer", "c_custkey", f"{_A} AS a", f"{_B} AS b").select("c_custkey", context.conditions_compatible(F.col("a"), F.col("b")).alias("compatible"))


_MATCH = "CASE l_linenumber % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'other' ELSE 'unverified' END"


@query("fn_confidence", f"SELECT l_returnflag, sum(CASE WHEN m = 'unverified' THEN 0.1 ELSE coalesce(CAST({case('m', CONFIDENCE)} AS DOUBLE), 0.5) END * 100)::BIGINT AS hundredths FROM (SELECT l_returnflag, {_MATCH} AS m FROM lineitem) GROUP BY l_returnflag")
def confidence(spark, sf):
    df = rows(spark, sf, "lineitem", "l_returnflag", f"{_MATCH} AS m")
    return df.groupBy("l_returnflag").agg(F.round(F.sum(numeric.calibrated(F.col("m") != "unverified", F.col("m")) * 100)).cast("long").alias("hundredths"))


@query("fn_md_table", "SELECT n_nationkey, concat('Table on page ', CAST(n_regionkey AS VARCHAR), chr(10), '| key | name |', chr(10), '| --- | --- |', chr(10), '| ', CAST(n_nationkey AS VARCHAR), ' | ', n_name, ' |', chr(10), '| ', CAST(n_regionkey AS VARCHAR), ' |  |') AS md FROM nation")
def md_table(spark, sf):
    df = rows(spark, sf, "nation", "n_nationkey", "n_regionkey", "struct(array('key', 'name') AS headers, array(array(string(n_nationkey), n_name), array(string(n_regionkey))) AS rows) AS t")
    return df.select("n_nationkey", T.markdown(F.col("t"), F.col("n_regionkey")).alias("md"))


# Written out, so that a wrong label is found.
_SHOWN = """(VALUES (0, 'DISPUTE_GENUINE_CONFLICT', 'Genuine conflict', 'urgent'), (1, 'DISPUTE_SIGN_MISMATCH', 'Sign mismatch (profit vs loss)', 'urgent'), (2, 'DISPUTE_ORDER_OF_MAGNITUDE', 'Scale error (>10x discrepancy)', 'urgent'),
 (3, 'DISPUTE_TEMPORAL_DRIFT', 'Different reporting period', 'moderate'), (4, 'DISPUTE_UNIT_MISMATCH', 'Unit or currency mismatch', 'moderate'), (5, 'DISPUTE_SCOPE_DIFFERENCE', 'Consolidated vs Standalone boundary', 'moderate'),
 (6, 'DISPUTE_ACCOUNTING_BASIS', 'Accounting basis difference', 'moderate'), (7, 'DISPUTE_ROUNDING', 'Rounding variance (<1%)', 'neutral'), (8, 'AGREEMENT_EXACT', 'Exact numerical match', 'neutral'), (9, 'AGREEMENT_APPROXIMATE', 'Approximate match', 'neutral'),
 (10, 'UNRESOLVED', 'Unresolved discrepancy', 'moderate'), (11, 'DISPUTE_CUSTOM', 'Domain-specific dispute', 'moderate'), (12, 'UNHEARD_of', 'Unheard Of', 'moderate'), (13, NULL, 'Uncategorized', 'neutral')) AS x(k, code, label, severity)"""
_CODE = "CASE p_partkey % 14 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate([*display.DISPUTES, "UNHEARD_of"])) + " END"


@query("fn_dispute_label", f"SELECT p_partkey, code, label, severity FROM part JOIN {_SHOWN} ON k = p_partkey % 14")
def dispute_label(spark, sf):
    return rows(spark, sf, "part", "p_partkey", f"{_CODE} AS c").select("p_partkey", F.col("c").alias("code"), display.dispute_label(F.col("c")).alias("label"), display.dispute_severity(F.col("c")).alias("severity"))


@query("fn_value_text", f"SELECT c_custkey, CASE WHEN u = '' OR contains(lower(v), lower(u)) THEN v ELSE concat_ws(' ', v, u) END AS shown FROM (SELECT c_custkey, {VALUE} AS v, CASE c_custkey % 3 WHEN 0 THEN 'million' WHEN 1 THEN 'USD' ELSE '' END AS u FROM customer)")
def value_text(spark, sf):
    return rows(spark, sf, "customer", "c_custkey", f"{VALUE} AS v", "CASE c_custkey % 3 WHEN 0 THEN 'million' WHEN 1 THEN 'USD' ELSE '' END AS u").select("c_custkey", display.value_text(F.col("v"), F.col("u")).alias("shown"))
