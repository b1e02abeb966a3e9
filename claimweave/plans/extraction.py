"""From raw facts and pages to grounded, normalised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import context, numeric
from ..operators.documents import ground


def normalised(raw: DataFrame, pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Facts from raw facts (doc_id, fact_seq and the extracted fields): quote found, number, unit, period, condition, confidence."""
    named = raw.withColumn("fact_id", F.concat_ws("#", "doc_id", F.col("fact_seq").cast("string")))
    quotes = named.select(F.col("fact_id").alias("quote_id"), "doc_id", F.coalesce("evidence_quote", F.lit("")).alias("quote"), F.col("page_number").alias("hint"))
    found = ground(quotes, pages, config.fuzzy_quote).select(F.col("quote_id").alias("fact_id"), "page", "verified", "match_type")
    parsed = numeric.parse_numeric(F.col("value"))
    name = context.standard_predicate(F.col("predicate"))
    rows = named.join(found, "fact_id").withColumns({"parsed": parsed, "named": name})
    return rows.select(
        "fact_id", "doc_id", F.col("fact_seq").cast("int").alias("fact_seq"), "subject", F.col("named.predicate").alias("predicate"), "value",
        F.coalesce("parsed.base", "numeric_value").alias("numeric_value"),
        numeric.display_unit(F.col("base_unit"), F.col("scale")).alias("unit"), "base_unit", F.coalesce("scale", F.lit(0)).cast("int").alias("scale"), "dimension",
        numeric.canonical_value(F.col("value"), F.col("numeric_value"), F.col("scale")).alias("canonical_value"),
        numeric.unit_of_fact(F.col("base_unit"), F.col("value")).alias("canonical_unit"),
        "temporal", "scope", context.merged_condition(F.col("conditions"), F.col("named.condition")).alias("conditions"),
        numeric.calibrated(F.col("verified"), F.col("match_type")).alias("confidence"), "page", "evidence_quote", "verified", "match_type",
    )
