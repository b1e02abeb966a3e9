"""Claims made from the star-schema tables: what orders say against what their lines say.

The SQL is plain enough for both engines, so that a check can start from the same claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE_TOTAL = "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"

ORDER_CLAIMS = f"""
SELECT concat('orders#', CAST(o_orderkey AS string)) AS fact_id, 'orders' AS doc_id, CAST(0 AS bigint) AS ordinal, concat('Order#', CAST(o_orderkey AS string)) AS cluster_id,
  'order_total' AS predicate, o_totalprice AS canonical_value, concat('FY', CAST(year(o_orderdate) AS string)) AS temporal, o_orderstatus AS scope,
  CAST(0.5 + (o_orderkey % 5) / 10.0 AS double) AS confidence FROM orders
UNION ALL
SELECT concat('lineitem#', CAST(o_orderkey AS string)), 'lineitem', CAST(1 AS bigint), concat('Order#', CAST(o_orderkey AS string)),
  'order_total', {_LINE_TOTAL}, concat('FY', CAST(year(max(o_orderdate)) AS string)), max(o_orderstatus), CAST(0.8 AS double)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""

_NATIONS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

NATION_CLAIMS = f"""
SELECT concat('orders#', n_name, CAST(year(o_orderdate) AS string)) AS fact_id, 'orders' AS doc_id, CAST(2 * year(o_orderdate) AS bigint) AS ordinal, n_name AS cluster_id,
  'order_revenue' AS predicate, sum(o_totalprice) AS canonical_value, concat('FY', CAST(year(o_orderdate) AS string)) AS temporal, CAST(NULL AS string) AS scope,
  CAST(0.9 AS double) AS confidence FROM {_NATIONS} GROUP BY n_name, year(o_orderdate)
UNION ALL
SELECT concat('lineitem#', n_name, CAST(year(o_orderdate) AS string)), 'lineitem', CAST(2 * year(o_orderdate) + 1 AS bigint), n_name,
  'order_revenue', {_LINE_TOTAL}, concat('FY', CAST(year(o_orderdate) AS string)), CAST(NULL AS string), CAST(0.8 AS double)
  FROM {_NATIONS} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name, year(o_orderdate)
"""

_REGIONS = f"{_NATIONS} JOIN region ON n_regionkey = r_regionkey"
_MONTH = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS string)"

REGION_CLAIMS = f"""
SELECT concat('orders#', r_name, {_MONTH}) AS fact_id, 'orders' AS doc_id, CAST(2 * (year(o_orderdate) * 100 + month(o_orderdate)) AS bigint) AS ordinal, r_name AS cluster_id,
  'monthly_revenue' AS predicate, sum(o_totalprice) AS canonical_value, {_MONTH} AS temporal, CAST(NULL AS string) AS scope,
  CAST(0.5 + (month(o_orderdate) % 4) / 10.0 AS double) AS confidence FROM {_REGIONS} GROUP BY r_name, year(o_orderdate), month(o_orderdate)
UNION ALL
SELECT concat('lineitem#', r_name, {_MONTH}), 'lineitem', CAST(2 * (year(o_orderdate) * 100 + month(o_orderdate)) + 1 AS bigint), r_name,
  'monthly_revenue', {_LINE_TOTAL}, {_MONTH}, CAST(NULL AS string), CAST(0.8 AS double)
  FROM {_REGIONS} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, year(o_orderdate), month(o_orderdate)
"""

_NAMES = ("orders", "lineitem", "customer", "nation", "region")


def claims(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Cluster members from one of the texts above, with all columns that operators look at."""
    out = sql
    frames = {}
    for name in _NAMES:
        out = out.replace(f" {name} ", f" {{{name}}} ").replace(f" {name}\n", f" {{{name}}}\n")
        frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n: f for n, f in frames.items() if f"{{{n}}}" in out}
    rows = spark.sql(out, **used)
    null = F.lit(None).cast("string")
    rows = rows.withColumns({
        "subject": F.col("cluster_id"), "value": F.round("canonical_value", 2).cast("string"), "numeric_value": F.col("canonical_value"), "unit": null, "base_unit": F.lit("USD"),
        "scale": F.lit(0), "dimension": F.lit("monetary"), "canonical_unit": F.lit("USD"), "conditions": null, "page": F.lit(0), "evidence_quote": null,
        "verified": F.lit(True), "match_type": F.lit("exact"), "fact_seq": F.col("ordinal").cast("int"), "c_subject": F.col("cluster_id"), "c_predicate": F.col("predicate"),
    })
    # Not a join with counts, which would make all claims twice; where no one asks for sizes, the window goes.
    return rows.where("cluster_id is not null").withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))
