"""Joins, aggregates, rankings and sets over claims and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, credibility, documents, edges, verdicts
from ..operators.matching import close_vectors, term_matches
from ..sources.derived import NATION_CLAIMS, ORDER_CLAIMS, REGION_CLAIMS, claims
from ..sources import store
from ..sources.files import ledger
from .scalars import rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_PAIR = "f a JOIN f b ON a.cluster_id = b.cluster_id AND a.ordinal < b.ordinal"


@query("join_pairs", f"WITH f AS ({ORDER_CLAIMS}) SELECT a.cluster_id, a.fact_id AS src, b.fact_id AS tgt FROM {_PAIR}")
def join_pairs(spark, sf):
    return edges.pairs(claims(spark, sf, ORDER_CLAIMS)).select("cluster_id", F.col("l_fact_id").alias("src"), F.col("r_fact_id").alias("tgt"))


_RANKED = f"""WITH f AS ({REGION_CLAIMS}), s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, ordinal) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM f),
 g AS (SELECT *, CASE WHEN rn <= 10 THEN -1 ELSE (rn - 11) // 40 END AS chunk FROM s)"""


@query("join_anchor_batches", f"{_RANKED} SELECT a.cluster_id, least(a.fact_id, b.fact_id) AS lo, greatest(a.fact_id, b.fact_id) AS hi FROM g a JOIN g b ON a.cluster_id = b.cluster_id AND a.rn < b.rn WHERE a.n <= 50 OR a.chunk = -1 OR a.chunk = b.chunk")
def join_anchor_batches(spark, sf):
    out = edges.anchored_pairs(claims(spark, sf, REGION_CLAIMS))
    return out.select("cluster_id", F.least("l_fact_id", "r_fact_id").alias("lo"), F.greatest("l_fact_id", "r_fact_id").alias("hi"))


@query("join_docs_facts", "SELECT c_custkey AS doc_id, count(o_orderkey) AS facts, count(o_orderkey) > 0 AS extracted FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_docs_facts(spark, sf):
    return store.with_extracted(rows(spark, sf, "customer", "c_custkey AS doc_id"), rows(spark, sf, "orders", "o_custkey AS doc_id")).select("doc_id", "facts", "extracted")


_TERMS = "SELECT DISTINCT lower(concat(p_type, ' pre-', p_name)) AS t FROM part"
_TOK = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"


@query("join_term_lexical", f"""WITH t AS (SELECT t, {_TOK.format('t')} AS w FROM ({_TERMS})), p AS (SELECT a.t AS a, b.t AS b, len(list_intersect(a.w, b.w)) AS n, least(len(a.w), len(b.w)) AS m, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM t a JOIN t b ON a.t < b.t)
 SELECT a, b FROM p WHERE ((contains(a, b) OR contains(b, a)) AND least(len(a), len(b)) >= 4) OR (n > 0 AND (n / m >= 0.8 OR n / u >= 0.5))""")
def join_term_lexical(spark, sf):
    return term_matches(rows(spark, sf, "part", "concat(p_type, '_pre-', p_name) AS term"))


_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("join_cosine", f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COS} / ({_NORM.format('a')} * {_NORM.format('b')}), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE {_COS} / ({_NORM.format('a')} * {_NORM.format('b')}) >= 0.3")
def join_cosine(spark, sf):
    """Every twentieth vector against all: a stated query set."""
    v = rows(spark, sf, "embeddings", "vec_id", "embedding")
    return close_vectors(v.where("vec_id % 20 = 0"), v, 0.3).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


_WORDS = "list_transform(list_distinct(string_split_regex(text, '\\s+')), lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}.%]', '', 'g'))"


@query("join_highlight_tokens", f"""WITH first AS (SELECT conv_id, unnest(list_distinct(list_filter({_WORDS}, lambda w: len(w) >= 3))) AS token FROM conversations WHERE turn = 0),
 box AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)
 SELECT box.conv_id, turn, count(*) AS boxes FROM box JOIN first ON first.conv_id = box.conv_id AND token = regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}.%]', '', 'g') GROUP BY box.conv_id, turn""")
def join_highlight_tokens(spark, sf):
    from ..operators.documents import highlighted

    turns = rows(spark, sf, "conversations", "conv_id", "turn", "text")
    opening = turns.where("turn = 0").select(F.col("conv_id").cast("string").alias("doc_id"), "conv_id", "text")
    pages = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page")).distinct()
    facts = opening.join(pages, "doc_id").select(F.concat_ws("#", "doc_id", F.col("page").cast("string")).alias("fact_id"), "doc_id", "page", F.col("text").alias("evidence_quote"))
    boxes = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    return highlighted(facts, boxes).groupBy(F.col("doc_id").cast("long").alias("conv_id"), F.col("page").alias("turn")).agg(F.count(F.lit(1)).alias("boxes"))


@query("flt_ledger_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '000') AND c_mktsegment = 'BUILDING' AND NOT (c_acctbal > 0)")
def flt_ledger_search(spark, sf):
    facts = rows(spark, sf, "customer", "c_custkey", "c_name AS subject", "c_mktsegment AS doc_id", "'balance' AS predicate", "string(c_acctbal) AS value", "'' AS evidence_quote", "c_acctbal > 0 AS verified", "'exact' AS match_type")
    return ledger(facts, "000", "BUILDING", "unverified").select("c_custkey")


@query("win_latest_report", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win_latest_report(spark, sf):
    reports = rows(spark, sf, "orders", "o_custkey AS doc_id", "o_orderdate AS created_at", "o_orderkey AS total_facts")
    return store.latest(reports).select(F.col("doc_id").alias("o_custkey"), F.col("total_facts").alias("o_orderkey"))


@query("win_fact_index", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_nationkey AS VARCHAR), c_custkey) - 1 AS ordinal FROM customer")
def win_fact_index(spark, sf):
    facts = rows(spark, sf, "customer", "c_custkey", "string(c_nationkey) AS doc_id", "c_custkey AS fact_seq", "string(c_custkey) AS fact_id")
    return clustering.numbered(facts).select("c_custkey", "ordinal")


@query("win_consensus", f"WITH f AS ({ORDER_CLAIMS}) SELECT cluster_id, fact_id AS consensus_fact FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence * 0.75 DESC, ordinal) AS n FROM f) WHERE n = 1")
def win_consensus(spark, sf):
    return credibility.consensus(credibility.started(claims(spark, sf, ORDER_CLAIMS))).select("cluster_id", "consensus_fact")


@query("win_rank_confidence", f"{_RANKED} SELECT cluster_id, fact_id, rn AS rank FROM s")
def win_rank_confidence(spark, sf):
    return edges.ranked(claims(spark, sf, REGION_CLAIMS)).select("cluster_id", "fact_id", F.col("rank").cast("long"))


@query("agg_doc_count", f"WITH f AS ({NATION_CLAIMS}) SELECT cluster_id, count(DISTINCT doc_id) AS doc_count, count(*) AS size FROM f GROUP BY cluster_id")
def agg_doc_count(spark, sf):
    return claims(spark, sf, NATION_CLAIMS).groupBy("cluster_id").agg(F.count_distinct("doc_id").alias("doc_count"), F.count(F.lit(1)).alias("size"))


_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'monetary' WHEN 1 THEN 'area' WHEN 2 THEN 'percent' ELSE CAST(NULL AS string) END"
_NORMAL = "CASE p_partkey % 4 WHEN 0 THEN 'monetary' WHEN 1 THEN 'area' WHEN 2 THEN 'percentage' ELSE 'other' END"


@query("agg_dominant_dimension", f"SELECT p_brand AS cluster_id, k AS dominant_dimension FROM (SELECT p_brand, k, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS r FROM (SELECT p_brand, {_NORMAL} AS k, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2)) WHERE r = 1")
def agg_dominant_dimension(spark, sf):
    null = F.lit(None).cast("string")
    facts = rows(spark, sf, "part", "p_brand AS cluster_id", "p_partkey AS ordinal", f"{_KIND} AS dimension", "'x' AS value").withColumns({c: null for c in ("canonical_unit", "base_unit", "unit")})
    return verdicts.dominant_dimension(facts)


@query("agg_contexts_differ", "SELECT o_custkey::VARCHAR AS cluster_id, count(DISTINCT lower(o_orderstatus)) > 1 AS scopes_differ, count(DISTINCT year(o_orderdate)) > 1 AS periods_differ, false AS conditions_differ, false AS units_differ FROM orders GROUP BY o_custkey")
def agg_contexts_differ(spark, sf):
    facts = rows(spark, sf, "orders", "string(o_custkey) AS cluster_id", "o_orderstatus AS scope", "string(year(o_orderdate)) AS temporal", "' ' AS conditions", "'USD' AS canonical_unit", "0 AS scale")
    return verdicts.contexts_differ(facts)


@query("agg_majority_outlier")
def agg_majority_outlier(spark, sf):
    members = claims(spark, sf, NATION_CLAIMS)
    return verdicts.outliers(members, 0.05, 0.85).select("cluster_id", "fact_id", F.round("majority_value", 2).alias("majority_value"), "outlier")


@query("set_missing_docs", "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_missing_docs(spark, sf):
    return store.without_facts(rows(spark, sf, "customer", "c_custkey AS doc_id"), rows(spark, sf, "orders", "o_custkey AS doc_id", "o_orderpriority").where("o_orderpriority = '1-URGENT'"))


_EDGES = "SELECT l_orderkey AS c, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, l_returnflag AS kind, l_linenumber AS n FROM lineitem"


@query("set_edge_dedupe", f"SELECT c AS cluster_id, lo, hi, kind AS edge_type, n AS kept FROM (SELECT *, row_number() OVER (PARTITION BY c, lo, hi, kind ORDER BY n) AS r FROM ({_EDGES})) WHERE r = 1")
def set_edge_dedupe(spark, sf):
    found = rows(spark, sf, "lineitem", "l_orderkey AS cluster_id", "l_partkey AS src", "l_suppkey AS tgt", "l_returnflag AS edge_type", "l_linenumber AS l_ordinal", "0 AS r_ordinal", "0 AS channel")
    return edges.first_of_kind(found).select("cluster_id", F.least("src", "tgt").alias("lo"), F.greatest("src", "tgt").alias("hi"), "edge_type", F.col("l_ordinal").alias("kept"))


@query("win_progress", "SELECT c_custkey, round(100.0 * sum(1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY c_nationkey), 3)::DOUBLE AS percent FROM customer")
def win_progress(spark, sf):
    return documents.progress(rows(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_nationkey", "c_custkey").select("c_custkey", F.round("percent", 3).alias("percent"))
