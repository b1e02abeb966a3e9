"""Findings of round 3: pairs of large clusters, quotes in any letters, vectors in blocks, claims made once."""

from __future__ import annotations

from facts import facts
from pyspark.sql import functions as F

from claimweave.config import Config
from claimweave.operators import edges


def _cluster(spark, n):
    rows = facts(spark, [{"canonical_value": k % 7, "conditions": (None, "basic", "diluted")[k % 3]} for k in range(n)])
    return rows.select("*", F.lit("c").alias("cluster_id"), F.col("fact_seq").cast("long").alias("ordinal"), F.lit(n).cast("long").alias("cluster_size"))


def test_exact_pairs_of_one_cluster_are_many_tasks_and_the_same(spark):
    members = _cluster(spark, 600).localCheckpoint()
    found = edges.cluster_edges(members, Config(exact_pairs=True)).withColumn("task", F.spark_partition_id()).localCheckpoint()
    plain = edges.pairs(members).select("l_fact_id", "r_fact_id")
    assert found.count() == plain.count()
    assert plain.exceptAll(found.select("src", "tgt")).isEmpty()
    most = max(r["count"] for r in found.groupBy("task").count().collect())
    assert most < 0.75 * found.count()


def test_quotes_compare_letter_by_letter_as_in_sql(spark, tmp_path):
    import duckdb

    from claimweave import queries

    pages = [(1, "vor der STRASSE"), (2, "vor  der\tStraße"), (3, "Vor der Straße."), (4, "vor\u00a0der Straße"), (5, "vor\x0bder Straße"), (6, "ΟΔΟΣ in ŉ ﬁx İX"), (7, "οδοσ in ŉ ﬁx ix"), (8, "οδος in ŉ ﬁx ix"), (9, "\u00a0vor der straẞe"), (10, None), (11, "a\u2003b c")]
    spark.createDataFrame([(k, t, "src1") for k, t in pages], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    quotes = [(1, "vor der Straße"), (21, " vor\n der straße "), (41, "Οδος in ŉ ﬁx ix"), (61, ""), (81, "οδοσ in ŉ"), (101, "a b"), (121, None), (141, "\u00a0vor"), (161, "ıx"), (181, "İx")]
    spark.createDataFrame(quotes, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(queries.oracle_sql()["join_quote_normalized"]).fetchall())
    assert len(want) > 20
    assert sorted(map(tuple, queries.queries()["join_quote_normalized"](spark, str(tmp_path)).collect())) == want


def test_close_vectors_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    import math

    import numpy as np

    from claimweave.operators import matching

    monkeypatch.setattr(matching, "ASKED", 3)
    monkeypatch.setattr(matching, "HELD", 7)
    made = np.random.default_rng(3).standard_normal((60, 5)).tolist()
    made[4], made[8], made[9], made[12] = [0.0] * 5, made[16], [1.0, None, 2.0, 0.0, 1.0], [1.0, 2.0, 0.5]
    rows = [*enumerate(made), (None, [1.0] * 5), (77, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = matching.close_vectors(v.where("vec_id % 4 = 0"), v, 0.3)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    full = {k: [x or 0.0 for x in e] + [0.0] * (5 - len(e)) for k, e in rows if k is not None and e is not None}
    want = {}
    for a in (k for k in full if k % 4 == 0):
        for b in full:
            size = math.sqrt(sum(x * x for x in full[a])) * math.sqrt(sum(x * x for x in full[b]))
            cosine = sum(x * y for x, y in zip(full[a], full[b], strict=True)) / size if size else 0.0
            if a != b and cosine >= 0.3:
                want[a, b] = cosine
    got = found.collect()
    assert len(got) == len(want) > 100
    assert all(math.isclose(r.cosine, want[r.query_id, r.vec_id], rel_tol=1e-12) for r in got)


def test_contradictions_are_counted_by_kinds_as_one_by_one(spark):
    rows = [
        {
            "doc_id": "ab"[k % 2], "subject": ("Acme", "Acme Limited", "Zeta")[k % 3], "predicate": ("revenue", "total_revenue", "net_profit")[k % 5 % 3], "value": str(k % 6), "temporal": ("FY2022", "FY 2022", None, "FY2023")[k % 4],
            "canonical_value": (0.0, -0.0, 100.0, 100.001, None, float("nan"), 7.0)[k % 7], "conditions": (None, "basic", "Basic ", "diluted", "adjusted")[k // 7 % 5],
        }
        for k in range(240)
    ]
    every = facts(spark, rows)
    want = {r.edge_type: r.n for r in edges.edge_counts(edges.detect_contradictions(every)).collect()}
    assert len(want) == 3
    assert {r.edge_type: r.n for r in edges.contradiction_counts(every).collect()} == want
    assert edges.contradiction_counts(every.where("doc_id = 'none'")).isEmpty()


def test_claims_are_made_once(spark):
    from claimweave import queries

    plan = queries.queries()["win_consensus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and plan.count("Join") == 1


def test_sums_taken_with_verdicts_choose_the_same(spark):
    from claimweave.operators import verdicts
    from claimweave.sources.derived import ORDER_CLAIMS, claims

    members = claims(spark, "/root/testdata/sf0.001", ORDER_CLAIMS)
    links = edges.cluster_edges(members)
    base = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("doc_id").alias("doc_count"))
    apart = base.join(verdicts.verdicts(members, links, True), "cluster_id")
    at_once = verdicts.judged(base, links, True, verdicts.cross_edges() | verdicts.conflict_weight())
    for pick in (verdicts.best_corroboration, verdicts.best_contradiction):
        assert pick(apart, links).select("cluster_id", "case_type").collect() == pick(at_once, links).select("cluster_id", "case_type").collect()
