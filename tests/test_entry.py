from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_catalogue_agrees_with_sql(spark):
    """A cross-section of the catalogue, row by row."""
    import duckdb

    from claimweave import queries as catalogue

    found, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) <= set(found)
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    for name in ("fn_parse_numeric", "fn_temporal", "fn_subject", "flt_conditions", "join_pairs", "vrd_cluster_verdict", "txt_chunks", "join_cosine", "fail_scan"):
        df = found[name](spark, SF)
        columns = sorted(df.columns)
        want = con.sql(sql[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(tidy(r[k]) for k in at) for r in want.fetchall()), key=repr), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
