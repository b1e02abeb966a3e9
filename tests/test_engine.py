from __future__ import annotations

import json

import pytest

from claimweave.engine import Engine, page_range, page_stats
from claimweave.sources.backends import Cascade

REVENUE = {"subject": "Acme", "predicate": "revenue", "base_unit": "USD", "scale": 0, "dimension": "monetary", "temporal": "FY24", "page_number": 0}


def cascade():
    """A model for the workers; nested, so that it travels by value."""

    def answer(prompt):
        value = "$5 million" if "5 million" in prompt else "$9 million"
        return json.dumps({"facts": [REVENUE | {"value": value, "evidence_quote": f"revenue of {value}"}]})

    return lambda: Cascade({"m": answer})


def test_engine_from_files_to_verdict(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a-annual-report.txt").write_text("Acme had revenue of $5 million in the year.\fSecond page of text.")
    (tmp_path / "in" / "b-press-release.txt").write_text("Acme had revenue of $9 million in the year.")
    seen = []
    engine = Engine(spark, str(tmp_path / "store"), model=cascade())
    documents, job = engine.ingest(str(tmp_path / "in"), lambda percent, step: seen.append(percent))
    rows = documents.collect()
    assert {r.filename for r in rows} == {"a-annual-report.txt", "b-press-release.txt"} and seen[-1] == 100 and job.error is None
    for r in rows:
        assert engine.extract(r.doc_id).count() == 1
        assert engine.extract(r.doc_id).first().match_type == "exact"  # from the store
    graph, job = engine.reconcile()
    cluster = graph.clusters.first()
    assert (cluster.case_type, cluster.size, cluster.consensus_value) == ("contradicted", 2, "$5 million")
    assert engine.cases(graph)["contradicted"].first().cluster_id == cluster.cluster_id
    assert engine.capabilities()["extraction"] and not engine.capabilities()["text_scorer"]
    a, b = (r.doc_id for r in rows)
    assert engine.contradictions(a, b).first().edge_type == "contradicts"
    assert engine.store.latest_reports().first().total_facts == 2
    with pytest.raises(ValueError):
        engine.reconcile(["unknown"])
    assert [j.error is not None for j in engine.jobs.values()][-1]
    engine.delete(a)
    assert engine.documents().count() == 1 and engine.store.facts().count() == 1 and engine.store.latest_reports().count() == 0


def test_page_ranges(spark):
    pages = spark.createDataFrame([("d", k, "t", ["b"], []) for k in range(4)], "doc_id string, page_number int, raw_text string, blocks array<string>, tables array<string>")
    assert page_range(pages, 1, 2).count() == 2 and page_range(pages).count() == 4
    for low, high in ((3, 9), (2, 1), (-1, 2)):
        with pytest.raises(ValueError):
            page_range(pages, low, high)
    assert tuple(page_stats(pages).first()) == ("d", 4, 4, 0)
