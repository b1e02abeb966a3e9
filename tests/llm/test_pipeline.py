"""The pipeline stage by stage against what each stage must do."""

from __future__ import annotations

from collections import defaultdict

import corpus as c
import corpus_pipeline as p
from test_llm_operators import groups

from llm.common import written


def test_stages(spark, tmp_path):
    path = c.write(spark, tmp_path, extra=False)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, path), name)
        if name != "packing":
            assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = set(before) - kept[name]
        if name == "toxicity":
            toxic = {i for i, t in before.items() if t and any(x in t for x in c.TOXIC)}
            assert gone == toxic
        elif name == "near_dedup":
            want = groups(list(before.items()), 5)
            assert gone == {i for i, (_, root) in want.items() if i != root}
        elif name == "decontamination":
            held = {i for i, t in before.items() if t and any(x and x in t for _, x in c.items())}
            assert held <= gone and len(gone - held) <= 3
        elif name == "secrets":
            assert not gone and not any("AKIA" in (r.text or "") for r in docs.collect())
        else:
            assert not gone
    places = defaultdict(int)
    for r in docs.collect():
        places[r.sequence_id] += r.length
    assert sorted(places.values())[1:] == [2048] * (len(places) - 1)


def test_run_and_empty(spark, tmp_path):
    full = c.write(spark, tmp_path / "full")
    assert p.run(spark, full).count() > 50
    assert p.run(spark, c.write(spark, tmp_path / "none", docs=[], bench=[], marks=[])).count() == 0
