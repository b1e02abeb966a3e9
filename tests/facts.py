"""Small fact tables for tests."""

from __future__ import annotations

from claimweave import schemas

DEFAULTS = {
    "subject": "Acme", "predicate": "revenue", "value": "100", "numeric_value": None, "unit": None, "base_unit": None, "scale": 0, "dimension": None,
    "canonical_value": None, "canonical_unit": None, "temporal": "FY2022", "scope": None, "conditions": None, "confidence": 0.9, "page": 1,
    "evidence_quote": "q", "verified": True, "match_type": "exact", "doc_id": "doc1",
}


def facts(spark, rows):
    seq: dict = {}
    out = []
    for row in rows:
        r = DEFAULTS | row
        if "canonical_value" in row and "value" not in row:
            r["value"] = str(row["canonical_value"])
        n = seq[r["doc_id"]] = seq.get(r["doc_id"], -1) + 1
        r |= {"fact_seq": n, "fact_id": f"{r['doc_id']}#{n}"}
        if r["canonical_value"] is not None:
            r["canonical_value"] = float(r["canonical_value"])
        out.append(r)
    names = [c.strip().split(" ")[0] for c in schemas.FACT.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in out], schemas.FACT)
