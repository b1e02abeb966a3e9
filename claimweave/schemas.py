"""Table layouts, as DDL."""

FACT = (
    "fact_id string, doc_id string, fact_seq int, subject string, predicate string, value string, numeric_value double, unit string, "
    "base_unit string, scale int, dimension string, canonical_value double, canonical_unit string, temporal string, scope string, "
    "conditions string, confidence double, page int, evidence_quote string, verified boolean, match_type string"
)
RAW_FACT = (
    "subject string, predicate string, value string, numeric_value double, base_unit string, scale int, dimension string, "
    "temporal string, scope string, conditions string, evidence_quote string, page_number int"
)
RAW_FACTS = f"struct<facts:array<struct<{RAW_FACT.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
PAGE = f"doc_id string, page_number int, raw_text string, blocks array<string>, tables array<{TABLE}>"
DOCUMENT = "doc_id string, filename string, page_count int, created_at timestamp"
EDGE = "cluster_id string, ordinal long, src string, tgt string, edge_type string, detection_method string, confidence double, explanation string"
WORD = "doc_id string, page int, seq int, word string, x0 double, y0 double, x1 double, y1 double"
REPORT = "doc_id string, cross_doc_id string, created_at timestamp, total_facts long, edges string"
