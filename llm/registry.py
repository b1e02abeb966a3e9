"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import op1_licenses, op2_suffix, op7_secrets, op8_minhash, op9_substring, op10_rules
from .op1_licenses import op1_license_scan
from .op10_rules import op10_quality_rules
from .op2_suffix import op2_suffix_dedup
from .op3_decontaminate import op3_decontamination
from .op4_quality import op4_quality_rules
from .op5_toxicity import op5_toxicity
from .op6_packing import op6_packing
from .op7_secrets import op7_secret_scan
from .op8_minhash import op8_minhash_hamming
from .op9_substring import op9_substring_dedup

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_minhash_hamming": op8_minhash_hamming,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": op1_licenses.ORACLE,
    "op2_suffix_dedup": op2_suffix.ORACLE,
    "op7_secret_scan": op7_secrets.ORACLE,
    "op8_minhash_hamming": op8_minhash.ORACLE,
    "op9_substring_dedup": op9_substring.ORACLE,
    "op10_quality_rules": op10_rules.ORACLE,
}
