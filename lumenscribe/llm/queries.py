"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from lumenscribe.llm import decontam, fingerprints, licenses, mixing, near_dup, sharding, substring, token_counts, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_minhash_near_dedup": near_dup.op10_minhash_near_dedup,
}
SQL = {
    "op1_sharding": sharding.SQL,
    "op2_warc": warc.SQL,
    "op3_mixing": mixing.SQL,
    "op4_benchmark_decontamination": decontam.SQL,
    "op5_substring_dedup": substring.SQL,
    "op8_license_scans": licenses.SQL,
}
