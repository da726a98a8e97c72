"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from tarnmill.llm import decontamination, embedding_dedup, license_scan, packing, sharding, simhash, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_license_scan": license_scan.query,
    "op4_toxicity": toxicity.query,
    "op5_sharding": sharding.query,
    "op6_token_counts": token_counts.query,
    "op7_simhash": simhash.query,
    "op8_warc": warc.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_decontamination": decontamination.query,
}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.oracle(), "op8_warc": warc.ORACLE}
