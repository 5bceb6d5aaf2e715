"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from weirflow.llm import (
    decontaminate,
    langid,
    line_dedup,
    minhash,
    mixing,
    rlz_dedup,
    secrets,
    suffix_dedup,
    topk,
    urls,
)

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_url_filters": urls.query,
    "op6_line_dedup": line_dedup.query,
    "op7_language_id": langid.query,
    "op8_exact_top_k": topk.query,
    "op9_secret_scans": secrets.query,
    "op10_substring_dedup": rlz_dedup.query,
}

ORACLES = {
    "op4_minhash_near_dedup": minhash.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_exact_top_k": topk.ORACLE,
}
