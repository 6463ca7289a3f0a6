"""Queries and their SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, merkle, pii, quality, suffix_dedup, token_store, warc, whitening

QUERIES = {
    "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_token_store": token_store.op5_token_store,
    "op6_bpe": bpe.op6_bpe,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_language_id": language_id.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_pii": pii.op12_pii,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard_join.OP1_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
