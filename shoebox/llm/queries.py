"""Queries of this subpackage for the driver contract, and their SQL."""

from __future__ import annotations

from . import ann, exact_dedup, license_scan, minhash, mixing, piece_sampling, token_counts, token_files, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_sentencepiece_sampling": piece_sampling.op8_sentencepiece_sampling,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_token_files": token_files.op10_token_files,
}

ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
}
