"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, decontaminate, license_scan, line_quality, near_dup, packing, periodic_runs, pii, quality_vote, token_files, token_rollup, toxicity, warc_store

QUERIES = {
    "op1_token_rollup": token_rollup.op1_token_rollup,
    "op2_pu_toxicity": toxicity.op2_pu_toxicity,
    "op3_bootstrapped_pii": pii.op3_bootstrapped_pii,
    "op4_hilbert_packing": packing.op4_hilbert_packing,
    "op5_fm_index": decontaminate.op5_fm_index,
    "op6_line_frequency": line_quality.op6_line_frequency,
    "op7_rare_token_licenses": license_scan.op7_rare_token_licenses,
    "op8_warc_content_store": warc_store.op8_warc_content_store,
    "op9_odd_sketch_near_dup": near_dup.op9_odd_sketch_near_dup,
    "op10_neighbour_vote": quality_vote.op10_neighbour_vote,
    "op11_simple8b_token_files": token_files.op11_simple8b_token_files,
    "op12_block_norm_centroids": centroids.op12_block_norm_centroids,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    # Columns of the queries above that SQL can express by themselves.
    "license_base": license_scan.license_base,
    "pii_base": pii.pii_base,
    "token_words": token_rollup.token_words,
}
ORACLES = {
    "op5_fm_index": decontaminate.OP5_SQL,
    "op6_line_frequency": line_quality.OP6_SQL,
    "op8_warc_content_store": warc_store.OP8_SQL,
    "op9_odd_sketch_near_dup": near_dup.OP9_SQL,
    "op12_block_norm_centroids": centroids.OP12_SQL,
    "license_base": license_scan.BASE_SQL,
    "pii_base": pii.BASE_SQL,
    "token_words": token_rollup.WORDS_SQL,
}
