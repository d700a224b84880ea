"""Queries of the training-data operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import decontamination, embedding_dedup, language_id, minhash_dedup, packing, pii, quality, sharding, substring_dedup, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_curve_packing": packing.op2_curve_packing,
    "op3_chunked_warc": warc.op3_chunked_warc,
    "op4_projection_forest": embedding_dedup.op4_projection_forest,
    "op5_surrogates": pii.op5_surrogates,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_hyperdimensional_language": language_id.op7_hyperdimensional_language,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_pu_quality": quality.op10_pu_quality,
}
ORACLES = {
    "op1_decontamination": decontamination.SQL,
    "op3_chunked_warc": warc.SQL,
    "op4_projection_forest": embedding_dedup.SQL,
    "op8_minhash_dedup": minhash_dedup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
}
