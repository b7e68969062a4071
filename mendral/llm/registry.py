"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, language_id, licenses, merkle, mixing, pii, quality, resampling, sentencepiece_lattice, sharding, syncmers, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": syncmers.op1_document_fingerprints,
    "op2_sentencepiece": sentencepiece_lattice.op2_sentencepiece,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pii": pii.op9_pii,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_embedding_near_dedup": vector_dedup.op13_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_pii": pii.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
}
