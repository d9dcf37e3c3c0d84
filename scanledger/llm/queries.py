"""The queries of this folder: one for each operator, and the pipeline; with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from scanledger.llm import decontamination, hyper_langid, impact_search, itq_dedup, jaccard_join, maxent_lm, merkle_manifest, secret_ownership, source_mixing, substring_dedup, suffix_pieces, viterbi_counts, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1,
    "op2_viterbi_counts": viterbi_counts.op2,
    "op3_impact_search": impact_search.op3,
    "op4_secret_ownership": secret_ownership.op4,
    "op5_source_mixing": source_mixing.op5,
    "op6_itq_dedup": itq_dedup.op6,
    "op7_hyper_langid": hyper_langid.op7,
    "op8_suffix_pieces": suffix_pieces.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_maxent_lm": maxent_lm.op10,
    "op11_prefix_decontamination": decontamination.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_merkle_manifest": merkle_manifest.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op3_impact_search": impact_search.ORACLE,
    "op4_secret_ownership": secret_ownership.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op11_prefix_decontamination": decontamination.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
