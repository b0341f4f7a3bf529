"""The corpus operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, jaccard, language_id, lm_scoring, mixing, pii, quality_rules, repair_ids, sharding, suffix_dedup

QUERIES = {
    "op1_repair_ids": repair_ids.op1,
    "op2_sampled_splitters": sharding.op2,
    "op3_attention_lm": lm_scoring.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_ngram_jaccard_join": jaccard.op5,
    "op6_contextual_pii": pii.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_language_id": language_id.op8,
    "op9_suffix_dedup": suffix_dedup.op9,
    "op10_mixing": mixing.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op10_mixing": mixing.ORACLE}
