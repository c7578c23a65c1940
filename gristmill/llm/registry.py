"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

import corpus_pipeline
from gristmill.llm import op1_revisits, op2_quality, op3_mixing, op4_caps, op5_token_files, op6_toxicity, op7_simhash, op8_rules, op9_bpe, op10_sharding

QUERIES = {
    "op1_resolve_revisits": op1_revisits.query,
    "op2_quality_trees": op2_quality.query,
    "op3_mix_sources": op3_mixing.query,
    "op4_cap_filters": op4_caps.query,
    "op5_token_files": op5_token_files.query,
    "op6_compression_distance": op6_toxicity.query,
    "op7_simhash_gray": op7_simhash.query,
    "op8_rule_list": op8_rules.query,
    "op9_bpe_matrices": op9_bpe.query,
    "op10_claimed_slots": op10_sharding.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op1_resolve_revisits": op1_revisits.ORACLE, "op3_mix_sources": op3_mixing.ORACLE, "op10_claimed_slots": op10_sharding.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
