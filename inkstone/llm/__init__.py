"""Operators for large text corpora: filtering, deduplication, decontamination, mixing, sharding, formatting.

Nothing outside this subpackage and `corpus_pipeline.py` imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import chat, decontaminate, jaccard_join, licenses, mixing, quality_model, quality_rules, repeats, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_feistel_sharding": sharding.op2_feistel_sharding,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_licenses": licenses.op4_licenses,
        "op5_chat": chat.op5_chat,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_mixing": mixing.op7_mixing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_repeats": repeats.op9_repeats,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.oracle()}
