"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentia.llm import (alignment, decontamination, jaccard_join, langid, language_model, lexical_search, packing, quality_rules,
                          secrets, suffix_dedup, token_counts, token_files, toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_language_model": language_model.op3_language_model,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_secrets": secrets.op6_secrets,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_language_id": langid.op8_language_id,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_alignment": alignment.op12_alignment,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op9_decontamination": decontamination.SQL, "op11_lexical_search": lexical_search.SQL}
