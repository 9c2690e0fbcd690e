"""The operators' queries by name, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import chat, decontaminate, langid, packing, pii, planes, quality, secrets, simhash, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bm25_decontamination": decontaminate.query,
        "op2_hmm_chat_format": chat.query,
        "op3_guess_cost_secrets": secrets.query,
        "op4_hierarchical_language": langid.query,
        "op5_harmonic_packing": packing.query,
        "op6_simhash_pigeonhole": simhash.query,
        "op7_weak_supervision_pii": pii.query,
        "op8_suffix_repeats": suffix.query,
        "op9_bit_plane_output": planes.query,
        "op10_quality_ledger": quality.query,
        "quality_ablations": quality.ablations_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_ledger": quality.ORACLE_SQL, "quality_ablations": quality.ABLATIONS_SQL}
