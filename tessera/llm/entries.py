"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, fim, minhash, pii, quality, secrets, sharding, substrings, suffixes, topk, toxicity, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_quality": quality.op2_quality,
        "op3_minhash": minhash.op3_minhash,
        "op4_pii": pii.op4_pii,
        "op5_bpe": bpe.op5_bpe,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_topk": topk.op9_topk,
        "op10_sharding": sharding.op10_sharding,
        "op11_fim": fim.op11_fim,
        "op12_spelling": variants.op12_spelling,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": topk.OP9_SQL, "op11_fim": fim.OP11_SQL}
