"""The queries of this package's operators, and their SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import html, langid, merkle, mixing, packing, pii, quality, runs, simhash, substrings, tokencount, tokenfile, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": topk.op1_top_k,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_main_text": html.op3_main_text,
        "op4_language_id": langid.op4_language_id,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_token_file": tokenfile.op6_token_file,
        "op7_packing": packing.op7_packing,
        "op8_mixing": mixing.op8_mixing,
        "op9_pii": pii.op9_pii,
        "op10_simhash": simhash.op10_simhash,
        "op11_runs": runs.op11_runs,
        "op12_merkle": merkle.op12_merkle,
        "op13_substrings": substrings.op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": topk.ORACLE, "op2_quality_rules": quality.ORACLE, "op8_mixing": mixing.ORACLE, "op12_merkle": merkle.ORACLE, "op13_substrings": substrings.ORACLE}
