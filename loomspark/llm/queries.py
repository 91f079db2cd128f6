"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import chat, decontaminate, exact_dedup, hard_negatives, host_rules, html_extract, lines, packing, quality, resampling, secrets, simhash, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_cost_balanced_packing": packing.op2_cost_balanced_packing,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_min_cut_extraction": html_extract.op4_min_cut_extraction,
        "op5_neighbour_quality": quality.op5_neighbour_quality,
        "op6_transcript_roles": chat.op6_transcript_roles,
        "op7_recompression": substrings.op7_recompression,
        "op8_positional_index": decontaminate.op8_positional_index,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_chunked_resampling": resampling.op12_chunked_resampling,
        "op13_host_rules": host_rules.op13_host_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_chunked_resampling": resampling.ORACLE_SQL, "op13_host_rules": host_rules.ORACLE_SQL}
