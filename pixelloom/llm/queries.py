"""The queries of this package, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align_tokens, chat_format, decontaminate, hard_negatives, license_scan, line_dedup, mixing, pieces, pii, quality_rules, secret_scan, simhash, weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_licenses": license_scan.op8_licenses,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quality_classifier": weak_quality.op10_quality_classifier,
    "op11_align_tokens": align_tokens.op11_align_tokens,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_pieces": pieces.op13_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.oracle_sql(),
    "op3_chat_format": chat_format.oracle_sql(),
    "op4_line_dedup": line_dedup.oracle_sql(),
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op9_mix_sources": mixing.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
}
