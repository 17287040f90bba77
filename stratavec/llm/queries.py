"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratavec.llm import (
    bpe_prefix,
    chat,
    filter_audit,
    html_cut,
    licenses,
    line_dedup,
    packing,
    personal_data,
    quality_rules,
    simhash,
    subword_classifier,
    topk,
    turn_repair,
)
from stratavec.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_exact_topk": lambda spark, d: topk.nearest(table(spark, d, "embeddings")),
    "op2_preference_format": lambda spark, d: chat.preference_rows(table(spark, d, "conversations")),
    "op3_quality_classifier": lambda spark, d: subword_classifier.classify(
        table(spark, d, "documents"), table(spark, d, "labels")
    ),
    "op4_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
    "op5_html_extraction": lambda spark, d: html_cut.extract(table(spark, d, "pages")),
    "op6_quality_rules": lambda spark, d: quality_rules.verdicts(table(spark, d, "documents")),
    "op7_bpe_round_trip": lambda spark, d: bpe_prefix.round_trip(table(spark, d, "documents")),
    "op8_best_fit_packing": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "op9_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: line_dedup.deduplicated_lines(table(spark, d, "documents")),
    "op11_turn_repair": lambda spark, d: turn_repair.repair_report(
        table(spark, d, "conversations")
    ),
    "op12_filter_audit": lambda spark, d: filter_audit.audit(
        table(spark, d, "documents"), table(spark, d, "labels")
    ),
    "op13_personal_data": lambda spark, d: personal_data.personal_data(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": topk.ORACLE,
    "op2_preference_format": chat.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_personal_data": personal_data.ORACLE,
}
