"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from paperlake.llm import bpe, decontaminate, html_text, jaccard_join, license_scan, line_dedup, quality_classifier, quality_rules, substring_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_bpe": bpe.op3_bpe,
    "op4_html_text": html_text.op4_html_text,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_warc_revisits": warc.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
}
