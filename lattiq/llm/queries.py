"""Registry of this subpackage's queries and of their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import ann, bpe, collocations, exact_dedup, html_extraction, language_id, license_scan, lm_scoring, mixing, ngram_join, resampling, substring_dedup, suffix_array_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_array_dedup": suffix_array_dedup.op5_suffix_array_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_ann": ann.op8_ann,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_bpe": bpe.op10_bpe,
    "op11_collocations": collocations.op11_collocations,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op5_suffix_array_dedup": suffix_array_dedup.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_license_scan": license_scan.SQL,
    "op11_collocations": collocations.SQL,
}
