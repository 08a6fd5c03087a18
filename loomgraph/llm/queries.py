"""The registered queries of the corpus operators and their check SQL."""

from __future__ import annotations

from loomgraph.llm import bpe, decontam, html_text, minhash, pii, quality, resample, secret_scan, sharding, substring, suffix, token_count, vector_codes
from loomgraph.llm.common import table
from loomgraph.llm.oracle import ORACLE  # noqa: F401

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


QUERIES = {
    "op1_sharding": lambda spark, d: sharding.report(table(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality.verdicts(table(spark, d, "documents")),
    "op3_html_text": lambda spark, d: html_text.report(table(spark, d, "pages")),
    "op4_near_duplicates": lambda spark, d: minhash.report(table(spark, d, "documents")),
    "op5_personal_data": lambda spark, d: pii.report(table(spark, d, "documents")),
    "op6_secrets": lambda spark, d: secret_scan.report(table(spark, d, "documents")),
    "op7_bpe": lambda spark, d: bpe.report(table(spark, d, "documents"), vocabulary_path()),
    "op8_substring_dedup": lambda spark, d: substring.report(table(spark, d, "documents")),
    "op9_suffix_dedup": lambda spark, d: suffix.report(table(spark, d, "documents")),
    "op10_benchmark_overlaps": lambda spark, d: decontam.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_token_count": lambda spark, d: token_count.report(table(spark, d, "documents"), vocabulary_path()),
    "op12_importance_resampling": lambda spark, d: resample.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_vector_codes": lambda spark, d: vector_codes.report(table(spark, d, "embeddings")),
}
