"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive_ann, alignment, bpe, crf_quality, importance, licenses, line_dedup, mixing, ngram_join, pii, quality_rules, sharding, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
        "op2_additive_ann": additive_ann.op2_additive_ann,
        "op3_bpe_roundtrip": bpe.op3_bpe_roundtrip,
        "op4_proportional_sharding": sharding.op4_proportional_sharding,
        "op5_quality_cascade": quality_rules.op5_quality_cascade,
        "op6_pii_spans": pii.op6_pii_spans,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_crf_quality": crf_quality.op10_crf_quality,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
        "op4_proportional_sharding": sharding.OP4_SQL,
        "op5_quality_cascade": quality_rules.OP5_SQL,
        "op7_source_mixing": mixing.OP7_SQL,
        "op11_line_dedup": line_dedup.OP11_SQL,
    }
