"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodging.llm import (
    embed_dedup,
    exact_dedup,
    fingerprints,
    language,
    merkle,
    packing,
    passages,
    quality,
    secrets,
    sentencepiece_codec,
    simhash,
    token_counts,
    vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_quality": quality.op2_quality,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_passages": passages.op5_passages,
        "op6_packing": packing.op6_packing,
        "op7_language": language.op7_language,
        "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
        "op9_simhash": simhash.op9_simhash,
        "op10_embeddings": embed_dedup.op10_embeddings,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; tests/llm checks the others by brute force."""
    return {
        "op5_passages": passages.OP5_SQL,
        "op10_embeddings": embed_dedup.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
