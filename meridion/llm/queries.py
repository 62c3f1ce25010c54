"""Queries of this subpackage and their SQL (none where SQL cannot express the operator)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from meridion.llm import exactdedup, langid, mixing, neardup, packing, pseudonyms, substring, suffixarray, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.pack_query,
        "op2_ngram_join": neardup.join_query,
        "op3_pseudonyms": pseudonyms.pseudonym_query,
        "op4_language_id": langid.language_query,
        "op5_substring_dedup": substring.substring_query,
        "op6_warc": warc.warc_query,
        "op7_topk": topk.topk_query,
        "op8_exact_dedup": exactdedup.dedup_query,
        "op9_suffix_array_dedup": suffixarray.suffix_query,
        "op10_mixing": mixing.mix_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op6_warc": warc.ORACLE, "op7_topk": topk.ORACLE, "op8_exact_dedup": exactdedup.ORACLE, "op10_mixing": mixing.ORACLE}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
