"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, hmm, html_extract, langid, mixing, ngram_join, packing, pii, topk_search, toxicity

_OPERATORS = {
    "op1_html_extract": html_extract,
    "op2_ngram_jaccard_join": ngram_join,
    "op3_mix_sources": mixing,
    "op4_fingerprints": fingerprints,
    "op5_language_id": langid,
    "op6_pii_semi_markov": pii,
    "op7_toxicity": toxicity,
    "op8_pack_windows": packing,
    "op9_hmm_scores": hmm,
    "op10_topk_search": topk_search,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _OPERATORS.items() if getattr(module, "ORACLE_SQL", None)}
