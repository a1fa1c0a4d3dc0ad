"""Registered queries of the thirteen operators and the pipeline:
name -> callable(spark, sf_dir) -> DataFrame.  Each applies one operator with
its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evolve.llm import (bpe, collocations, conversations, html_extract, licenses, line_dedup, ngram_join, packing,
                        quality_rules, secrets, token_counts, topk, url_filters)
from evolve.llm.common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": _over("documents", ngram_join.ngram_join),
    "op2_html_extraction": _over("pages", html_extract.html_extraction),
    "op3_line_dedup": _over("documents", line_dedup.line_dedup),
    "op4_byte_bpe": _over("documents", bpe.bpe),
    "op5_packing": _over("documents", packing.packing),
    "op6_secret_scans": _over("documents", secrets.secret_scans),
    "op7_exact_topk": _over("embeddings", topk.exact_topk),
    "op8_token_counts": _over("documents", token_counts.token_counts),
    "op9_license_scans": _over("documents", licenses.license_scans),
    "op10_quality_rules": _over("documents", quality_rules.quality_rules),
    "op11_conversation_repair": _over("conversations", conversations.conversation_repair),
    "op12_collocations": _over("documents", collocations.collocations),
    "op13_url_filters": _over("pages", url_filters.url_filters),
    "pipeline": _pipeline,
}
