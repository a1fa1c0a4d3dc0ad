"""Pipeline over ``documents``: quality rules, line de-duplication, one
document of each near-copy group, secrets masked, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes every stage's result as Parquet into
the session's shared checkpoint folder and hands the reread table to the next
stage, so a stage never runs twice and lost executors cost one stage's tasks
at most.

Defined results: a null or empty text has no word, so the quality rules reject
it; a null doc_id keeps its lines, is linked with nothing and is packed; of
rows that share a doc_id all stay or go together in the near-copy stage, and
each is packed; very long texts go through every stage whole; among copies the
smallest doc_id stays; an empty table gives an empty result; other columns,
whatever their names, come through all stages but the last unchanged
(``n_chars`` is counted anew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evolve.llm import line_dedup, ngram_join, packing, quality_rules, secrets
from evolve.llm.common import shared_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id already has are cut out."""
    return line_dedup.dedup(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8; the query op1 has
    its own figures), the document with the smallest id stays."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token pieces with their places in sequences."""
    return packing.packing(docs)


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# Packing needs a tokenizer, which SQL hasn't; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
