"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count).
A run joins the digests of its documents with it, encodes each distinct text
that is missing once, appends those counts, and answers every document from
the cache.  The tokenizer digest covers the vocabulary file and the library's
version, so another tokenizer never meets foreign counts.

The content digest is the SHA-256 of the text's UTF-8; the only normalisation
is null to the empty text, as any other could change a count.  An append is
one Spark write: a lost executor's part is written again, and a count that
two runs append at once is the same in both and read once.

Defined results: null text counts as the empty text (0 tokens); repeated
rows each get their row back; a null doc_id is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolve.llm.common import shared_path, ship, slices
from evolve.llm.tokens import load, public_path, version_of

MODEL = "byte_bpe_50k.json"
LIMIT = 512
CACHE = "content binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The counts stored for one tokenizer: ``content, n_tokens``."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # nothing stored yet
        stored = spark.createDataFrame([], CACHE)
    return (stored.where(F.col("tokenizer") == tokenizer)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text"))


def encode_misses(keyed: DataFrame, known: DataFrame, model_path: str) -> DataFrame:
    """``content, n_tokens`` of the distinct texts without a stored count."""
    ship(keyed.sparkSession)
    missing = (keyed.select("content", "text").join(known.select("content"), "content", "left_anti")
               .groupBy("content").agg(F.first("text").alias("text")))  # partial: copies fold before the shuffle

    def run(batches):
        tok = load(model_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(tok.ids(t.as_py())) for t in b.column(1)], pa.int64())],
                ["content", "n_tokens"])

    return missing.mapInArrow(run, "content binary, n_tokens long")


def counted(docs: DataFrame, cache_path: str, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every document; appends to the cache
    (this runs the write)."""
    spark, model_path = docs.sparkSession, model_path or public_path(MODEL)
    tokenizer = version_of(model_path)
    keyed = digests(docs)
    new = encode_misses(keyed, read_cache(spark, cache_path, tokenizer), model_path)
    (new.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache_path))
    return (keyed.drop("text").join(read_cache(spark, cache_path, tokenizer), "content", "left")
            .select("doc_id", "n_bytes", "n_tokens"))


def token_counts(docs: DataFrame, cache_path: str | None = None) -> DataFrame:
    """The query's rows; without a path, a new cache in the shared folder."""
    path = cache_path or shared_path(docs.sparkSession, "token-counts")
    return counted(docs.select("doc_id", "text"), path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
