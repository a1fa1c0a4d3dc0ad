"""Blobs and buckets of the n-gram join: bounded at every size, also where many
rows share a doc_id or a text."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from evolve.llm import ngram_join
from test_operators import brute_components, rows_of, sets_of


def test_rows_of_one_id_are_dealt_apart(spark):
    """A third of all rows share a doc_id, with many texts; a third are copies
    of one text, some of them whole rows repeated."""
    rnd = random.Random(11)
    text = lambda: " ".join(f"w{rnd.randint(0, 900)}" for _ in range(30))
    copy, near = text(), text().split()
    rows = [(500, text()) for _ in range(200)] + [(500, " ".join(near[:-1] + ["x"]))]
    rows += [(900 + i % 150, copy) for i in range(200)]
    rows += [(5000 + i, text()) for i in range(150)] + [(4999, " ".join(near)), (6000, None), (None, copy), (6001, " ")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(ngram_join.ngram_join(df)) == brute_components(sets_of(df))


def test_a_hot_id_fills_no_blob(spark):
    n, blobs = 100_000, 100
    df = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    dealt = ngram_join.keyed(df).groupBy(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(blobs)).alias("blob")).count()
    assert dealt.agg(F.max("count")).first()[0] < 2 * n / blobs


def test_a_task_sends_each_text_with_falling_ids_only():
    rows = [(5, "a", 1), (5, "a", 1), (7, "a", 1), (3, "a", 1), (3, "b", 2), (9, "b", 2), (3, "a", 1)]
    columns = [list(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.int64())],
        ["doc_id", "text", "text_key"])
    got = [tuple(r.values()) for b in ngram_join.first_of_texts([batch, batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert got == [(5, "a", 1), (3, "a", 1), (3, "b", 2)]


def test_forgotten_texts_are_sent_again(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEEN_TEXTS", 2)
    monkeypatch.setattr(ngram_join, "BLOB_BYTES", 300)
    monkeypatch.setattr(ngram_join, "BUCKET_KEYS", 40)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows = [(i, " ".join(words * 3 + [f"t{i % 5}"])) for i in range(30)] + [(99, "alone here as a text"), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(ngram_join.ngram_join(df)) == brute_components(sets_of(df))


def test_blobs_and_buckets_stay_bounded_as_the_table_grows():
    for rows in (0, 1, 1000, 10 ** 6, 10 ** 8, 10 ** 10, 10 ** 12):
        n_bytes, shingles = rows * 5000, rows * 700
        blobs, buckets = ngram_join.blob_counts(rows, n_bytes, shingles)
        assert n_bytes / blobs <= ngram_join.BLOB_BYTES and shingles / buckets <= ngram_join.BUCKET_KEYS
        assert blobs >= 1 and 1 <= buckets < 2 ** 31
