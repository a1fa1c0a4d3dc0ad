"""Line de-duplication (DataFrame functions only).

Lines are hashed and range-partitioned by hash with document and position as
the secondary sort; one pass over the sorted rows streams the first holder of
each line, and every later holder's position becomes a cleared bit.  The
result is a compressed keep bitmap per document instead of text, and
``apply_bitmaps`` cuts the texts with it.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in
lower case; keys are compared by two 64-bit hashes.  A key of at least
``min_chars`` code points held by two or more documents keeps its lines only
in the smallest doc_id that holds it (all of them, if it repeats there).

The line hashes (about 40 bytes a line) go once into the shared checkpoint
folder, since the steps below read them several times; the texts are read
once for the hashes and once for the cut.

Very common lines: a key on a large share of all lines would be one key of
the range exchange, i.e. one task.  Frequent-item sketches over ``SKETCHES``
parts of the lines name ``HOT_KEYS`` frequent hashes each (a fixed number, so
that list and the smallest holder of each may be broadcast); their smallest
holder is a min with map-side partial results, their lines are judged where
they are read, and only the other lines go through the exchange.  A key that
every sketch leaves out holds at most about 1 / ``HOT_KEYS`` of the lines.  Which keys are
named never changes a result, only the route.

Defined results: null or empty text is one empty line; a null doc_id neither
holds nor loses lines; rows that share a doc_id are one holder, each with a
bitmap of its own (identical rows have identical bitmaps); an empty table
gives an empty result; extra columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.llm.common import cut
from evolve.llm.quality_rules import SPACE, UPPER

MIN_CHARS = 10
HOT_KEYS = 1024
TRACKED = 8192
SKETCHES = 16


def _line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per long enough line: ``doc_id, rev`` (hash of the text, tells
    rows with one doc_id apart), ``pos`` (from 0), ``h1, h2``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = F.transform(F.split(text, "\n"), _line_key)
    numbered = F.transform(keys, lambda k, i: F.struct(i.alias("pos"), F.length(k).alias("n"),
                                                       F.xxhash64(k).alias("h1"),
                                                       F.xxhash64(F.lit(1), k).alias("h2")))
    return (docs.where(F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("rev"),
                    F.explode(F.filter(numbered, lambda x: x["n"] >= min_chars)).alias("l"))
            .select("doc_id", "rev", "l.pos", "l.h1", "l.h2"))


def _frequent(lines: DataFrame) -> DataFrame:
    """At most SKETCHES * HOT_KEYS frequent hashes: the most frequent ones of
    each of SKETCHES parts of the lines, by a frequent-item sketch."""
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCHES))
    tops = lines.groupBy(part.alias("part")).agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})").alias("top"))
    return tops.select(F.explode(F.filter("top", lambda t: t["count"] > 1)).alias("t")).select(
        F.col("t.item").alias("h1")).distinct()


def dropped_lines(lines: DataFrame) -> DataFrame:
    """The lines that go: ``doc_id, rev, pos``."""
    hot = F.broadcast(_frequent(lines))
    # at most SKETCHES * HOT_KEYS keys (times hash collisions of h1), so broadcast
    holders = (lines.join(hot, "h1", "left_semi").groupBy("h1", "h2")
               .agg(F.min("doc_id").alias("first_holder")))
    marked = lines.join(F.broadcast(holders), ["h1", "h2"], "left")
    of_hot = marked.where(F.col("doc_id") > F.col("first_holder")).select("doc_id", "rev", "pos")
    rest = marked.where(F.col("first_holder").isNull()).select("h1", "h2", "doc_id", "rev", "pos")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rest.repartitionByRange(n, "h1", "h2")
    in_order = Window.partitionBy("h1", "h2").orderBy("doc_id", "rev", "pos")
    streamed = ranged.withColumn("first_holder", F.first("doc_id").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return of_hot.unionByName(streamed.where(F.col("doc_id") > F.col("first_holder"))
                              .select("doc_id", "rev", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, rev, n_dropped, keep``: the compressed bitmap of every
    document that loses a line.  ``keep`` is an array of (word, bits) by word:
    bit p % 64 of word p / 64 is 1 if line p stays; a word that is absent has
    64 lines that all stay, and a document that is absent stays whole."""
    lines = cut(line_hashes(docs, min_chars, id_col, text_col))
    gone = dropped_lines(lines).repartition("doc_id", "rev")  # serves both aggregates and the join
    words = gone.groupBy("doc_id", "rev", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("lost"))
    return words.groupBy("doc_id", "rev").agg(
        F.sum(F.bit_count("lost")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"))


def _flags(keep):
    """The bitmap as one boolean per line, as far as its last stored word."""
    before = F.concat(F.array(F.struct(F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"))),
                      F.slice(keep, 1, F.size(keep) - 1))
    runs = F.zip_with(keep, before, lambda k, b: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), k["word"] - b["word"] - 1), F.array(k["bits"])))
    return F.flatten(F.transform(F.flatten(runs), lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w, i) == 1)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` as one struct ``row`` per document, with ``n_lines``,
    ``n_dropped`` and ``kept`` (the text that stays)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("rev"), text.alias("_text"))
    j = d.join(bitmaps, ["doc_id", "rev"], "left")
    lines = F.split("_text", "\n")
    flags = F.transform(F.array(_flags(F.col("keep"))), lambda f: F.slice(f, 1, F.size(lines)))[0]
    staying = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("flag")),
                       lambda x: F.coalesce(x["flag"], F.lit(True)))
    kept = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(staying, lambda x: x["line"]), "\n"))
    return j.select("row", F.size(lines).cast("long").alias("n_lines"),
                    F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines gone from ``text`` and ``n_chars`` (if there)
    counted anew; every other column stays."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame) -> DataFrame:
    """The query's rows for every document."""
    d = docs.select("doc_id", "text")
    return apply_bitmaps(d, keep_bitmaps(d)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
