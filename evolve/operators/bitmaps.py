"""Histories as version bitmaps: gaps, latest version and missing DOWN scripts
by bit arithmetic, without a window or a sort of history rows.

A target's versions are kept as rows of 64-bit words, one row per 64 versions
that hold any: ``target_id, word, present, succeeded``; bit ``version % 64`` of
word ``version / 64``.  A word is an OR over history rows, so it is a hash
aggregate with map-side partial results (two longs a key, however often a
version was written), and two tables of words - of two batches, two regions -
merge by OR into the words of their union.  Words grow with the versions in
use; Spark's own bitmap aggregates hold 4 KB for every target, since they have
32,768 positions each.

What needs a target's words together (gaps cross word borders) gathers them in
one array of at most 1,024 words (versions end at 65,535), sorted in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def _bit(version) -> Column:
    return F.expr(f"shiftleft(1L, {version} & {WORD - 1})")


def word_columns() -> list[Column]:
    """The aggregates of a word over history rows."""
    ok = F.bit_or(F.when(F.col("success"), _bit("version")))
    return [F.bit_or(_bit("version")).alias("present"), F.coalesce(ok, F.lit(0).cast("long")).alias("succeeded")]


def word_list() -> Column:
    """The aggregate of a target's words in order."""
    return F.array_sort(F.collect_list(F.struct("word", "present", "succeeded"))).alias("words")


def version_words(history: DataFrame) -> DataFrame:
    """``target_id, word, present, succeeded`` of a history (any batch of it)."""
    return history.groupBy("target_id", F.shiftright("version", 6).alias("word")).agg(*word_columns())


def merge_words(*words: DataFrame) -> DataFrame:
    """The words of the union of several batches."""
    union = words[0]
    for w in words[1:]:
        union = union.unionByName(w)
    return union.groupBy("target_id", "word").agg(F.bit_or("present").alias("present"),
                                                  F.bit_or("succeeded").alias("succeeded"))


def word_lists(words: DataFrame) -> DataFrame:
    """``target_id, words``: each target's words in order, at most 1,024."""
    return words.groupBy("target_id").agg(word_list())


def _below(i) -> Column:
    """The bits below position i (0 to 63)."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), i))


def _highest(bits) -> Column:
    """The position of the highest bit set (-1 for 0)."""
    return F.when(bits == 0, F.lit(-1)).otherwise(F.length(F.bin(bits)) - 1)


def _positions(bits) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(bits, i) == 1)


def _breaks(word, before) -> Column:
    """The bits of a word whose version doesn't follow the one below it:
    version 1 and what follows a present version are no breaks.  ``before`` is
    the target's previous word or null."""
    carried = F.coalesce((before["word"] == word["word"] - 1) & (F.getbit(before["present"], F.lit(WORD - 1)) == 1),
                         F.lit(False))
    carry = F.when(carried, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    first = F.when(word["word"] == 0, F.lit(2).cast("long")).otherwise(F.lit(0).cast("long"))  # version 1
    follows = F.shiftleft(word["present"], 1).bitwiseOR(carry).bitwiseOR(first)
    return word["present"].bitwiseAND(F.bitwise_not(follows))


def _with_before(words) -> Column:
    """(word, previous word) pairs of a word list."""
    none = F.lit(None).cast("struct<word:int,present:bigint,succeeded:bigint>")
    return F.arrays_zip(words.alias("w"), F.concat(F.array(none), F.slice(words, 1, F.size(words) - 1)).alias("b"))


def gap_ranges(words) -> Column:
    """The gaps of a word list as ``array<struct<gap_from, gap_to>>``: one per
    present version that follows neither its predecessor nor, as version 1,
    the start.  Version 0 breaks the order too: (1, -1)."""
    def of_word(x):
        word, before = x["w"], x["b"]
        base = word["word"] * WORD
        below = F.coalesce(before["word"] * WORD + _highest(before["present"]), F.lit(0))

        def gap(i):
            lower = _highest(word["present"].bitwiseAND(_below(i)))
            return F.struct((F.when(lower >= 0, base + lower).otherwise(below) + 1).cast("int").alias("gap_from"),
                            (base + i - 1).cast("int").alias("gap_to"))
        return F.transform(_positions(_breaks(word, before)), gap)
    return F.flatten(F.transform(_with_before(words), of_word))


def n_gaps(words) -> Column:
    """How many gaps a word list has (a popcount a word)."""
    return F.aggregate(_with_before(words), F.lit(0), lambda n, x: n + F.bit_count(_breaks(x["w"], x["b"])))


def latest_of(words) -> Column:
    """The highest succeeded version of a word list, 0 if none."""
    return F.aggregate(words, F.lit(0), lambda m, w: F.greatest(
        m, F.when(w["succeeded"] != 0, w["word"] * WORD + _highest(w["succeeded"])).otherwise(0)))


def range_mask(word, lo, hi) -> Column:
    """The bits of a word whose versions lie in (lo, hi]."""
    top, bottom = hi - word * WORD, F.greatest(lo - word * WORD + 1, F.lit(0))
    upto = F.when(top >= WORD - 1, F.lit(-1).cast("long")).otherwise(_below(top + 1))
    return F.when((top < 0) | (bottom > top) | (bottom >= WORD), F.lit(0).cast("long")) \
        .otherwise(upto.bitwiseAND(F.bitwise_not(_below(bottom))))


def versions_of(word, bits) -> Column:
    """The versions of a word's bits as an array."""
    return F.transform(_positions(bits), lambda i: (word * WORD + i).cast("int"))


def history_gap_ranges(words: DataFrame) -> DataFrame:
    """``target_id, gap_from, gap_to`` of a table of words."""
    return word_lists(words).select("target_id", F.inline(gap_ranges(F.col("words"))))


def latest_versions(words: DataFrame, targets: DataFrame) -> DataFrame:
    """The highest succeeded version of every target, 0 if none."""
    return (targets.select("target_id").join(word_lists(words), "target_id", "left")
            .select("target_id", F.coalesce(latest_of(F.col("words")), F.lit(0)).cast("int").alias("latest_version")))


def missing_downs(words: DataFrame, actions: DataFrame, scripts: DataFrame) -> DataFrame:
    """The applied versions inside a down run's range that no DOWN script takes
    back, one word of a target against one word of its project at a time."""
    down = (scripts.where(F.col("direction") == "DOWN")
            .groupBy("project", F.shiftright("version", 6).alias("word")).agg(F.bit_or(_bit("version")).alias("down")))
    runs = actions.where((F.col("action") == "run") & F.col("down")).select(
        "target_id", "project", "destination", "latest_version")
    left = (words.select("target_id", "word", "present").join(runs, "target_id")
            .withColumn("wanted", F.col("present").bitwiseAND(
                range_mask(F.col("word"), F.col("destination"), F.col("latest_version"))))
            .where("wanted != 0").join(down, ["project", "word"], "left")
            .select("target_id", "word", F.col("wanted").bitwiseAND(
                F.bitwise_not(F.coalesce("down", F.lit(0).cast("long")))).alias("bits")))
    return left.where("bits != 0").select("target_id", F.explode(versions_of(F.col("word"), F.col("bits"))).alias("version"))
