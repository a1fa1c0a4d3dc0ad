"""Phrase collocations per language by SON partitioning.

Documents are dealt into ``SHARDS`` shards.  A phrase that occurs ``support``
times in all occurs at least ``support / SHARDS`` times in one of them, so
every shard is mined completely at that lowered support, the union of the
locally frequent phrases is the list of candidates, and one more pass over all
texts counts the candidates exactly:

1. words and pairs of every shard, counted by key (hash of language and
   phrase, shard);
2. phrases of three words and more whose pairs are all frequent in some shard,
   counted the same way;
3. candidates (frequent in any shard), counted over all shards by the phrase
   itself.

A shard is a label, not a task: every ``SHARDS``-th input partition, so that a
task's partial counts are those of one shard, which are summed over as many
tasks as the data needs.  The passes may deal differently: whatever the deal,
what is frequent in all is frequent in one shard of it.  Texts are cut into
words as bytes with numpy, 2 MB at a time; a batch sends one row per distinct
key.

"Frequent" reaches the next pass as a bit filter (two bits a key, 16 bits of
room a key, at most ``MAX_FILTER_BITS`` in all, which bounds what is collected
and broadcast).  A filter never loses a phrase; what it lets through in
addition is counted exactly and falls to the support at the end.  Beyond its
largest size it lets more through, and the last passes move more rows.

Counts and scores are exact: phrases are grouped as text, hashes only choose
what is counted; products are taken as decimals of 38 digits.

Defined results: a null text is empty, a null language is ``und``; documents
that share an id, and repeated rows, each count; very long texts are worked
through in stretches of ``STRETCH`` words that overlap by the longest phrase;
ties go to the smaller phrase in byte order, equal cuts to the shorter first
part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.llm.common import cut, ship, slices, utf8

SUPPORT = 30
LONGEST = 4
TOP = 2000
SHARDS = 4  # at most 8: the shard stands in the three low bits of a key
MAX_FILTER_BITS = 28
STRETCH = 1 << 18
SLICE = 2 << 20
SALTS = 8
SHARE = 80  # a phrase goes if a longer candidate around it has this % of its count

# Byte classes: 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hash:
    """64-bit hashes of byte ranges from one running sum: the sum of
    code(byte) * base^position over a range, shifted back to its start."""

    BASE = 0x5851F42D4C957F2D
    powers = inverse = np.ones(0, np.uint64)  # shared by all hashes of a worker

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.code = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.powers):
            one, back = np.full(n + n // 4, cls.BASE, np.uint64), np.full(n + n // 4, pow(cls.BASE, -1, 1 << 64), np.uint64)
            one[0] = back[0] = 1
            cls.powers, cls.inverse = np.cumprod(one, out=one), np.cumprod(back, out=back)

    def words(self, body, starts, ends):
        lo, hi = int(starts[0]), int(ends[-1])
        self.reach(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(self.code[body[lo:hi]] * self.powers[:hi - lo], out=sums[1:])
        h = (sums[ends - lo] - sums[starts - lo]) * self.inverse[starts - lo]
        return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _join(first: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x2545F4914F6CDD1D) + nxt)


class Words:
    """The words of a batch of texts: ``starts, ends`` in the lower-cased
    bytes, ``doc``, and ``linked[i]``: word i + 1 follows in the same piece."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        kind = _KIND[body]
        inside = kind == 0
        new = np.zeros(len(body) + 1, bool)
        new[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | new[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:-1]
        self.body = _LOWER[body]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.linked = np.zeros(len(self.starts), bool)
        self.linked[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])

    def stretches(self, longest: int):
        """(first word, words that start a phrase, words with the overlap)."""
        for at in range(0, len(self.starts), STRETCH):
            stop = min(at + STRETCH, len(self.starts))
            yield at, stop - at, min(stop + longest - 1, len(self.starts)) - at

    def phrases(self, at: int, n: int, m: int, longest: int, hasher: _Hash, seeds: np.ndarray):
        """Per length 1, 2, ...: (key of every word's phrase, which exist).
        The key of a phrase holds its document's seed."""
        h = hasher.words(self.body, self.starts[at:at + m], self.ends[at:at + m])
        linked, seed = self.linked[at:at + m], seeds[self.doc[at:at + n]]
        key, there = h[:n], np.ones(n, bool)
        for k in range(1, longest + 1):
            if k > 1:
                there = there[:max(0, m - k + 1)] & linked[k - 2:k - 2 + min(n, max(0, m - k + 1))]
                there = np.concatenate([there, np.zeros(n - len(there), bool)])
                nxt = np.zeros(n, np.uint64)
                nxt[:min(n, max(0, m - k + 1))] = h[k - 1:k - 1 + min(n, max(0, m - k + 1))]
                key = _join(key, nxt)
            yield _mix(key + seed), there


class Filter:
    """A set of keys as bits: never loses one, may take in others."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def places(keys: np.ndarray, size: int):
        yield _mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size)
        yield _mix(keys + np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - size)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self.places(keys, self.size):
            found &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def filter_of(keys: DataFrame, max_bits: int = MAX_FILTER_BITS) -> Filter:
    """The filter over a column ``key``, put together by Spark; the driver
    receives its words, 2^(max_bits - 6) at most."""
    n = keys.count()
    size = min(max_bits, max(12, math.ceil(math.log2(16 * n + 1))))

    def words(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            p = np.unique(np.concatenate(list(Filter.places(k, size))))
            w, at = np.unique(p >> np.uint64(6), return_index=True)
            ones = np.uint64(1) << (p & np.uint64(63))
            bits = np.bitwise_or.reduceat(ones, at) if len(at) else ones
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(bits.view(np.int64))],
                                             names=["w", "bits"])

    got = (keys.select("key").mapInArrow(words, "w long, bits long")
           .groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow())
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filter(bits, size)


def _sharded(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return (keys & ~np.uint64(7)) | shard


def _documents(docs: DataFrame, shards: int) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(lang).alias("seed"),
                       F.pmod(F.spark_partition_id(), F.lit(shards)).cast("long").alias("shard"))


def _u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _local_counts(docs: DataFrame, longest: int, pairs=None) -> DataFrame:
    """``key, n`` per (language, phrase, shard): words and pairs, or with
    ``pairs`` (the broadcast filter of the frequent ones) phrases of three
    words and more whose pairs all pass."""
    def run(batches):
        hasher = _Hash(1)
        for b in slices(batches, max_bytes=SLICE):
            words = Words(*utf8(b.column(1)))
            seeds, shard = _u64(b.column(2)), _u64(b.column(3))
            for at, n, m in words.stretches(longest):
                of = shard[words.doc[at:at + n]]
                found = []
                if pairs is None:
                    found = [_sharded(key, of)[there] for key, there in words.phrases(at, n, m, 2, hasher, seeds)]
                else:
                    passes = None
                    for k, (key, there) in enumerate(words.phrases(at, n, m, longest, hasher, seeds), 1):
                        if k == 2:
                            passes = there.copy()
                            passes[there] = pairs.value.has(key[there] & ~np.uint64(7))
                            # pairs that start in the overlap are let through
                            follow = np.concatenate([passes, np.ones(longest, bool)])
                            chain = passes
                        elif k > 2:
                            chain = chain & there & follow[k - 2:k - 2 + n]
                            found.append(_sharded(key, of)[chain])
                if found:
                    keys, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)],
                                                     names=["key", "n"])
    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _phrase_bytes(words: Words, first: np.ndarray, k: int) -> list[bytes]:
    """The phrases of k words that start at the given words, joined by one space."""
    text = words.body.tobytes()
    a, z = words.starts[first].tolist(), words.ends[first + k - 1].tolist()
    out = [text[i:j] for i, j in zip(a, z)]
    if k > 1:
        plain = np.ones(len(first), bool)
        for j in range(k - 1):
            gap = words.ends[first + j]
            plain &= (words.starts[first + j + 1] == gap + 1) & (words.body[np.minimum(gap, len(text) - 1)] == 0x20)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = b" ".join(w for w in out[i].replace(b"\t", b" ").split(b" ") if w)
    return out


def _global_counts(docs: DataFrame, longest: int, candidates) -> DataFrame:
    """Exact counts over all shards: ``lang, k, phrase, n`` of every phrase
    that passes the filter; k = 0 is the number of words."""
    def run(batches):
        one, two = _Hash(1), _Hash(2)
        for b in slices(batches, max_bytes=SLICE):
            words = Words(*utf8(b.column(1)))
            seeds, langs = _u64(b.column(2)), b.column(0).to_pylist()
            out = {"lang": [], "k": [], "phrase": [], "n": []}
            for at, n, m in words.stretches(longest):
                again = words.phrases(at, n, m, longest, two, seeds)
                for k, (key, there) in enumerate(words.phrases(at, n, m, longest, one, seeds), 1):
                    second = next(again)[0]
                    there = there.copy()
                    there[there] = candidates.value.has(key[there] & ~np.uint64(7))
                    where = np.flatnonzero(there)
                    order = where[np.lexsort((second[where], key[where]))]
                    if not len(order):
                        continue
                    k1, k2 = key[order], second[order]
                    head = np.flatnonzero(np.concatenate(
                        [[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
                    first = order[head] + at
                    out["lang"] += [langs[d] for d in words.doc[first].tolist()]
                    out["k"] += [k] * len(first)
                    out["phrase"] += _phrase_bytes(words, first, k)
                    out["n"] += np.diff(np.append(head, len(order))).tolist()
            for d, c in enumerate(np.bincount(words.doc, minlength=len(langs)).tolist()):
                if c:
                    out["lang"].append(langs[d])
                    out["k"].append(0)
                    out["phrase"].append(b"")
                    out["n"].append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["k"], pa.int32()),
                 pa.array(out["phrase"], pa.binary()).cast(pa.string()), pa.array(out["n"], pa.int64())],
                names=["lang", "k", "phrase", "n"])
    return docs.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(
        F.sum("n").alias("n"))


def _united(local: DataFrame) -> DataFrame:
    return local.select(F.expr("key & ~7L").alias("key")).distinct()


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                     shards: int = SHARDS) -> DataFrame:
    """``lang, k, phrase, n``: every phrase of 1 to ``longest`` words that
    occurs ``support`` times in its language, with its exact count, and with
    k = 0 the number of words of each language (checkpointed)."""
    if not (1 <= shards <= 8 and 2 <= longest):
        raise ValueError("1 to 8 shards, phrases of 2 words and more")
    spark = docs.sparkSession
    ship(spark)
    d = _documents(docs, shards)
    lowered = -(-support // shards)
    local = cut(_local_counts(d, longest).where(F.col("n") >= lowered))
    if longest > 2:
        pairs = spark.sparkContext.broadcast(filter_of(_united(local)))
        longer = _local_counts(d, longest, pairs).where(F.col("n") >= lowered)
        local = cut(local.unionByName(longer))
    candidates = spark.sparkContext.broadcast(filter_of(_united(local)))
    return cut(_global_counts(d, longest, candidates).where((F.col("n") >= support) | (F.col("k") == 0)))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP,
                 shards: int = SHARDS) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    counts = frequent_phrases(docs, support, longest, shards)
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    whole = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k",
                                         F.split("phrase", " ").alias("w"))

    def span(i, size):
        return F.array_join(F.slice(F.col("w"), i, size), " ")

    # l and r of every cut; a part may stand in very many phrases, so both sides are salted
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = (counts.where((F.col("k") > 0) & (F.col("k") < longest))
             .select(F.col("lang"), F.col("phrase").alias("part"), F.col("n").alias("part_n"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")))
    cuts = (whole.withColumn("salt", salt)
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))))
    left = cuts.withColumn("part", span(F.lit(1), F.col("cut"))).join(parts, ["lang", "part", "salt"]) \
        .withColumnRenamed("part_n", "l").drop("part")
    both = left.withColumn("part", span(F.col("cut") + 1, F.col("k") - F.col("cut"))) \
        .join(parts, ["lang", "part", "salt"]).withColumnRenamed("part_n", "r")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = both.withColumn("score", F.expr(
        "(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    # the largest count among the longer candidates around a phrase
    inner = (whole.where(F.col("k") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
             .select("lang", span(F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
             .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    kept = (lowest.join(inner, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (F.lit(100) * wide("around") < F.lit(SHARE) * wide("a"))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: the first of every part, then the first of all
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("p", part).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "p").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"),
        F.col("score").cast("long").alias("score"))
