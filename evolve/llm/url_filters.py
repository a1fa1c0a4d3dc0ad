"""URL filters by a sort-merge range join.

A rule is a host and a path prefix; it fits the host and all its subdomains.
Its key is the host's labels from the last to the first, each followed by
``/``, then ``#`` and the path: ``example.net`` with ``/en/`` is
``net/example/#/en/``.  A URL fits the rule if one of its own keys (one per
number of host labels, as deep as the deepest rule) starts with the rule's
key, i.e. lies in the interval that the key opens.  No host holds ``/`` or
``#``, so keys of different hosts never run into each other.

Rules and URL keys go through one range exchange, sorted by key, and one pass
over each piece keeps a stack of the open intervals: prefix intervals are
nested or apart, so the top is the longest rule of that host.  Intervals that
opened in an earlier piece are found from the smallest key of every piece (one
string a piece; a piece has at most as many open rules as its smallest key has
prefixes) and form the piece's first stack.  URL keys carry a hash as second
sort column, so a URL or a host on a large share of the rows is cut into
pieces like any other.  At last each URL takes the longest of its keys' rules.

The sorted keys go once into the shared checkpoint folder, because two range
exchanges would sample different bounds.

Defined results: a null URL, or one without ``://``, has empty host and path
and takes the default verdict, as does a URL that no rule fits.  The longest
rule is the one with the most characters of host and path, then the longer
host; rules with the same host and path count once, and ``block`` wins.  A
rule with a null, or with ``/?#`` in its host or ``?#`` in its path, fits
nothing.  Repeated rows (also of one id) each get their row; very long URLs
are one key per label level, whole; empty tables give empty results; other
columns of either table are not read.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.llm.common import cut, ship
from evolve.llm.quality_rules import UPPER

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"

_BEST = "size int, host_size int, rule string, verdict string"


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url):
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _labels(host):
    return F.reverse(F.split(host, r"\."))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``key, size, host_size, rule, verdict, depth``, one row per key."""
    host = F.translate("host", UPPER, UPPER.lower())
    fits = ~F.col("host").rlike("[/?#]") & ~F.col("path").rlike("[?#]") & F.col("verdict").isNotNull()
    key = F.concat(F.array_join(_labels(host), "/"), F.lit("/#"), F.col("path"))
    return (rules.where(fits).select(key.alias("key"), host.alias("host"), "path", "verdict")
            .groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
            .select("key", (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                    F.concat("host", "path").alias("rule"), "verdict", F.size(_labels(F.col("host"))).alias("depth")))


def _open_at(rules: DataFrame, starts: list[tuple[str, int]]) -> dict[int, list[tuple]]:
    """The rules whose interval holds a piece's smallest key, outermost first."""
    keys, pieces = [k for k, _ in starts], [p for _, p in starts]

    def covering(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = bisect.bisect_left(keys, r["key"])
                while at < len(keys) and keys[at].startswith(r["key"]):
                    rows.append((pieces[at], *r.values()))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6,
                                                [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])],
                names=["piece", "key", "size", "host_size", "rule", "verdict"])

    found: dict[int, list[tuple]] = {}
    cols = rules.select("key", "size", "host_size", "rule", "verdict")
    for r in sorted(cols.mapInArrow(covering, f"piece int, key string, {_BEST}").collect(), key=lambda r: len(r.key)):
        found.setdefault(r.piece, []).append((r.key, (r.size, r.host_size, r.rule, r.verdict)))
    return found


def _sweep(open_at: dict[int, list[tuple]]):
    """One pass over a sorted piece with the stack of open rules."""
    def run(batches):
        stack = None
        for b in batches:
            out, best = [], []
            for i, (piece, key, is_rule, *rule) in enumerate(zip(*(b.column(c).to_pylist() for c in (
                    "piece", "key", "is_rule", "size", "host_size", "rule", "verdict")))):
                if stack is None:
                    stack = list(open_at.get(piece, ()))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_rule:
                    stack.append((key, tuple(rule)))
                else:
                    out.append(i)
                    best.append(stack[-1][1] if stack else (None,) * 4)
            rows = b.select(["source", "id", "url", "level"]).take(pa.array(out, pa.int64()))
            types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *(pa.array(c, t) for c, t in zip(zip(*best) if best else [[]] * 4, types))],
                names=["source", "id", "url", "level", "size", "host_size", "rule", "verdict"])
    return run


def judged(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
           default: str = DEFAULT) -> DataFrame:
    """Per row of ``urls``: the id, the URL, ``host, path, rule, verdict``."""
    spark = urls.sparkSession
    ship(spark)
    by_key = cut(rule_keys(rules))
    depth = by_key.agg(F.max("depth")).first()[0] or 1
    u = urls.select(F.spark_partition_id().alias("source"), F.col(f"`{id_col}`").alias("id"),
                    F.col(f"`{url_col}`").cast("string").alias("url"))
    id_type = u.schema["id"].dataType.simpleString()
    labels, path = _labels(host_of(F.col("url"))), path_of(F.col("url"))
    keys = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda i: F.concat(
        F.array_join(F.slice(labels, F.lit(1), i), "/"), F.lit("/#"), path))
    probes = (u.select("source", "id", "url", F.posexplode(keys).alias("level", "key"))
              .withColumn("tie", F.xxhash64("source", "id", "url")).withColumn("is_rule", F.lit(False)))
    # a rule stands before the URL keys that equal its own
    opening = by_key.drop("depth").withColumn("tie", F.lit(-2 ** 63)).withColumn("is_rule", F.lit(True))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(probes.unionByName(opening, allowMissingColumns=True)
                 .repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
                 .withColumn("piece", F.spark_partition_id()))
    starts = sorted((r[1], r[0]) for r in pieces.groupBy("piece").agg(F.min("key")).collect())
    answers = pieces.mapInArrow(_sweep(_open_at(by_key, starts)),
                                f"source int, id {id_type}, url string, level int, {_BEST}")
    best = answers.groupBy("source", "id", "url").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict"))).alias("b"),
        F.count_if(F.col("level") == 0).cast("int").alias("n"))
    return (best.select("id", "url", "b", F.explode(F.sequence(F.lit(1), "n")).alias("_copy"))
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), host_of(F.col("url")).alias("host"),
                    path_of(F.col("url")).alias("path"), F.col("b.rule").alias("rule"),
                    F.coalesce("b.verdict", F.lit(default)).alias("verdict")))


def url_filters(pages: DataFrame) -> DataFrame:
    """The query's rows for every page."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")
