"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` measures every text once and stores, per document, the
measurements and one long whose bit i says that rule i failed.  A *policy* is
a versioned set of rule names; applying one is a bitwise AND of the ledger
with the policy's mask, so a new policy never reads the texts again.
``ablation`` counts, for a policy, what each rule rejects and what it alone
rejects, from the bits.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results:

* null or empty text: no words, all measurements 0; rule ``few_words`` fails;
* repeated rows are judged one by one; a null doc_id is kept as it is;
* an empty table gives an empty result;
* extra columns: ``ledger`` replaces columns that have the name of one of its
  results; ``keep_good`` returns every column as it came, whatever its name.

Every expression is a pass over one row's arrays, so there is no shuffle and
a task holds one text at a time.  3-word windows are compared by a 64-bit
hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; true means the document fails it."""
    name: str
    fails: str


# Bit i of the ledger belongs to RULES[i]; new rules are added at the end.
# All are integer comparisons, so any engine gives the same bits.
RULES = [
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", "10 * n_upper > 5 * word_chars"),
]
BIT = {r.name: i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("2", tuple(r.name for r in RULES))


def _covered_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Windows become 64-bit hashes.  A cheap sort of plain longs (33 bits of the
    hash, then the position) puts equal windows side by side and leaves the
    positions whose window may be repeated; only those are sorted again by
    their whole hash, and stay if a neighbour has it too.  The repeated
    positions, in order, then cover min(3, distance to the next one) words
    each, the last one 3.  Arrays are looked up by index only where bound to
    a lambda variable, so the cost stays n log n.
    """
    def bind(value, use):
        """``use(value)`` with the value computed once (as a lambda variable)."""
        return F.transform(F.array(value), use)[0]

    def windows(w):
        n = F.size(w)
        pairs = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(pairs, F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b)), 1, n - 2)

    def beside_equal(ordered, same):
        """The elements of a sorted array that equal a neighbour."""
        return bind(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(
            same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False))))

    def likely(h):
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))
        hit = beside_equal(packed, lambda a, b: F.shiftright(a, 31) == F.shiftright(b, 31))
        return F.transform(hit, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))

    def repeated(h, positions):
        s = F.sort_array(F.transform(positions, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p"))))
        return F.sort_array(F.transform(beside_equal(s, lambda a, b: a["h"] == b["h"]), lambda t: t["p"]))

    def cover(p):
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def count(h):
        return bind(likely(h), lambda ps: F.when(F.size(ps) < 2, F.lit(0).cast("long"))
                    .otherwise(bind(repeated(h, ps), cover)))

    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bind(windows(w), count)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements of :data:`MEASURES` added as longs."""
    docs = docs.drop(*[c for c in docs.columns if c in MEASURES])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    lines = F.transform(F.array(F.filter(
        F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)),
        lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("d")))[0]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    per_words = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), _covered_words(w).alias("r")))[0]
    staged = docs.withColumns({"_words": per_words, "_lines": lines, "_bare": F.length(bare),
                               "_sym": F.length(bare) - F.length(F.translate(bare, SYMBOLS, "")),
                               "_up": F.length(bare) - F.length(F.translate(bare, UPPER, ""))})
    return staged.withColumns({
        "n_words": F.col("_words.n"), "word_chars": F.col("_bare").cast("long"),
        "n_symbols": F.col("_sym").cast("long"),
        "n_dup_lines": (F.col("_lines.n") - F.col("_lines.d")).cast("long"),
        "n_repeat_words": F.col("_words.r"), "n_upper": F.col("_up").cast("long"),
        "n_lines": F.col("_lines.n").cast("long"),
    }).drop("_words", "_lines", "_bare", "_sym", "_up")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed`` (long bitmask)."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text_col).withColumn("failed", bits)


def judge(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` (its version) to a ledger."""
    bad = lambda p: F.col("failed").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return led.withColumns({"base_failed": bad(BASE), "kept": ~bad(BASE) & ~bad(policy),
                            "policy": F.lit(policy.version)})


def ablation(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """One row per rule of the policy: ``rule``, ``n_failed`` (documents that
    fail it) and ``n_only`` (documents rejected by this rule and no other,
    i.e. gained by leaving it out).

    Documents are first counted per bit pattern (a hash aggregate with
    partial sums, at most 2^rules rows); the rules read those counts.
    """
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")
    patterns = led.groupBy(masked).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit"))
                                for r in sorted(set(policy.rules), key=BIT.get)])).alias("r")
    per = patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return per.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(f"`{text_col}`").alias("_text"))
    return judge(ledger(packed, "_text"), policy).where("kept").select("_row.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The query's rows: measurements and verdict for every document."""
    return judge(ledger(docs.select("doc_id", "text"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed")
