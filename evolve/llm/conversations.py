"""Conversation structure repair on a suffix-shared automaton.

Each row of a conversation becomes one character, its role initial and fault;
the conversation's rows in order are its signature.  Signatures over all
conversations that end alike share their end: sorted by their reversed text,
one pass keeps a stack with one node for every suffix of the signature at
hand, and the next signature reuses the nodes of the suffix that it shares
with the one before, so each suffix is worked out once.  A node holds, for
every state of the grammar ``(s?(ua)+)?``, the cost to go and the first edits
of the best audit (the rest is the next node's); audits are compared by the
rank of their rest, so a node has a fixed size.  Equal nodes (same costs up to
a constant, same ranks) share one table of transitions.

States: 0 nothing put out, 1 after the system row, 2 after a user row, 3 after
an assistant row; 0 and 3 may end.  Inserts stand before the row whose edit
follows them, or at the end.

Long conversations.  A signature over ``PART`` rows is cut into parts of
``PART``; for a part, a node holds the cost from every state to each of the
four states at the part's end, and the parts' tables are put together from the
last one to the first (a few numbers a part).  Two audits of one part from one
state never start with one another, since each ends with its last row's edit:
comparing them needs no look at the parts that follow.

The rows meet in order without their texts: identical rows are folded with
their count, sorted by (conv_id, turn, role, text hashes) over a range
exchange and numbered; at most ``PART`` rows of a conversation are gathered
into a string at a time, and these strings (a byte a row, the size of the
contract's own audit) into the signature.  Texts are read again for the
repaired conversations' hash: each conversation's first copies stream in order
through one task, since SHA-256 of one text can't be divided; memory holds one
batch.

Defined results: a null conv_id is a conversation of its own; in the damage
key, role and text, null is one space.  Rows of one turn are in order of role
and text hash.  A role whose first character isn't s, u or a (also an empty
role) fits nowhere and can only be changed or deleted.  Texts are compared by
128 bits of hash.  Very long texts go through whole; repeated rows are
duplicates of the first; an empty table gives an empty result; other columns
are not read.  A conversation may have up to 2^31 rows (one string of audit).
"""

from __future__ import annotations

import functools
import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolve.llm.common import cut, shared_path, ship
from evolve.llm.quality_rules import SPACE

PART = 4096
SALTS = 16
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}


def _wanted(state: int) -> str:
    """The initial that an insert or a rerole puts out in a state."""
    return "a" if state == 2 else "u"


def _after(state: int) -> int:
    return NEXT[state, _wanted(state)]


# A node's shape: costs above its smallest (None: the end can't be reached) and
# the ranks of its states' audits.
ACCEPT = ((0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0))
TAIL = ("", "II", "I", "")
INNER = [(tuple(0 if q == end else None for q in STATES), (0,) * 4) for end in STATES]


@functools.lru_cache(maxsize=1 << 16)
def step(shape, symbol: str):
    """The node before ``shape`` on a row: (smallest cost, its shape, and per
    state the edits up to the row's own and the state after)."""
    costs, ranks = shape
    truncated = TRUNCATED if symbol.isupper() else 0
    initial = symbol.lower()
    best = []
    for q in STATES:
        options, p = [], q
        for inserts in range(3):
            before = "I" * inserts
            edits = [(DELETE, "D", p)]
            if symbol != "x":
                edits.append((REROLE + truncated, "R", _after(p)))
                if (p, initial) in NEXT:
                    edits.append((KEEP + truncated, "K", NEXT[p, initial]))
            options += [(inserts * INSERT + c + costs[r], before + e, ranks[r], r)
                        for c, e, r in edits if costs[r] is not None]
            p = _after(p)
        best.append(min(options, default=None))
    least = min(b[0] for b in best if b is not None)
    order = sorted({b[1:3] for b in best if b is not None})
    return (least,
            (tuple(None if b is None else b[0] - least for b in best),
             tuple(0 if b is None else order.index(b[1:3]) for b in best)),
            tuple(None if b is None else (b[1], b[3]) for b in best))


class Suffixes:
    """The nodes of one signature's suffixes, shortest first."""

    def __init__(self, end):
        self.end = end
        self.nodes = [(0, end, None)]

    def move(self, backward: str, shared: int) -> None:
        """Go to the signature whose reverse is ``backward``; its last
        ``shared`` rows are those of the signature before."""
        del self.nodes[shared + 1:]
        base, shape, _ = self.nodes[-1]
        for symbol in backward[shared:]:
            least, shape, edits = step(shape, symbol)
            base += least
            self.nodes.append((base, shape, edits))

    def answer(self, state: int):
        """(cost, audit) from a state over the whole signature, or None."""
        base, (costs, _), _ = self.nodes[-1]
        if costs[state] is None:
            return None
        cost, audit = base + costs[state], []
        for _, _, edits in reversed(self.nodes[1:]):
            letters, state = edits[state]
            audit.append(letters)
        if self.end is ACCEPT:
            audit.append(TAIL[state])
        return cost, "".join(audit)


def _solve(batches):
    """Sorted (cut, backward) -> costs, ranks and audits of every signature: one
    entry for a whole one; 4 x 4 (from state, to state) for a part."""
    previous, was_cut, trees = "", None, []
    for b in batches:
        rows = []
        for is_cut, backward in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if is_cut != was_cut:
                previous, was_cut = "", is_cut
                trees = [Suffixes(e) for e in INNER] if is_cut else [Suffixes(ACCEPT)]
            shared = len(os.path.commonprefix([previous, backward]))
            for t in trees:
                t.move(backward, shared)
            previous = backward
            if is_cut:
                costs, ranks, audits = [], [], []
                for q in STATES:
                    got = [t.answer(q) or (-1, "") for t in trees]
                    order = sorted(a for _, a in got)
                    costs += [c for c, _ in got]
                    ranks += [order.index(a) for _, a in got]
                    audits += [a for _, a in got]
            else:
                cost, audit = trees[0].answer(0)
                costs, ranks, audits = [cost], [0], [audit]
            rows.append((is_cut, backward, costs, ranks, audits))
        yield _batch(rows, _SOLVED)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


_SOLVED = [("cut", pa.bool_()), ("backward", pa.string()), ("costs", pa.list_(pa.int64())),
           ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]


def best_way(parts: list) -> list[int]:
    """For a conversation's parts in order, each with ``costs`` and ``ranks``
    (4 x 4), the index of the entry that the best audit takes in each."""
    to_go, choices = ACCEPT[0], []
    for p in reversed(parts):
        best = [min((p["costs"][4 * q + j] + to_go[j], p["ranks"][4 * q + j], j)
                    for j in STATES if p["costs"][4 * q + j] >= 0) for q in STATES]
        to_go = [b[0] for b in best]
        choices.append([b[2] for b in best])
    state, way = 0, []
    for took in reversed(choices):
        way.append(4 * state + took[state])
        state = took[state]
    return way


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: ``conv_id, turn, role, text, copies`` (0: dropped),
    nulls of role and text as one space."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))


def _described(rows: DataFrame) -> DataFrame:
    trimmed = F.btrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open_end"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))


def _same(a: str, b: str, *columns: str):
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation with rows: ``conv_id, signature, blank, duplicate,
    truncated``.  A character is the role initial (o: any other), in capitals
    if truncated, or 1 2 3 4 for s u a o of a row that must go."""
    spark = rows.sparkSession
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "turns")
    (rows.where("copies > 0").groupBy("conv_id", "turn", "role", "initial", "h1", "h2", "blank", "open_end")
     .agg(F.sum("copies").alias("copies")).repartitionByRange(n, *order).sortWithinPartitions(*order)
     .withColumn("place", F.monotonically_increasing_id()).write.parquet(path))
    lines = spark.read.parquet(path)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    repeated = (lines.where("NOT blank").groupBy("conv_id", "role", "h1", "h2")
                .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
                .select("*", salts))
    salted = lines.withColumn("salt", F.pmod(F.hash("place"), F.lit(SALTS)))
    seen = salted.alias("l").join(repeated.alias("r"), _same("l", "r", "conv_id", "role", "h1", "h2", "salt"), "left") \
        .select("l.*", (F.col("l.place") > F.coalesce("r.first", F.col("l.place"))).alias("seen"))
    gone = F.translate("initial", "suao", "1234")
    head = F.when(F.col("blank") | F.col("seen"), gone).when(F.col("open_end"), F.upper("initial")).otherwise(F.col("initial"))
    first_counts = F.when(F.col("seen"), 0).otherwise(1)
    marked = seen.select(
        "conv_id", F.shiftright("place", PART.bit_length() - 1).alias("part"), "place",
        F.concat(head, F.repeat(gone, (F.col("copies") - 1).cast("int"))).alias("symbols"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("copies") - first_counts).alias("duplicate"),
        F.when(~F.col("blank") & ~F.col("seen") & F.col("open_end"), 1).otherwise(0).alias("truncated"))

    def gathered(df, keys, by):
        return df.groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "symbols"))), lambda x: x["symbols"]), "")
            .alias("symbols"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    parts = gathered(marked, ["conv_id", "part"], "place")  # at most PART rows each
    return gathered(parts, ["conv_id"], "part").withColumnRenamed("symbols", "signature")


def solutions(parts: DataFrame) -> DataFrame:
    """``cut, backward`` (a signature's or part's rows from the last to the
    first) of distinct ones with their costs, ranks and audits."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = parts.select("cut", "backward").distinct()
    return distinct.repartitionByRange(n, "cut", "backward").sortWithinPartitions("cut", "backward").mapInArrow(
        _solve, "cut boolean, backward string, costs array<long>, ranks array<int>, audits array<string>")


def audits(found: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` for signatures (``conv_id, signature``)."""
    starts = F.sequence(F.lit(0), F.floor((F.length("signature") - 1) / PART).cast("int"))
    parts = (found.where(F.length("signature") > 0)
             .select("conv_id", F.translate("signature", "1234", "xxxx").alias("s"), starts.alias("starts"),
                     (F.length("signature") > PART).alias("cut"))
             .select("conv_id", "cut", "s", F.explode("starts").alias("i"))
             .select("conv_id", "cut", "i", F.reverse(F.substring(F.col("s"), F.col("i") * PART + 1, F.lit(PART)))
                     .alias("backward"), F.pmod(F.hash("conv_id", "i"), F.lit(SALTS)).alias("salt")))
    # one shape may be that of most conversations: both sides are salted
    table = cut(solutions(parts)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["cut", "backward", "salt"]
    whole = parts.where("NOT cut").join(table, on).select(
        "conv_id", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))

    def ways(batches):
        for b in batches:
            picks = [best_way(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(picks, pa.list_(pa.int32())), pa.array([w[-1] % 4 for w in picks], pa.int32())],
                names=["conv_id", "way", "end"])

    tables = parts.where("cut").join(table.drop("audits"), on).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "costs", "ranks"))).alias("parts"))
    conv = found.schema["conv_id"].dataType.simpleString()
    chosen = tables.mapInArrow(ways, f"conv_id {conv}, way array<int>, end int").select(
        "conv_id", "end", F.posexplode("way").alias("i", "entry"))
    pieces = (parts.where("cut").alias("p").join(chosen.alias("c"), _same("p", "c", "conv_id", "i"))
              .select("p.*", "c.entry", "c.end").join(table.drop("ranks"), on)
              .select("conv_id", "i", "end", F.expr("costs[entry]").alias("cost"), F.expr("audits[entry]").alias("audit")))
    tail = F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.max("end") + 1)
    rest = F.element_at(F.array(*[F.lit(c) for c in ACCEPT[0]]), F.max("end") + 1)
    long = pieces.groupBy("conv_id").agg(
        (F.sum("cost") + rest).alias("cost"),
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "audit"))), lambda x: x["audit"]),
                              ""), tail).alias("audit"))
    return whole.unionByName(long)


class _Repaired:
    """The hash of one conversation's repaired rows, taken as they come."""

    def __init__(self, signature: str | None, audit: str | None):
        self.signature, self.audit = signature or "", audit or ""
        self.row = self.letter = self.state = 0
        self.hash, self.empty = hashlib.sha256(), True

    def put(self, role: str, text: str, initial: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty, self.state = False, NEXT[self.state, initial]

    def edit(self) -> str:
        """The next row's edit; inserts before it are put out."""
        while self.letter < len(self.audit):
            e = self.audit[self.letter]
            self.letter += 1
            if e != "I":
                return e
            wanted = _wanted(self.state)
            self.put(ROLE[wanted], "", wanted)
        return ""

    def add(self, role: str, text: str) -> None:
        """The next row that may stay."""
        while self.signature[self.row] in "1234":
            self.row += 1
            self.edit()
        self.row += 1
        e = self.edit()
        if e == "K":
            self.put(role, text, role[0])
        elif e == "R":
            wanted = _wanted(self.state)
            self.put(ROLE[wanted], text, wanted)

    def done(self) -> str:
        while self.letter < len(self.audit):
            self.edit()
        return self.hash.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _hashed(batches):
    """Rows by conversation, its own row (with the audit) before its texts."""
    head, at = None, None

    def row():
        return tuple(head[c] for c in ("conv_id", *_COUNTS, "audit")) + (at.done(),)
    for b in batches:
        out = []
        for r in zip(*(c.to_pylist() for c in b.columns)):
            r = dict(zip(b.schema.names, r))
            if r["is_text"]:
                at.add(r["role"], r["text"])
                continue
            if at is not None:
                out.append(row())
            head, at = r, _Repaired(r["signature"], r["audit"])
        yield _rows(out, b.schema)
    if at is not None:
        yield _rows([row()], b.schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return _batch(rows, [("conv_id", schema.field("conv_id").type), *[(c, pa.int64()) for c in _COUNTS],
                         ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text, copies``; 0
    copies: the row is gone, its conversation isn't): the counts of faults,
    the cheapest audit with its cost, and the hash of the repaired rows."""
    spark = rows.sparkSession
    ship(spark)
    described = _described(rows)
    found = cut(signatures(described))
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    turns = rows.groupBy("conv_id").agg(F.coalesce(
        F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    initials = F.translate("signature", "SUAO1234", "suaosuao")
    legal = sum((F.length("i") - F.length(F.replace(F.col("i"), F.lit(two), F.lit("")))) / 2 for two in ("su", "ua", "au"))
    illegal = found.select("conv_id", initials.alias("i")).select(
        "conv_id", (F.length("i") - 1 - legal).cast("long").alias("illegal"))
    whole = turns
    for part in (found, illegal, audits(found)):
        whole = whole.alias("w").join(part.alias("p"), _same("w", "p", "conv_id"), "left").select(
            "w.*", *[f"p.{c}" for c in part.columns if c != "conv_id"])
    heads = whole.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], "signature",
                         F.coalesce("audit", F.lit("")).alias("audit"), F.lit(False).alias("is_text"))
    # of each role and text that isn't blank, the first row
    texts = (described.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "h1", "h2")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
                  F.first("text").alias("text"))
             .select("conv_id", "first", "role", "h1", "h2", "text", F.lit(True).alias("is_text")))
    conv = rows.schema["conv_id"].dataType.simpleString()
    inorder = (heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
               .sortWithinPartitions("conv_id", "is_text", "first", "role", "h1", "h2"))
    return inorder.select("conv_id", *_COUNTS, "audit", "signature", "is_text", "role", "text").mapInArrow(
        _hashed, f"conv_id {conv}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """The query's rows for every conversation."""
    return repair(damaged(conversations))
