"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds its distinct shingles of ``width`` consecutive words
(words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; with fewer words, the whole
sequence as one).  Two documents link when 100 * intersection >=
``percent`` * union.

1. *Classes*: documents with equal sets are one class, its smallest doc_id the
   representative; only representatives go on, so copies never meet.
2. *Frequencies*: the number of representatives that hold each shingle, exact.
   Documents are dealt by a hash into blobs; a blob sends each bucket of the
   hash space its sorted shingles (deltas, compressed: about 2.5 bytes each)
   with their counts in the blob, the bucket adds them up over all blobs, and
   answers each blob with the frequencies of those that others hold too.  A
   shingle is one entry per blob, so a frequent one never makes a large group.
   A blob holds about ``BLOB_BYTES`` of text at most and a bucket about
   ``BUCKET_KEYS`` entries, however large the table.  Documents are dealt by
   doc_id and text hash, so rows that share a doc_id spread like others; of
   equal texts a task sends on only those with a new smallest doc_id.
3. *Prefixes*: a set in rare-first order can only link if one of its first
   n - ceil(percent * n) + 1 shingles is in the other's.  A set whose whole
   prefix is held by no one else has no link and leaves here (most do).
4. *Candidates*: representatives meet on shared prefix shingles, under the
   length filter (sizes) and the positional filter (what is left behind the
   shingle in both sets).  First every list of a shingle meets only its most
   central member; the verified links are contracted to components, and then
   members outside the central component meet those of other components.  So
   a group of near copies makes as many pairs as it has members, not their
   square, and no component loses a link.
5. *Verification* once per pair: the suffix filter (differences of the sets'
   histograms over hash ranges bound their distance from below), then the
   exact intersection.

``links`` gives every link between classes instead (all pairs, for users who
need the edges); ``joined`` gives components.

Sets are compared by 64-bit shingle hashes, classes by a 128-bit digest.

Defined results: null or blank text has an empty set and is linked with
nothing; a null doc_id is linked with nothing (component null); rows that
share a doc_id each get the component of their own set (sets with the same
smallest doc_id are one node); an empty table gives an empty result; other
columns are ignored; a very long text is one set, and a blob or two of its own size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.llm.common import cut, ship, slices, utf8
from evolve.llm.components import components

WIDTH = 4
PERCENT = 85
BLOB_BYTES = 128 << 20
BUCKET_KEYS = 16 << 20
SEEN_TEXTS = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _ODD[2]
    h = (h ^ (h >> _U(29))) * _ODD[3]
    return h ^ (h >> _U(32))


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the first word of each row and the end)
    of an Arrow string column, computed on its bytes as a whole."""
    data, offsets = utf8(column)
    data = np.insert(data, offsets[1:], np.uint8(0x20))   # rows end words
    offsets = offsets + np.arange(len(offsets))
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), first
    at = np.flatnonzero(inside)
    word = np.cumsum(opens)[at] - 1
    place = at - starts[word]
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _ODD[0]
    powers = np.cumprod(powers, dtype=np.uint64)
    letters = (_LOWER[data[at]].astype(np.uint64) + _U(1)) * powers[place]
    return _mix(np.add.reduceat(letters, np.flatnonzero(place == 0))), first


def shingle_sets(column, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    words, first = word_hashes(column)
    out = []
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            whole = whole * _ODD[1] + words[i:i + len(whole)]
        whole = _mix(whole)
        for a, b in zip(first, first[1:]):
            if b - a >= width:
                out.append(np.unique(whole[a:b - width + 1]))
            elif b > a:
                h = _U(b - a)
                for w in words[a:b]:
                    h = h * _ODD[1] + w
                out.append(_mix(np.array([h], np.uint64) ^ _ODD[0]))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: the documents with a hash of their text."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, class, text_key, n_bytes`` of every document."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 b.column(2), b.column(3)],
                ["doc_id", "n_shingles", "class", "text_key", "n_bytes"])

    return (keyed(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
            .mapInArrow(run, "doc_id long, n_shingles long, class binary, text_key long, n_bytes long"))


def representatives(found: DataFrame) -> DataFrame:
    """``class, doc_id, text_key``: the smallest doc_id of every class that can
    link, and of its texts the one with the smallest hash."""
    return (found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class")
            .agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select("class", "r.doc_id", "r.text_key"))


def first_of_texts(batches):
    """The rows (doc_id, text, text_key) that can stand for their text: those
    whose doc_id is below every one that the task has sent on with the same
    text.  What is forgotten of very many texts is sent on again."""
    least: dict = {}
    for b in batches:
        stay = []
        for i, (d, k) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
            if d < least.get(k, d + 1):
                least[k] = d
                stay.append(i)
        if len(least) > SEEN_TEXTS:
            least.clear()
        yield b if len(stay) == b.num_rows else b.take(pa.array(stay, pa.int64()))


def blob_counts(rows: int, n_bytes: int, shingles: int) -> tuple[int, int]:
    """Numbers of blobs and buckets: both grow with the root of the table, and
    with the table where a blob or bucket would exceed its bound."""
    blobs = max(1, -(-rows // max(2 * math.isqrt(rows), 500)), -(-n_bytes // BLOB_BYTES))
    return blobs, max(1, blobs // 2, -(-shingles // BUCKET_KEYS))


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which one must be shared by any partner."""
    return n - -(-percent * n // 100) + 1


# --- compact columns: whole numbers as byte planes under zstandard ---------

def _squeeze(values: np.ndarray) -> bytes:
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes, n: int) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(data, max_output_size=4 * n)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a shingle hash; what frequencies count."""
    return ((h >> _U(32)) % _U(buckets)) << _U(32) | (h & _U(0xFFFFFFFF))


def _own_sets(rows: pa.Table, reps: pa.Table, width: int) -> list[tuple[int, np.ndarray]]:
    """(doc_id, set) of the blob's representatives."""
    wanted = {(d, c) for d, c in zip(reps.column("doc_id").to_pylist(), reps.column("class").to_pylist()) if c}
    out = []
    for b in slices(rows.select(["doc_id", "text"]).to_batches()):
        for d, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width)):
            key = (d, hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if key in wanted:
                wanted.discard(key)
                out.append((d, s))
    return out


def _blob_keys(sets, buckets: int):
    """(sorted distinct keys of a blob, their counts, bucket bounds)."""
    every = np.concatenate([_keys(s, buckets) for _, s in sets]) if sets else np.empty(0, np.uint64)
    keys, counts = np.unique(every, return_counts=True)
    return keys, counts, np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << _U(32))


def prefix_table(docs: DataFrame, reps: DataFrame, blobs: int, buckets: int, width: int, percent: int) -> DataFrame:
    """``doc_id, n, singles, ordered, prefix`` of the representatives that may
    link: the set's sorted hashes, and the prefix hashes held by others too,
    in rare-first order from position ``singles`` on."""
    dealt = lambda df: df.withColumn(
        "blob", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(blobs)).cast("int"))
    base = dealt(keyed(docs).mapInArrow(first_of_texts, "doc_id long, text string, text_key long"))
    members = dealt(reps).select("blob", "doc_id", "class")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        blob = (left if left.num_rows else right).column("blob")[0].as_py()
        keys, counts, bounds = _blob_keys(_own_sets(left, right, width), buckets)
        out = []
        for k in range(buckets):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b > a:
                low = (keys[a:b] & _U(0xFFFFFFFF)).astype(np.int64)
                out.append((blob, k, b - a, _squeeze(np.diff(low, prepend=0)), _squeeze(counts[a:b])))
        columns = list(zip(*out)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                    ["blob", "bucket", "n", "deltas", "counts"])

    sent = base.groupBy("blob").cogroup(members.groupBy("blob")).applyInArrow(
        send, "blob int, bucket int, n int, deltas binary, counts binary")

    def answer(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_pylist()
        low = np.concatenate([np.cumsum(_expand(d, n).astype(np.int64)) for d, n in
                              zip(t.column("deltas").to_pylist(), sizes)])
        counts = np.concatenate([_expand(c, n) for c, n in zip(t.column("counts").to_pylist(), sizes)])
        _, which = np.unique(low, return_inverse=True)
        total = np.bincount(which, weights=counts)[which]
        held, often, at = [], [], 0
        for n in sizes:
            mine = total[at:at + n]
            many = mine > 1
            held.append(np.packbits(many).tobytes())
            often.append(_squeeze(np.minimum(mine[many], 2.0 ** 32 - 1)))
            at += n
        return pa.Table.from_arrays([t.column("blob").combine_chunks(), t.column("bucket").combine_chunks(),
                                     pa.array(held, pa.binary()), pa.array(often, pa.binary())],
                                    ["blob", "bucket", "held", "often"])

    answers = sent.groupBy("bucket").applyInArrow(answer, "blob int, bucket int, held binary, often binary")
    beside = members.select("blob", "doc_id", "class", F.lit(None).cast("int").alias("bucket"),
                            F.lit(None).cast("binary").alias("held"), F.lit(None).cast("binary").alias("often")
                            ).unionByName(answers.select(
                                "blob", F.lit(None).cast("long").alias("doc_id"),
                                F.lit(None).cast("binary").alias("class"), "bucket", "held", "often"))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _own_sets(left, right, width)
        keys, _, bounds = _blob_keys(sets, buckets)
        often = np.ones(len(keys), np.int64)
        for k, held, more in zip(right.column("bucket").to_pylist(), right.column("held").to_pylist(),
                                 right.column("often").to_pylist()):
            if k is not None:
                a, b = int(bounds[k]), int(bounds[k + 1])
                many = np.unpackbits(np.frombuffer(held, np.uint8), count=b - a).astype(bool)
                often[a:b][many] = _expand(more, int(many.sum()))
        out = []
        for d, s in sets:
            f = often[np.searchsorted(keys, _keys(s, buckets))]
            singles, p = int((f == 1).sum()), prefix_length(len(s), percent)
            if singles < p:
                rare = np.lexsort((s, f))[singles:p]
                out.append((d, len(s), singles, s.astype("<u8").tobytes(), s[rare].astype(np.int64)))
        columns = list(zip(*out)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                    ["doc_id", "n", "singles", "ordered", "prefix"])

    return base.groupBy("blob").cogroup(beside.groupBy("blob")).applyInArrow(
        choose, "doc_id long, n int, singles int, ordered binary, prefix array<long>")


def _compatible(percent: int):
    """Length and positional filter for the posting columns of x and y."""
    n, m, i, j = (F.col(c).cast("long") for c in ("x.n", "y.n", "x.pos", "y.pos"))
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    # an intersection of k gives k / (n + m - k): 100 k >= percent (n + m - k)
    position = (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)
    return length & position


def _pairs(x: DataFrame, y: DataFrame, percent: int, extra=None) -> DataFrame:
    condition = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc_id") != F.col("y.doc_id"))
    condition = condition & _compatible(percent)
    if extra is not None:
        condition = condition & extra
    return x.alias("x").join(y.alias("y"), condition).select(
        F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, with ``shared`` and ``united``."""
    side = lambda c, s: sets.select(F.col("doc_id").alias(c), F.col("ordered").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            out = []
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                n, m = len(x), len(y)
                need = -(-percent * (n + m) // (100 + percent))
                apart = np.abs(np.bincount((x >> _U(57)).astype(np.int64), minlength=128)
                               - np.bincount((y >> _U(57)).astype(np.int64), minlength=128)).sum()
                if apart > n + m - 2 * need:
                    continue
                k = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * k >= percent * (n + m - k):
                    out.append((i, j, k, n + m - k))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["a", "b", "shared", "united"])

    return both.mapInArrow(run, "a long, b long, shared long, united long")


class Join:
    """The steps of one join, for both outputs."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT):
        self.percent = percent
        ship(docs.sparkSession)
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.classes = cut(classes(base, width))
        self.reps = representatives(self.classes)
        size = self.classes.agg(F.count(F.lit(1)), F.sum("n_bytes"), F.sum("n_shingles")).first()
        self.sets = cut(prefix_table(base.where("doc_id IS NOT NULL AND text IS NOT NULL"), self.reps,
                                     *blob_counts(*(v or 0 for v in size)), width, percent))
        self.postings = self.sets.select(
            "doc_id", "n", (1000 * F.col("singles") / F.col("n")).cast("int").alias("edge"),
            F.col("singles"), F.posexplode("prefix").alias("k", "shingle")).select(
            "doc_id", "n", "edge", (F.col("singles") + F.col("k")).alias("pos"), "shingle")

    def links(self) -> DataFrame:
        """Every link between classes: a > b (representatives), shared, united."""
        x = self.postings
        return verified(_pairs(x, x, self.percent, F.col("x.doc_id") > F.col("y.doc_id")), self.sets, self.percent)

    def components(self) -> DataFrame:
        """``node, component`` of the representatives that have a link."""
        # the member of each list with the fewest shingles of its own is its centre
        centre = self.postings.groupBy("shingle").agg(
            F.min(F.struct("edge", "doc_id", "n", "pos")).alias("c")).select("shingle", "c.*")
        first = cut(_pairs(self.postings, centre, self.percent))
        near = components(verified(first, self.sets, self.percent))
        labelled = self.postings.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        central = centre.select("shingle", F.col("doc_id").alias("centre")).join(
            near.select(F.col("node").alias("centre"), "component"), "centre", "left").select(
            "shingle", F.coalesce("component", "centre").alias("central"))
        outside = labelled.join(central, "shingle").where(F.col("component") != F.col("central")).drop("central")
        second = _pairs(outside, labelled, self.percent, F.col("x.component") != F.col("y.component"))
        more = verified(second.join(first, ["a", "b"], "left_anti"), self.sets, self.percent)
        label = lambda c: F.coalesce(F.col(c + "_"), F.col(c))
        between = (more.join(near.select(F.col("node").alias("a"), F.col("component").alias("a_")), "a", "left")
                   .join(near.select(F.col("node").alias("b"), F.col("component").alias("b_")), "b", "left")
                   .select(label("a").alias("a"), label("b").alias("b")))
        merged = components(between)
        # nodes of ``near`` move with their component; others stand in ``merged`` themselves
        moved = near.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")),
                          "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        alone = merged.join(near.select("node"), "node", "left_anti")
        return moved.unionByName(alone)


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document (runs jobs)."""
    j = Join(docs, width, percent)
    known = j.reps.join(j.components().withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "class", F.coalesce("component", "doc_id").alias("component_id"))
    return j.classes.join(known, "class", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked, directly or through
    others, with a smaller doc_id (null doc_ids stay); all columns as they came.
    Rows that share the smallest doc_id all stay."""
    found = joined(docs, width, percent)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def ngram_join(docs: DataFrame) -> DataFrame:
    """The query's rows for every document."""
    return joined(docs.select("doc_id", "text"))
