"""Exact top-k inner products by a bit-sliced index.

Components are integers floor(1024 * x).  The index cuts the vectors into
blocks of ``BLOCK`` rows; in a block, each dimension is quantised to
``SLICES`` bits above the block's smallest value, and bit s of all rows is
one bitmap (a slice).  A query's component is rounded to a few signed binary
digits; a product is then a shift, a negative one uses the complemented
slices, and the score of all rows is a sum of shifted bitmaps, added up
column by column with carry-save adders (and, xor on whole bitmaps).

The sum's own slices give the k-th largest value, from the most significant
slice downward.  What quantising leaves out has a known width, so every row
that may belong to the k best has a sum of at least that value less the
width: a second walk down the slices marks these *boundary*
rows, and their scores are computed exactly from the stored integers.  So
the result is exact, and ties go to the smaller vec_id.

Index blocks and query blocks meet by an equi-join on the index block's
number (a stated query set against all rows, in blocks); each pair of blocks
gives at most k rows a query, and a rank over the blocks' winners keeps k.
No bitmaps or vectors go to the driver.

Defined results: rows whose vec_id or vector is null, or whose vector holds
null or non-finite components, take no part; vectors of another length than
the query's aren't its candidates; repeated rows (same vec_id and vector) of
a query ask once, of a candidate count once each; floor(1024 * x) beyond 64 bits
is the nearest long, and so is a score beyond them (large values are scored
row by row, in whole numbers of any size); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.llm.common import ship

SCALE = 1024
K = 10
EVERY = 100
BLOCK = 16384
QUERY_BLOCK = 128
SLICES = 8
DIGITS = 3
LARGE = 1 << 61  # products of larger sums are taken in whole numbers of any size


def _signed_digits(value: int, digits: int) -> list[tuple[int, int]]:
    """The ``digits`` most significant non-zero digits (sign, shift) of the
    value's non-adjacent form."""
    out, shift, v = [], 0, abs(value)
    while v:
        if v & 1:
            d = 2 - (v & 3)
            out.append((d if value > 0 else -d, shift))
            v -= d
        v >>= 1
        shift += 1
    return out[::-1][:digits]


class Block:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.rows, dims = values.shape
        self.top = max((abs(int(x)) for x in (values.max(), values.min())), default=0) if values.size else 0
        if self.top >= LARGE:
            return   # differences may pass 64 bits: such a block is scored exactly
        self.low = values.min(axis=0) if self.rows else np.zeros(dims, np.int64)
        self.spread = (values.max(axis=0) - self.low) if self.rows else self.low
        top = int(self.spread.max()) if self.rows and dims else 0
        self.shift = max(0, top.bit_length() - SLICES)
        coarse = ((values - self.low) >> self.shift).astype(np.uint64)
        self.words = (self.rows + 63) // 64
        bits = np.zeros((dims, SLICES, self.words * 64), np.uint8)
        for s in range(SLICES):
            bits[:, s, :self.rows] = ((coarse >> np.uint64(s)) & np.uint64(1)).T
        self.slices = np.packbits(bits, axis=-1, bitorder="little").view(np.uint64).reshape(dims, SLICES, self.words)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:self.rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the approximate scores, width): two rows' exact scores
        differ from their sums' difference (times ``step``) by at most the
        width, given in the sums' unit."""
        terms: dict[tuple[int, int], list[int]] = {}   # (sign, shift) -> dimensions
        width = 0
        step = 1 << self.shift
        for d, q in enumerate(query.tolist()):
            kept = _signed_digits(q, DIGITS)
            rounded = sum(s << shift for s, shift in kept)
            # what rounding the rows (0..step - 1 each) and the query leaves out
            width += abs(rounded) * (step - 1) + abs(q - rounded) * int(self.spread[d])
            for term in kept:
                terms.setdefault(term, []).append(d)
        columns: dict[int, list[np.ndarray]] = {}
        for (sign, shift), dims in terms.items():
            picked = self.slices[dims]
            if sign < 0:
                picked = ~picked
            for s in range(SLICES):
                columns.setdefault(shift + s, []).append(picked[:, s])
        out, place = [], 0
        pending = {p: np.concatenate(b) for p, b in columns.items()}
        while pending:
            m = pending.pop(place, None)
            carries = []
            if m is None:
                out.append(np.zeros(self.words, np.uint64))
            else:
                while len(m) > 1:
                    thirds = len(m) // 3
                    if thirds:
                        a, b, c = m[0:3 * thirds:3], m[1:3 * thirds:3], m[2:3 * thirds:3]
                        ab = a ^ b
                        carries.append((a & b) | (c & ab))
                        m = np.concatenate([ab ^ c, m[3 * thirds:]])
                    else:
                        carries.append((m[0] & m[1])[None])
                        m = (m[0] ^ m[1])[None]
                out.append(m[0])
            if carries:
                up = np.concatenate(carries)
                pending[place + 1] = np.concatenate([pending[place + 1], up]) if place + 1 in pending else up
            place += 1
        return out, -(-width // step)

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward."""
        inside, value, need = self.valid, 0, k
        for place in range(len(sums) - 1, -1, -1):
            ones = inside & sums[place]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                inside, value = ones, value | 1 << place
            else:
                need -= n
                inside = inside & ~sums[place]
        return value

    def at_least(self, sums: list[np.ndarray], bound: int) -> np.ndarray:
        """Row numbers whose sum is ``bound`` or more."""
        if bound <= 0:
            return np.arange(self.rows)
        if bound >> len(sums):
            return np.empty(0, np.int64)
        above, equal = np.zeros_like(self.valid), self.valid
        for place in range(len(sums) - 1, -1, -1):
            if bound >> place & 1:
                equal = equal & sums[place]
            else:
                above = above | (equal & sums[place])
                equal = equal & ~sums[place]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[:self.rows])

    def best(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, exact scores) of the k best rows other than the query's own."""
        own = int(np.count_nonzero(self.ids == own_id))
        if self.rows - own <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self.top >= LARGE or self.top * sum(map(abs, query.tolist())) >= LARGE:
            return self._exact(own_id, query, k)
        sums, width = self.sums(query)
        wanted = min(k + own, self.rows)
        bound = self.kth(sums, wanted) - width if sums else 0
        rows = self.at_least(sums, bound) if sums else np.arange(self.rows)
        rows = rows[self.ids[rows] != own_id]
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


    def _exact(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``best``, in whole numbers of any size: scores beyond 64 bits
        count as the nearest long."""
        others = np.flatnonzero(self.ids != own_id)
        q = query.tolist()
        scores = [max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, q)))) for v in self.values[others].tolist()]
        order = sorted(range(len(others)), key=lambda i: (-scores[i], self.ids[others[i]]))[:k]
        return self.ids[others[order]], np.array([scores[i] for i in order], np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, dims, v`` (integers) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dims"),
                    F.transform(e, lambda x: F.floor(x.cast("double") * SCALE)).alias("v")))


def _blocks(q: DataFrame, size: int, rows: int, name: str) -> DataFrame:
    """Packed blocks (``dims, <name>, ids, data``): rows are dealt by a hash
    into blocks of about ``size`` rows, so no id or vector decides a block's
    size (equal rows are dealt apart by a running number)."""
    n = max(1, math.ceil(rows / size))
    dealt = q.withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        ids = np.array(t.column("vec_id").to_pylist(), "<i8")
        flat = t.column("v").combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(
            [c.flatten() for c in flat.chunks])
        data = flat.to_numpy(zero_copy_only=False).astype("<i8")
        return pa.table({"dims": pa.array([t.column("dims")[0].as_py()], pa.int32()),
                         name: pa.array([t.column(name)[0].as_py()], pa.int32()),
                         "ids": pa.array([ids.tobytes()], pa.binary()),
                         "data": pa.array([data.tobytes()], pa.binary())})

    return dealt.groupBy("dims", name).applyInArrow(run, f"dims int, {name} int, ids binary, data binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best for each query."""
    ship(vectors.sparkSession)
    q = quantised(vectors)
    rows = vectors.count()
    n = max(1, math.ceil(rows / block))
    index = _blocks(q, block, rows, "ib")
    asked = q.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    # each query block goes to every index block: rows of a stated query set, in blocks
    queries = (_blocks(asked, QUERY_BLOCK, math.ceil(rows / every), "qb")
               .select("dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                       F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ib")))
    pairs = index.join(queries, ["dims", "ib"]).select("dims", "ids", "data", "q_ids", "q_data", "ib")

    def run(batches):
        held, key = None, None
        for b in batches:
            for dims, ids, data, q_ids, q_data, _ in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, "<i8")
                if key != (dims, ids.tobytes()):
                    held, key = Block(ids, np.frombuffer(data, "<i8").reshape(len(ids), dims)), (dims, ids.tobytes())
                q_ids = np.frombuffer(q_ids, "<i8")
                out = [(int(i), *held.best(int(i), v, k))
                       for i, v in zip(q_ids, np.frombuffer(q_data, "<i8").reshape(len(q_ids), dims))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()),
                     pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                     pa.array(np.concatenate([o[2] for o in out]), pa.int64())], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_topk(vectors: DataFrame) -> DataFrame:
    """The query's rows."""
    return top_k(vectors.select("vec_id", "embedding"))
