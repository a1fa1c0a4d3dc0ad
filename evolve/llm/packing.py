"""Packing token sequences into windows by Karmarkar-Karp differencing.

A document is its tokens and one end token.  It is cut into whole windows of
``capacity`` tokens first; the rest is cut once more into a head (a multiple
of ``GRAIN``) and a tail, so that what is packed has many small parts.  The
pieces are dealt by a hash into groups of bounded expected size.  In a group,
whole windows are sequences already and the others are partitioned into
k = ceil(tokens / capacity) windows by multiway differencing: every piece
starts as a partial partition with one filled window, and the two partial
partitions with the largest differences are merged again and again, the
fullest window of one with the emptiest of the other.  The windows that come
out are nearly equal; if one exceeds the capacity, k rises and the group is
partitioned anew.

Only piece descriptions (about 50 bytes) are shuffled, never tokens.

Defined results: null text is the empty text, so such a document is its end
token alone; rows that share a doc_id are packed one by one, each with its
own ``start`` from 0; a null doc_id is packed like any other; an empty table
gives an empty result; other columns are ignored.  ``sequence_id`` is unique,
not gapless.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.llm.common import ship, slices
from evolve.llm.tokens import load, public_path

CAPACITY = 2048
GRAIN = 256
END_ID = 1
DOCS_PER_GROUP = 1024
MODEL = "byte_bpe_50k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k parts of nearly equal sums (multiway
    differencing).  A partial partition is the sorted window sums, less the
    smallest, and the node that fills each window; nodes form a binary tree
    over the pieces, so a merge costs one pass over k numbers."""
    left, right = [], []          # inner nodes, numbered from len(sizes) + 1; 0 is an empty window
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[-1], nodes[-1] = s, i + 1
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        sums, a, b = s1 + s2[::-1], n1, n2[::-1]
        both = np.flatnonzero((a > 0) & (b > 0))
        nodes = np.where(a > 0, a, b)
        if len(both):
            nodes[both] = n + 1 + len(left) + np.arange(len(both))
            left.extend(a[both].tolist())
            right.extend(b[both].tolist())
        by = np.argsort(sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        sums = sums - sums[0]
        order += 1
        heapq.heappush(heap, (-int(sums[-1]), order, sums, nodes))
    parts = []
    for root in (heap[0][3].tolist() if heap else []):
        part, todo = [], [root] if root else []
        while todo:
            x = todo.pop()
            if x <= n:
                part.append(x - 1)
            else:
                todo += (left[x - n - 1], right[x - n - 1])
        if part:
            parts.append(sorted(part))
    return parts


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts whose sums are at most ``capacity``; no size may exceed it."""
    if not sizes:
        return []
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        parts = partition(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return parts
        k += max(1, k // 256)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    full = n // capacity * capacity
    out = [(i, capacity) for i in range(0, full, capacity)]
    head = (n - full) // GRAIN * GRAIN
    out += [(full, head)] if head else []
    return out + ([(full + head, n - full - head)] if n - full - head else [])


def pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, deal
    (a running number of the task, to deal rows with equal values apart) and,
    if asked for, ids."""
    ship(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        tok, deal = load(model_path), 0
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(tok.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start, length in cuts(len(ids), capacity):
                    part = ids[start:start + length]
                    rows.append((doc, start, length, zlib.crc32(part.tobytes()), len(ids), deal) + (
                        (part.astype(np.int32),) if with_ids else ()))
                    deal += 1
            types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"] + ["ids"] * with_ids
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def packed(docs: DataFrame, model_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           docs_per_group: int = DOCS_PER_GROUP, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (and ``ids``, if asked for)."""
    p = pieces(docs, model_path or public_path(MODEL), capacity, end_id, with_ids)
    groups = max(1, math.ceil(docs.count() / docs_per_group))
    p = p.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(groups)))
    kept = [f for f in p.schema if f.name not in ("grp", "deal")]
    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("grp")[0].as_py()
        sizes = rows.column("length").to_pylist()
        whole = [i for i, s in enumerate(sizes) if s == capacity]
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        windows = [[i] for i in whole] + [[rest[j] for j in part] for part in pack([sizes[i] for i in rest], capacity)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, part in enumerate(windows):
            at = 0
            for i in part:
                sequence[i], offset[i] = (group << 24) + w, at
                at += sizes[i]
        return (rows.select(names).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)))

    return p.groupBy("grp").applyInArrow(run, schema)


def packing(docs: DataFrame) -> DataFrame:
    """The query's rows: every piece of every document."""
    return packed(docs.select("doc_id", "text"))
