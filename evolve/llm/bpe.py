"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

The encoder keeps the parts of a pre-token as a linked list over positions.
Every adjacent pair whose joined bytes have a merge rank lies in that rank's
bucket.  A two-level bitmap tells which buckets hold anything: bit r % 1024 of
block r / 1024, and bit b of the top word if block b isn't empty; find first
set on the top word and then on the block gives the next rank in constant
time, whatever the number of parts.  A merge joins the leftmost pair of the
bucket, unlinks the right part and files the two new pairs; entries whose
parts have changed since are stale and skipped.  So a pre-token of n bytes
takes about n log n steps, where a scan for the smallest rank takes n * n.

Pre-tokens are those of the tiktoken library.  The regex library knows a newer
Unicode, so some code points are letters or numbers to it and not to tiktoken;
they are found once on the driver, from tiktoken's own answers
(:func:`unlike_classes`).  A text in which one shows up in a pre-token is split
again with these code points taken out of the classes.

Pre-tokens repeat, so a worker remembers their ids, in two generations of at
most ``REMEMBER`` entries each: memory is bounded and results don't depend on
what is remembered.

Defined results: null text is the empty text (0 ids, digest of nothing); a very
long text is encoded whole, its ids in memory at once;
repeated rows are encoded one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.llm.common import ship, slices
from evolve.llm.tokens import public_path

RANKS = "byte_bpe_multi_50k.tiktoken"
REMEMBER = 700_000
LONGEST_REMEMBERED = 64  # bytes
BLOCK = 10
IN_BLOCK = (1 << BLOCK) - 1


class BytePairs:
    """An encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, unlike: str = ""):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.unlike = regex.compile(f"[{unlike}]").search if unlike else lambda piece: None
        self.exact_split = regex.compile(without(pattern, unlike), regex.V1).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.  The queue's two operations stand inline:
        a call for each would cost more than the operation."""
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        whole = get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))       # part at i is data[i:end[i]]; end[i] is also the next part
        before = list(range(-1, n - 1))
        filed = [-1] * n                  # rank under which the pair (part i, next part) is filed
        buckets: dict[int, list[int]] = {}
        blocks: dict[int, int] = {}
        top = 0
        new = range(n - 1)                # places whose pair is to be filed
        while True:
            for i in new:
                if i < 0 or end[i] >= n:
                    continue
                rank = get(data[i:end[end[i]]])
                if rank is None:
                    filed[i] = -1
                    continue
                filed[i] = rank
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = [i]
                    block = rank >> BLOCK
                    blocks[block] = blocks.get(block, 0) | 1 << (rank & IN_BLOCK)
                    top |= 1 << block
                else:
                    push(held, i)
            while top:
                block = (top & -top).bit_length() - 1
                bits = blocks[block]
                rank = (block << BLOCK) | (bits & -bits).bit_length() - 1
                held = buckets[rank]
                if len(held) > 1:
                    i = pop(held)
                else:
                    i = held[0]
                    del buckets[rank]
                    bits &= bits - 1
                    blocks[block] = bits
                    if not bits:
                        top &= top - 1
                if filed[i] == rank:      # else stale: the pair has changed or is gone
                    break
            else:
                break
            j = end[i]
            k = end[i] = end[j]
            filed[j] = filed[i] = -1
            if k < n:
                before[k] = i
            new = (before[i], i)
        out, i = [], 0
        while i < n:
            out.append(get(data[i:end[i]]))
            i = end[i]
        return out

    def packed(self, piece: str) -> bytes:
        """The ids of one pre-token as little-endian 32-bit integers, remembered."""
        ids = self.old.get(piece)
        if ids is None:
            merged = self.merge(piece.encode())
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBER:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        pieces = self.split(text)
        found = list(map(self.young.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    if self.unlike(pieces[i]):  # such a piece is never remembered
                        return b"".join(map(self._exact, self.exact_split(text)))
                    found[i] = self.young.get(pieces[i]) or self.packed(pieces[i])
        return b"".join(found)

    def _exact(self, piece: str) -> bytes:
        if self.unlike(piece):
            merged = self.merge(piece.encode())
            return struct.pack(f"<{len(merged)}I", *merged)
        return self.young.get(piece) or self.packed(piece)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def unlike_classes() -> str:
    """The code points that the regex library counts as letters or numbers and
    tiktoken doesn't, as the inside of a character class."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    unlike: set[str] = set()
    for group in (r"\p{L}", r"\p{N}"):
        byte = tiktoken.Encoding("class", pat_str=group, mergeable_ranks={bytes([i]): i for i in range(256)},
                                 special_tokens={})
        theirs = byte.decode_bytes(byte.encode_ordinary(everything)).decode()  # what doesn't match has no ids
        unlike |= set(regex.findall(group, everything)) - set(theirs)
    points = np.array(sorted(map(ord, unlike)), np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


def without(pattern: str, unlike: str) -> str:
    """The pattern (for regex.V1) with letters and numbers without some code points."""
    if not unlike:
        return pattern
    return regex.sub(r"\\p\{([LN])\}", lambda m: rf"[\p{{{m[1]}}}--[{unlike}]]", pattern)


@functools.cache
def load_ranks(path: str, unlike: str = "") -> BytePairs:
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return BytePairs({base64.b64decode(token): int(rank) for token, rank in lines}, unlike=unlike)


def encoded(docs: DataFrame, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, if asked for)."""
    path = ranks_path or public_path(RANKS)
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    unlike = unlike_classes()

    def run(batches):
        bpe = load_ranks(path, unlike)
        for b in slices(batches):
            count, sent, back, kept = [], [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py() or "")
                count.append(len(ids) // 4)
                sent.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<i4"))
            columns = [b.column(0), pa.array(count, pa.int64()), pa.array(sent, pa.string()),
                       pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bpe(docs: DataFrame) -> DataFrame:
    """The query's rows for every document."""
    return encoded(docs.select("doc_id", "text"))
