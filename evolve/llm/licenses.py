"""License scans: fixed phrases, and fuzzy search for short notices.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case, i.e. runs of bytes 0-9, a-z and 80-FF of its UTF-8; numpy finds them in
a whole Arrow batch at once.

*Fixed phrases* are places where their words stand consecutively.

*Fuzzy notices*: words joined by single spaces are searched for each notice
with at most ``edits`` edits.  By the pigeonhole principle, a notice split
into edits + 1 pieces has one piece without an edit, so plain substring
search for the pieces finds every place a match can be; the regex library's
bounded-error matching then verifies a window around each, and gives the
span and the edits.  Edits don't decide the licence: the words of a notice that
tell it from its relatives (a version, ``nc``, ``lesser``) must stand in the match
unchanged (:class:`Notice`).  ``score`` is 1 - edits / length of the best match (1 for
a fixed phrase, 0 without any).

Every text is scanned whole, in place: no shuffle, and memory is that of about
4 MB of texts or the longest one.  Defined results: null text is the empty text, without words;
repeated rows are scanned one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.llm.common import ship, slices, utf8

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

@dataclass(frozen=True)
class Notice:
    """A notice that names a licence, as words joined by spaces.  Edits may
    fall anywhere but on ``exact``, the words that tell its licence from its
    relatives, which must stand in the match as they are; a match that one of
    ``not_before`` follows is a relative's."""
    label: str
    text: str
    exact: tuple[str, ...] = ()
    not_before: tuple[str, ...] = ()


_CC_PARTS = ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "non", "no", "share")
_GNU = "licensed under the gnu {}general public license version {}"

# The default notices; every function takes others.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("2",)),
    Notice("apache-1.1", "licensed under the apache license version 1 1", ("1", "1")),
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    *(Notice(f"cc-by{''.join('-' + p for p in parts)}-4.0", " ".join(("licensed under cc by", *parts, "4 0")),
             ("cc", "by", *parts, "4"))
      for parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd"))),
    Notice("cc-by", "licensed under the creative commons attribution", (), _CC_PARTS),
    Notice("cc-by-nc", "licensed under the creative commons attribution noncommercial", ("noncommercial",), _CC_PARTS),
    Notice("cc-by-sa", "licensed under the creative commons attribution sharealike", ("sharealike",)),
    Notice("cc-by-nd", "licensed under the creative commons attribution noderivatives", ("noderivatives",)),
    *(Notice(f"{name}-{version}.0", _GNU.format(word, version), (*word.split(), version))
      for name, word, versions in (("gpl", "", "23"), ("lgpl", "lesser ", "23"), ("agpl", "affero ", "3"))
      for version in versions),
    Notice("lgpl", "licensed under the gnu lesser general public license", ("lesser",), ("version", "v2", "v3")),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("mpl", "subject to the terms of the mozilla public license", ("mozilla",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)
CHARS_PER_EDIT = 12

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_WORD = rb"[0-9a-z\x80-\xff]"
_PHRASES = [(label, re.compile(rb"[^0-9a-z\x80-\xff]+".join(p.encode().split()) + rb"(?!" + _WORD + rb")"))
            for p, label in PHRASES.items()]


@dataclass(frozen=True)
class Match:
    label: str
    first_word: int
    start: int       # code points of the text
    end: int
    edits: int
    length: int


@functools.cache
def _compiled(notice: str):
    """(edits, [(piece, its place)], pattern) of a notice."""
    body = notice.encode()
    edits = max(1, len(body) // CHARS_PER_EDIT)
    bounds = [len(body) * i // (edits + 1) for i in range(edits + 2)]
    pieces = [(body[a:b], a) for a, b in zip(bounds, bounds[1:])]
    pattern = regex.compile(rb"(?:" + regex.escape(body, special_only=True) + rb"){e<=%d}" % edits, regex.BESTMATCH)
    return edits, pieces, pattern


def _places(piece: bytes, body: bytes) -> list[int]:
    out, at = [], body.find(piece)
    while at >= 0:
        out.append(at)
        at = body.find(piece, at + 1)
    return out


def fuzzy(body: bytes, notice: str) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in normalised bytes: candidate
    windows from the pieces, merged where they overlap, then verified."""
    edits, pieces, pattern = _compiled(notice)
    size = len(notice.encode())
    windows = sorted((max(0, at - place - edits), at - place + size + edits)
                     for piece, place in pieces for at in _places(piece, body))
    merged: list[list[int]] = []
    for a, b in windows:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    found = []
    for a, b in merged:
        # a merged window may hold several matches; the best comes first, so
        # the stretches before and after it are searched again
        open_ = [(a, min(b, len(body)))]
        while open_:
            a, b = open_.pop()
            m = pattern.search(body, a, b) if b - a >= size - edits else None
            if m:
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                open_ += [(a, m.start()), (m.end(), b)]
    return sorted(found)


def scan_batch(column, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, list[tuple[int, str]], list[Match]]]:
    """(n_words, base places as (word number, label), notice matches) per row."""
    data, offsets = utf8(column)
    # a separator after each row: no word or phrase end runs into the next row
    data = np.insert(data, offsets[1:], np.uint8(0))
    offsets = offsets + np.arange(len(offsets))
    low = LOWER[data]
    word = WORD_BYTE[low]
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & ~before)
    first = np.searchsorted(starts, offsets)
    body = low.tobytes()
    base: dict[int, list[tuple[int, str]]] = {}
    for label, pattern in _PHRASES:
        for m in pattern.finditer(body):
            row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            at = int(np.searchsorted(starts, m.start()))
            if m.end() < offsets[row + 1] and at < len(starts) and starts[at] == m.start():
                base.setdefault(row, []).append((at - int(first[row]), label))
    # normalised bytes: words joined by single spaces
    keep = word | before
    kept = np.flatnonzero(keep)
    normal = np.where(word[kept], low[kept], np.uint8(32)).tobytes()
    cut = np.searchsorted(kept, offsets)
    out = []
    for row in range(len(offsets) - 1):
        part = normal[cut[row]:cut[row + 1]]
        matches = []
        for notice in notices:
            for a, b, edits in fuzzy(part, notice.text):
                if not is_that(part, a, b, notice):
                    continue
                lo, hi = int(kept[cut[row] + a]), int(kept[cut[row] + b - 1]) + 1
                text = data[offsets[row]:lo].tobytes().decode("utf-8", "ignore")
                span = data[lo:hi].tobytes().decode("utf-8", "ignore")
                at = max(0, int(np.searchsorted(starts, lo, side="right")) - 1 - int(first[row]))
                matches.append(Match(notice.label, at, len(text), len(text) + len(span), edits, len(notice.text)))
        out.append((int(first[row + 1] - first[row]), sorted(base.get(row, [])), matches))
    return out


def is_that(part: bytes, start: int, end: int, notice: Notice) -> bool:
    """Whether a match in normalised bytes holds the notice's exact words, and
    none follows that makes it another licence's."""
    while start and part[start - 1:start] != b" ":   # whole words
        start -= 1
    stop = part.find(b" ", end - 1)
    stop = len(part) if stop < 0 else stop
    words = part[start:stop].decode("utf-8", "ignore").split()
    after = part[stop:stop + 40].decode("utf-8", "ignore").split()[:1]
    return all(words.count(w) >= notice.exact.count(w) for w in notice.exact) and not set(after) & set(notice.not_before)


def score(base, matches: list[Match]) -> float:
    return max([1.0 if base else 0.0] + [1 - m.edits / m.length for m in matches])


def scanned(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``doc_id, found``: every place with its label, span and edits."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("start", pa.int64()),
                               ("end", pa.int64()), ("edits", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            found = [[dict(label=m.label, first_word=m.first_word, start=m.start, end=m.end, edits=m.edits)
                      for m in matches] for _, _, matches in scan_batch(b.column(1), notices)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, found array<struct<label: string, first_word: long, start: long, end: long, edits: long>>")


def license_scans(docs: DataFrame) -> DataFrame:
    """The query's rows for every document; ``spans`` lists the notices as
    label:start:end:edits, comma-joined."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            rows = []
            for n, base, matches in scan_batch(b.column(1)):
                places = [p for p, _ in base]
                labels = {x for _, x in base}
                rows.append((n, len(base), min(places, default=None), max(places, default=None),
                             ",".join(sorted(labels)), ",".join(sorted(labels | {m.label for m in matches})),
                             score(base, matches),
                             ",".join(f"{m.label}:{m.start}:{m.end}:{m.edits}"
                                      for m in sorted(matches, key=lambda m: (m.start, m.end, m.label)))))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, spans string")
