"""Secret scans: three fixed patterns, and zstandard novelty for the rest.

The patterns find assignments, access keys and long hex strings.  Novelty
finds what has no fixed form: a *run* is 10 or more token characters, cut
where base spans cover it and at each ``=`` (padding at its end stays), so a
name is never measured with its value.  A *candidate* is a part of 16 or more
that a sensitive word precedes on its line or the line before: within
``REACH`` characters, or in the part before it, its name.  (If no part is
reported, the parts are one candidate together; then parts of 10 or more.)  A
sensitive word is a whole part of an identifier (``author`` and ``monkey`` hold
none).  A zstandard compressor is primed with a raw dictionary: common
identifiers, the words that most documents of the corpus share
(:func:`identifier_dictionary`), and the text around the candidate (the
candidate's own copies taken out); the candidate's marginal cost is the bytes
it adds to an otherwise empty frame.  A name, path or word that the
surroundings explain costs a few bytes.

A candidate is reported if it costs at least ``NOVEL`` of its length and
isn't spelled like words: a short string that no dictionary holds costs its
length whether it is a key or a rare word, so what consists of words, short
segments and numbers between separators (``ca-certificates/root_2.crt``,
``Verwaltungsgericht``) stays.  Where the sensitive word doesn't name the
candidate (no ``:``, ``=`` or quote between them, nor the candidate next to it),
it must also mix letters and digits; so must a candidate under 16 characters.

The values of base spans are measured the same way; ``novelty`` of a row holds
the cost of every span per byte, in their order.

Spans are (kind, start, end) in code points, end exclusive, by start and then
by the kinds' order.  A novel span never overlaps a base span.

Every text is scanned whole, in place: no shuffle, and memory is that of about
4 MB of texts or the longest one.  Defined results: null text is the empty text, without spans;
repeated rows are scanned one by one; an empty table gives an empty result;
``redacted`` returns extra columns as they came.  The corpus dictionary takes one
more pass over the texts (words of every text, counted by documents); an empty
corpus gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.llm.common import ship, slices, texts_of

# The base patterns and the smallest lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS = 8
ACCESS_CHARS = 16

KINDS = ("assign", "access", "hex", "novel")

CANDIDATE_CHARS = 16
SHORT_CHARS = 10
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % SHORT_CHARS)
PART = re.compile(r"[^=]+(?:=+$)?")
# Sensitive words, each a whole part of an identifier.
SENSITIVE = frozenset("""
pass passwd password passwords passphrase passcode pwd secret secrets token tokens key keys apikey auth oauth
authorization authentication cred creds credential credentials bearer private access login signature signing
""".split())
_HINT = re.compile("|".join(sorted({w[:4] for w in SENSITIVE})), re.IGNORECASE | re.ASCII)
IDENTIFIER_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NAMES_IT = re.compile(r"""[:="'`]|^\s*$""")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
CONSONANTS = re.compile(r"[^aeiouy]{7}")
SPELLED = 0.8
REACH = 48
AROUND = 2048
NOVEL = 0.55
MASK = "<secret>"

DICTIONARY_BYTES = 32 << 10
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{5,31}", re.ASCII)

# What code around credentials commonly says; primes every dictionary.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000-0000-0000-0000-000000000000
username password passphrase credentials authorization authentication access_token refresh_token
client_id client_secret api_key apikey private_key public_key secret_key session_key signature
certificate fingerprint Bearer Basic Authorization: https://www.example.com/path/index.html
application/json Content-Type localhost config settings environment production development default
function return import export const string integer boolean true false null undefined self this
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- getElementById addEventListener toString
version timestamp datetime created_at updated_at example placeholder changeme your_token_here xxxxxxxx
""".strip()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_CHARS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def identifier_dictionary(docs: DataFrame, text_col: str = "text", max_bytes: int = DICTIONARY_BYTES) -> str:
    """The words of 6 to 32 characters that the most documents hold (two at
    least), as many as ``max_bytes`` take, the most common last, where a match
    costs least.  All texts are counted, with partial sums in every task; the
    driver receives 64 x ``max_bytes`` / 6 words at most."""
    ship(docs.sparkSession)

    def words(batches):
        for b in slices(batches, 0):
            held: dict[str, int] = {}
            for t in texts_of(b.column(0)):
                for w in set(WORD.findall(t)):
                    held[w] = held.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             ["word", "n"])

    most = max_bytes // 6
    counts = (docs.select(F.col(text_col).alias("text")).mapInArrow(words, "word string, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # the first of each of 64 parts, so that what the driver merges doesn't grow with the partitions
    part = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    top = (counts.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
           .orderBy(F.desc("n"), "word").limit(most).collect())
    kept, size = [], 0
    for r in top:
        size += len(r.word) + 1
        if size > max_bytes:
            break
        kept.append(r.word)
    return " ".join(reversed(kept))


def novelty(candidate: str, around: str, words: str = "") -> float:
    """Marginal compressed bytes of the candidate per byte of it."""
    held = (words + "\n" + IDENTIFIERS + "\n" + around.replace(candidate, " ")).encode()
    primed = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)
    body = candidate.encode()
    return (len(press.compress(body)) - len(press.compress(b""))) / len(body)


def spelled(candidate: str) -> bool:
    """Whether a string reads as words, short segments and numbers between separators."""
    explained = len(candidate)
    for m in SEGMENT.finditer(candidate):
        segment = m.group()
        if len(segment) <= 3 and segment.isalpha() or len(segment) <= 4 and segment.isdigit():
            continue
        words = [p for p in IDENTIFIER_PART.findall(segment) if len(p) > 3]
        explained -= len(segment) - sum(len(w) for w in words if re.search("[aeiouy]", w.lower())
                                        and not CONSONANTS.search(w.lower()))
    return explained >= SPELLED * len(candidate) and any(c.isalpha() for c in candidate)


def _mixed(candidate: str) -> bool:
    """Letters and digits that take turns, not a word with a number."""
    kinds = ["0" if c.isdigit() else "a" for c in candidate if c.isalnum()]
    return sum(x != y for x, y in zip(kinds, kinds[1:])) >= 3


def _named(before: str) -> bool | None:
    """Whether a sensitive word before a candidate names it; None without one."""
    found = [m for m in IDENTIFIER_PART.finditer(before) if m.group().lower() in SENSITIVE]
    return bool(NAMES_IT.search(before[found[-1].end():])) if found else None


def _bare(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start of the run, start, end) of what no base span covers of each run."""
    covered = sorted((s, e) for _, s, e in taken)
    first = 0
    for run in RUN.finditer(text):
        at, end = run.span()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        i = first
        while i < len(covered) and covered[i][0] < end:
            if at < covered[i][0]:
                yield run.start(), at, covered[i][0]
            at = max(at, covered[i][1])
            i += 1
        if at < end:
            yield run.start(), at, end


def novel_spans(text: str, taken: list[tuple[str, int, int]], words: str = "") -> list[tuple[str, int, int, float]]:
    """What no base span covers: (kind, start, end, novelty)."""
    if not _HINT.search(text):
        return []

    def novel(name: int, start: int, end: int, least: int = CANDIDATE_CHARS):
        if end - start < least:
            return None
        before = text[max(0, min(name, start - REACH)):start]
        named = _named("\n".join(before.split("\n")[-2:]))
        if named is None:
            return None
        cost = novelty(text[start:end], _around(text, start, end), words)
        found = text[start:end]
        if cost < NOVEL or spelled(found) or not (named and least == CANDIDATE_CHARS or _mixed(found)):
            return None
        return "novel", start, end, cost

    out = []
    for run, start, end in _bare(text, taken):
        if end - start < SHORT_CHARS:
            continue
        parts = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end])]
        names = [run] + [a for a, _ in parts]
        found = [novel(name, a, b) for name, (a, b) in zip(names, parts)]
        if not any(found) and len(parts) > 1:   # its parts may be short
            found = [novel(run, start, end)]
        if not any(found):
            found = [novel(name, a, b, SHORT_CHARS) for name, (a, b) in zip(names, parts)]
        out += [f for f in found if f]
    return out


def _around(text: str, start: int, end: int) -> str:
    return text[max(0, start - AROUND):start] + " " + text[end:end + AROUND]


def _value(text: str, span: tuple[str, int, int]) -> tuple[int, int]:
    """Where the secret itself stands in a base span."""
    kind, start, end = span
    return ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start, end)


def measured(text: str, words: str = "") -> list[tuple[str, int, int, float]]:
    """All spans of a text with their novelty, in order."""
    base = base_spans(text)
    costs = [(*s, novelty(text[a:b], _around(text, a, b), words)) for s in base for a, b in [_value(text, s)]]
    return sorted(costs + novel_spans(text, base, words), key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str, words: str = "") -> list[tuple[str, int, int]]:
    """All spans of a text, in order."""
    base = base_spans(text)
    return sorted(base + [s[:3] for s in novel_spans(text, base, words)], key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans) -> str:
    """The text with every (merged) span replaced by the mask."""
    out, at, until = [], 0, -1
    for _, s, e in spans:
        if s >= until:
            out += (text[at:s], MASK)
        until = max(until, e)
        at = max(at, e)
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, words: str | None = None) -> DataFrame:
    """``doc_id, found``: the spans of every row as an array of structs, with
    their novelty.  ``words``: the dictionary, if it isn't to be made from
    ``docs``."""
    ship(docs.sparkSession)
    words = identifier_dictionary(docs) if words is None else words
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches):
        for b in slices(batches):
            found = [[dict(kind=k, start=s, end=e, novelty=n) for k, s, e, n in measured(t, words)]
                     for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, found array<struct<kind: string, start: long, end: long, novelty: double>>")


def redacted(docs: DataFrame, text_col: str = "text", words: str | None = None) -> DataFrame:
    """``docs`` with every secret in the text masked; ``n_chars`` (if there)
    counts the new text, the other columns stay."""
    ship(docs.sparkSession)
    words = identifier_dictionary(docs, text_col) if words is None else words
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, at):
            texts = [None if t is None else redact(t, scan(t, words)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out


def secret_scans(docs: DataFrame) -> DataFrame:
    """The query's rows for every document."""
    ship(docs.sparkSession)
    words = identifier_dictionary(docs)

    def run(batches):
        for b in slices(batches):
            rows = []
            for t in texts_of(b.column(1)):
                found = measured(t, words)
                spans = [s[:3] for s in found]
                base = [s for s in spans if s[0] != "novel"]
                rows.append([sum(s[0] == k for s in base) for k in KINDS[:3]] + [
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [s[3] for s in found]])
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
             "novelty array<double>")
