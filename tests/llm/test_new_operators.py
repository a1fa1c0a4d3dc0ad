"""Conversation repair, collocations and URL filters against brute force:
nulls, empty and very long texts, ties, repeated rows, clashing extra columns,
empty tables."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evolve.llm import collocations, conversations, url_filters

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- conversations -------------------------------------------------------------

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by a plain
    recursion over the rows left and the last initial put out."""
    @functools.lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (last, role[:1]) in STEP:
                    c, a, r = best(i + 1, role[0], 0)
                    found.append((c + more, "K" + a, ((role, text), *r)))
                for new in ("user", "assistant"):
                    if (last, new[0]) in STEP:
                        c, a, r = best(i + 1, new[0], 0)
                        found.append((c + 2 + more, "R" + a, ((new, text), *r)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if (last, new[0]) in STEP:
                    c, a, r = best(i, new[0], inserted + 1)
                    found.append((c + 2, "I" + a, ((new, ""), *r)))
        return min(found, key=lambda f: f[:2], default=(10 ** 9, "", ()))
    return best(0, "", 0)


def brute_repair(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        d = zlib.crc32(key.encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for conv, said in convs.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in said if t is not None]
        seen, faults = set(), []
        for _, role, text in said:
            letters = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen
                          else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, fixed = cheapest(tuple((r, t, f) for (_, r, t), f in zip(said, faults)))
        initials = [r[:1] for _, r, _ in said]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.choice([1, 2, 3, 6, 9])):
            text = rnd.choice(["Yes.", "no", "", " \n", None, "Why so? ", "A long one " * 2000 + "!", f"t{rnd.randint(0, 3)}."])
            role = rnd.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "Assistant"])
            rows.append((conv, rnd.choice([turn] * 12 + [None, turn + 5]), role, text))
            if rnd.random() < .1:
                rows.append(rows[-1])
    # one turn holds one role and text, as ties go by hash
    unique = {}
    for r in rows:
        unique.setdefault(r[:2], r)
    return [unique[r[:2]] for r in rows]


TURNS = "conv_id long, turn long, role string, text string"


def test_conversation_repair(spark):
    rows = some_conversations(3, 150)
    df = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit(7)).withColumn("h1", F.lit("x")).repartition(5)
    assert rows_of(conversations.conversation_repair(df)) == brute_repair(rows)


def test_conversation_repair_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(conversations.conversation_repair(df)) == brute_repair(rows)


def test_conversation_repair_of_parts(spark, monkeypatch):
    """Conversations longer than a part: the parts' tables give the same audits."""
    monkeypatch.setattr(conversations, "PART", 4)
    rows = some_conversations(4, 60)
    rows += [(1000, t, random.Random(t).choice(["user", "assistant", "system"]), f"m{t % 23}" + "." * (t % 3)) for t in range(70)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert rows_of(conversations.conversation_repair(df)) == brute_repair(rows)


def test_conversation_repair_of_one_long_conversation(spark):
    """A part's worth of rows and more in one conversation, most of them copies."""
    rows = [(5, t, ("user", "assistant")[t % 2], "same text." if t % 3 else f"text {t}.") for t in range(9000)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got, = conversations.conversation_repair(df).collect()
    want, = brute_repair_long(rows)
    assert tuple(got) == want


def brute_repair_long(rows):
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100000)
    try:
        return brute_repair_iterative(rows)
    finally:
        sys.setrecursionlimit(limit)


def brute_repair_iterative(rows):
    """As brute_repair, with a table from the last row to the first."""
    said = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        said += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    seen, faults = set(), []
    for _, role, text in said:
        faults.append("blank" if not text.strip() else "duplicate" if (role, text) in seen
                      else "truncated" if text[-1] not in ".!?" else "")
        seen.add((role, text))
    # audits as (letters, rest) chains; compared by rank among the four states
    table = {"": (0, 0), "a": (0, 0), "u": (2, 1), "s": (4, 2)}
    back = []
    for (_, role, _), fault in zip(reversed(said), reversed(faults)):
        new, moves = {}, {}
        for last in ("", "s", "u", "a"):
            options, now = [], last
            for k in range(3):
                options.append((2 * k + 3 + table[now][0], "I" * k + "D", table[now][1], now))
                if fault not in ("blank", "duplicate"):
                    t = fault == "truncated"
                    if (now, role[0]) in STEP:
                        options.append((2 * k + t + table[role[0]][0], "I" * k + "K", table[role[0]][1], role[0]))
                    w = "a" if now == "u" else "u"
                    options.append((2 * k + 2 + t + table[w][0], "I" * k + "R", table[w][1], w))
                now = "a" if now == "u" else "u"
            new[last] = moves[last] = min(options)
        ranks = sorted({m[1:3] for m in new.values()})
        table = {q: (m[0], ranks.index(m[1:3])) for q, m in new.items()}
        back.append(moves)
    state, audit, fixed = "", "", []
    out = lambda q: "a" if q == "u" else "u"
    names = {"u": "user", "a": "assistant"}
    now = ""
    for (_, role, text), moves in zip(said, reversed(back)):
        _, letters, _, after = moves[state]
        for e in letters:
            if e == "I":
                now = out(now)
                fixed.append((names[now], ""))
            elif e == "K":
                now = role[0]
                fixed.append((role, text))
            elif e == "R":
                now = out(now)
                fixed.append((names[now], text))
        audit, state = audit + letters, after
    tail = {"": "", "a": "", "u": "I", "s": "II"}[state]
    for _ in tail:
        now = out(now)
        fixed.append((names[now], ""))
    initials = [r[0] for _, r, _ in said]
    turns = [t for t, _, _ in said]
    full = audit + tail
    cost = sum({"I": 2, "D": 3, "K": 0, "R": 2}[e] for e in full)
    kept = [e for e in full if e != "I"]
    cost += sum(f == "truncated" and e != "D" for f, e in zip(faults, kept))
    yield (rows[0][0], max(turns) - min(turns) + 1 - len(set(turns)),
           *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
           sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, full,
           hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def test_suffix_nodes_are_reused():
    """Sorted reversed signatures: a suffix that two share is worked out once."""
    t = conversations.Suffixes(conversations.ACCEPT)
    t.move("auau", 0)
    node = t.nodes[2]
    t.move("auu", 2)
    assert t.nodes[2] is node and len(t.nodes) == 4
    assert t.answer(0) == (2, "KIKK") == cheapest((("user", "x", ""),) * 2 + (("assistant", "x", ""),))[:2]


# -- collocations --------------------------------------------------------------

def brute_collocations(rows, support, top):
    f = collections.Counter()
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    around = collections.defaultdict(int)
    for (lang, w), a in cands.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                around[lang, w[i:i + size]] = max(a, around[lang, w[i:i + size]])
    out = collections.defaultdict(list)
    for (lang, w), a in cands.items():
        if 100 * around[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                             for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                   for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)), key=repr)


def some_texts():
    rnd = random.Random(9)
    vocabulary = ["the", "The", "of", "new", "york", "times", "é", "中文", "a\x0bb", "x" * 300, "\x00", "city"]
    rows = []
    for _ in range(300):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        text = "".join(w + rnd.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", " \t "]) for w in words)
        rows.append((rnd.choice(["en", "en", "de", None]), text))
    rows += [("en", None), (None, ""), ("fr", " . "), ("en", "new york city " * 3000), ("es", "el el el " * 200)] + rows[:20]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i // 2 if i % 5 else None, l, t, "k", 1) for i, (l, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, n int").repartition(4)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_collocations(spark, shards):
    rows = some_texts()
    got = collocations.collocations(documents(spark, rows), top=40, shards=shards)
    assert rows_of(got) == brute_collocations(rows, 30, 40)


def test_collocations_in_stretches(spark, monkeypatch):
    """Texts longer than a stretch lose no phrase at its edges; a filter that
    is far too small lets more through and loses none."""
    monkeypatch.setattr(collocations, "STRETCH", 7)
    monkeypatch.setattr(collocations, "MAX_FILTER_BITS", 6)
    rows = some_texts()[:120]
    got = collocations.collocations(documents(spark, rows), support=9)
    assert rows_of(got) == brute_collocations(rows, 9, 2000)


def test_words_and_hashes():
    """Words, pieces and phrase keys of odd bytes against Python."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \t.,\nÉx") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = collocations.Words(body, offsets)
    got = [(d, bytes(w.body[a:z])) for d, a, z in zip(w.doc.tolist(), w.starts, w.ends)]
    want = [(d, x.encode()) for d, t in enumerate(texts) for x in re.findall(r"[^\x20\x09.,\n]+", t.translate(UP))]
    assert got == want
    keys = {}
    for k, (key, there) in enumerate(w.phrases(0, len(got), len(got), 4, collocations._Hash(1), np.zeros(len(texts), np.uint64)), 1):
        for i in np.flatnonzero(there).tolist():
            phrase = tuple(x for _, x in got[i:i + k])
            assert keys.setdefault(int(key[i]), phrase) == phrase
    want = {tuple(p[i:i + k]) for t in texts for piece in re.split(r"[.,\n]", t.translate(UP))
            for p in [[x.encode() for x in re.findall(r"[^\x20\x09]+", piece)]] for k in (1, 2, 3, 4) for i in range(len(p) - k + 1)}
    assert set(keys.values()) == want


# -- URL filters ---------------------------------------------------------------

def brute_filters(rows, rules):
    out = []
    for page, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(UP), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((page, host, path, best and best[3], best[2] if best else "allow"))
    return sorted(out, key=repr)


def some_urls():
    rnd = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "a.b.example.NET", "badexample.net", "example.com", "x.org", "org",
             "example.net:80", ".net", "net.", "", "ünï.org", "a" * 3000 + ".net"]
    paths = ["", "/", "/en", "/en/", "/en/x?y#z", "/de/1", "/fr/", "?q=/en/", "#/en/", "/fr/" + "p" * 5000, "//", "/EN/", "/en/x\n"]
    rows = [(i, rnd.choice(["http", "https", "", "a://b"]) + "://" + rnd.choice(hosts) + rnd.choice(paths)) for i in range(400)]
    return rows + [(1, None), (1, ""), (None, "http://example.net/en/"), (7, "no scheme /x")] + rows[:30] \
        + [(9, "http://example.net/en/hot")] * 300


def test_url_filters(spark):
    rows = some_urls()
    df = spark.createDataFrame([(u, p, "h", "k") for p, u in rows], "url string, page_id long, host string, key string")
    assert rows_of(url_filters.url_filters(df.repartition(6))) == brute_filters(rows, url_filters.RULES)


def test_url_filters_with_many_nested_rules(spark):
    """Rules around rules, more than pieces; both verdicts for one rule; rules that fit nothing."""
    rnd = random.Random(8)
    rules = {(h, p): rnd.choice(["allow", "block"]) for h in ("net", "example.net", "a.example.net", "b.example.net", "org", "com")
             for p in ("", "/", "/e", "/en", "/en/", "/en/x", "/d", "/fr/")}
    listed = [(h, p, v) for (h, p), v in rules.items()]
    extra = [("net", "/en/", "allow"), ("net", "/en/", "block"), (None, "/", "block"), ("x/y", "/", "block"), ("org", "?", "block")]
    rules["net", "/en/"] = "block"
    rows = some_urls()
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(6)
    table = spark.createDataFrame(listed + extra, "host string, path string, verdict string")
    got = url_filters.judged(df, table).select("page_id", "host", "path", "rule", "verdict")
    assert rows_of(got) == brute_filters(rows, [(h, p, v) for (h, p), v in rules.items()])


def test_url_filters_without_rules(spark):
    df = spark.createDataFrame([(1, "http://example.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert rows_of(url_filters.judged(df, none, default="block").select("rule", "verdict")) == [(None, "block")]


@pytest.mark.parametrize("operator, schema", [
    (conversations.conversation_repair, TURNS), (collocations.collocations, "doc_id long, lang string, text string"),
    (url_filters.url_filters, "page_id long, url string")])
def test_empty_tables(spark, operator, schema):
    assert operator(spark.createDataFrame([], schema)).collect() == []
