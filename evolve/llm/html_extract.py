"""Main text of web pages: markup bounds it, nearest-URL differencing decides what is open.

A page's text is cut into lines at block elements.  Lines inside elements
that say they aren't the article (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts: by tag, role, class or id) are dropped.
Inside a main or article only forms, and adverts and reader comments by a whole
class or id (``ad``, ``comment-list``; not ``ad-hoc-networks``, nor the comments of
highlighted code), are dropped; under the other names, and in an article's own
``aside`` and ``footer``, the lines are open.  Formulas keep their text.
Where the page marks its article, or its ``main``, the text is that of the
element that holds the most of it, or of the whole page if more stands in
neither.  A single article that is most of that element is kept whole; lines
around it, and those of several articles, of a main without one and of a page
without a mark, are open.

Every page with a host is also told from its template by its neighbour: pages
are ordered by URL path within each host, each is paired with the neighbour
whose path shares the longest beginning, the two pages' lines are aligned by
longest common subsequence, and the lines that they share are deleted, as far
as the markup leaves them open.  (Inside a marked article shared lines stay:
a passage that two articles quote is text, not template.)

Pages of a host with the same lines are one page there, so a neighbour always
says something; no share of the page's size is too much for a template.
Where both pages have other neighbours in their folder (``REACH`` on each
side), a line must be in one of those too: what only two of several siblings
share is a passage or a near copy.

The order within a host comes from ranking the keys of all pages by a range
sort (``rank_by_sort``): no host is one task, and neighbours meet by an
exchange on (host, position).  What is ranked are keys and 4-byte line
hashes; the lines are shuffled once, to meet the indexes of the shared ones.
The html itself is never shuffled.

Defined results: null or empty html gives an empty text; a null or unusual
url has no host and no neighbour; a very long page is worked through whole (its
alignment in linear memory); repeated rows are one page among neighbours
and each give their row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.functions.ranking import rank_by_sort
from evolve.llm.common import cut, ship, slices

REACH = 2     # neighbours on each side
AT_ONCE = 64  # pages whose line hashes are Python objects at a time

# Element names of HTML and the names that pages give to parts.
RAW = "script style noscript template textarea iframe svg object title xmp noembed noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
NOT_TEXT = frozenset("head nav footer aside form button select dialog menu".split())
NOT_TEXT_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert form
menu menubar toolbar""".split())
NOT_TEXT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo
promos promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription
signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar
comment comments commentlist discussion disqus respond reply replies related recommended recommendations share
sharing social popup modal overlay widget widgets toolbar pagination pager paywall skip""".split())
# Of these, what goes inside a main or article whatever the neighbours say.
NOT_ARTICLE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo
promos comment comments commentlist disqus""".split())
# With these, such a name makes a compound name: ad-slot, comments_section.
PLACES = frozenset("""area bar block body bottom box container form google holder inline inner item items left list main
outer right section slot thread top unit wrap wrapper""".split())
INLINE = frozenset("a abbr b bdi cite code dfn em i kbd mark pre q s samp small span strong sub sup u var".split())
CONTENT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<svg\b(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>|<(" + RAW.replace(" ", "|") + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[A-Za-z0-9]+")


def _names_one(tag: str, value: str, names: frozenset[str]) -> bool:
    """Whether a whole class or id is one of the names, alone or with a place;
    comments in inline elements and code are those of highlighted source text."""
    for name in value.split():
        words = set(_NAMES.findall(name))
        if words & names and words <= names | PLACES:
            if tag not in INLINE or not words & {"comment", "comments"}:
                return True
    return False


def _says_not_text(tag: str, attributes: str, in_content: bool, in_article: bool) -> tuple[bool, bool]:
    """Whether an element isn't text, and whether that is in doubt: inside a
    main or article most names are also those of the article's own parts."""
    doubt = in_article and tag in ("aside", "footer")
    if tag in NOT_TEXT and not doubt or (tag == "header" and not in_article):
        return True, False
    if not attributes.strip():
        return False, doubt
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if name == "role" and value in NOT_TEXT_ROLES:
            return True, False
        if name in ("class", "id") and tag not in CONTENT - {"article"}:
            names = set(_NAMES.findall(value))
            said = _names_one(tag, value, NOT_ARTICLE_NAMES) if in_content else names & NOT_TEXT_NAMES
            if said or ("header" in names and not in_article):
                return True, False
            doubt = doubt or _names_one(tag, value, NOT_TEXT_NAMES)
    return False, doubt


KEPT, OPEN, OUT = 0, 1, 2   # marks of lines: text; text unless template; not in the chosen element


def _placed_lines(page: str) -> list[tuple[str, bool, int, bool]]:
    """(text, inside main, number of the outermost article or 0, in doubt) of
    every line that may be text, in order."""
    out: list[tuple[str, bool, int, bool]] = []
    stack: list[tuple[str, tuple[bool, bool, int, bool]]] = []   # tag; not text, main, article, in doubt
    buffer: list[str] = []
    articles = 0
    top = (False, False, 0, False)

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            skip, *place = stack[-1][1] if stack else top
            if text and not skip:
                out.append((text, *place))

    def close(names, barrier):
        """Pop an open element of these names, if no barrier stands above it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                under = stack[i - 1][1] if i else top
                if any(t in BLOCKS for t, _ in stack[i:]) or stack[-1][1] != under:
                    flush()
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m.group(2):
            if tag not in VOID:
                close((tag,), () if tag in BLOCKS else BLOCKS)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:   # a block ends an open paragraph; items and cells end their like
            close(("p",), BLOCKS - {"p"})
            if tag == "li":
                close(("li",), ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                close(("dd", "dt"), ("dl",))
            elif tag in ("td", "th", "tr"):
                close((tag,), ("table",))
        state = skip, main, article, doubt = stack[-1][1] if stack else top
        says, doubts = _says_not_text(tag, m.group(4), main or article > 0, article > 0)
        skip, doubt = skip or says, doubt or doubts
        if not article and (tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", m.group(4))):
            main = True
        if tag == "article" and not article and not skip:
            articles += 1
            article = articles
        if (skip, main, article, doubt) != state:
            flush()
        if not m.group(4).rstrip().endswith("/") or tag in BLOCKS:
            stack.append((tag, (skip, main, article, doubt)))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


def lines(page: str) -> tuple[list[str], bytes]:
    """The lines that may be text, and the mark of each.  The element with
    the most text (main, an article outside it, or what is in neither) is
    chosen; a single article that is most of it is kept, all else is open."""
    placed = _placed_lines(page)
    within = [0, 0, 0]                     # characters of main, of its articles, in neither
    articles: dict[int, int] = {}          # characters of each article outside main
    inner = set()
    for text, main, article, _ in placed:
        if main:
            within[0] += len(text)
            if article:
                within[1] += len(text)
                inner.add(article)
        elif article:
            articles[article] = articles.get(article, 0) + len(text)
        else:
            within[2] += len(text)
    largest = max(articles.values(), default=0)
    if within[2] > max(within[0], largest):
        chosen = [True] * len(placed)                        # the marked elements are teasers beside the text
        single = False
    elif within[0] >= largest:
        chosen = [main for _, main, _, _ in placed]
        single = len(inner) == 1 and 2 * within[1] >= within[0]
    else:
        chosen = [main or article > 0 for _, main, article, _ in placed]
        single = len(articles) == 1 and not within[0]
    marks = [OUT if not c else KEPT if single and article and not doubt else OPEN
             for c, (_, _, article, doubt) in zip(chosen, placed)]
    return [text for text, *_ in placed], bytes(marks)


def host_and_path(url: str | None) -> tuple[str | None, str]:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)", url or "")
    if not m:
        return None, ""
    path = m.group(2).rstrip("/")
    return m.group(1).lower(), re.sub(r"\.[a-zA-Z]{3,5}$", "", path)


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel LCS: bit j of row i is 0 where the LCS of a[:i + 1] and
    b[:j + 1] is longer than that with b[:j]."""
    full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def shared(a: list[int], b: list[int]) -> list[int]:
    """Indexes of ``a`` in a longest common subsequence with ``b``.  Equal
    ends are taken off first; a product too large to keep all rows of is
    halved at the split that keeps the length (Hirschberg)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    x, y = a[lo:ha], b[lo:hb]
    middle: list[int] = []
    if x and y and len(x) * len(y) > 1 << 28 and len(x) > 1:
        half = len(x) // 2
        zeros = lambda row: np.cumsum([not row >> j & 1 for j in range(len(y))])
        head = np.concatenate([[0], zeros(_rows(x[:half], y)[-1])])
        tail = np.concatenate([[0], zeros(_rows(x[half:][::-1], y[::-1])[-1])])[::-1]
        split = int(np.argmax(head + tail))
        middle = shared(x[:half], y[:split]) + [half + i for i in shared(x[half:], y[split:])]
    elif x and y:
        rows = _rows(x, y)
        i, j = len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1                       # b[j] adds nothing here
            elif i > 0 and not rows[i - 1] >> j & 1:
                i -= 1                       # the same length without a[i]
            else:
                middle.append(i)
                i, j = i - 1, j - 1
        middle.reverse()
    return list(range(lo)) + [lo + i for i in middle] + list(range(ha, len(a)))


def _hash(line: str) -> int:
    return zlib.crc32(line.encode()) - (1 << 31)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template_lines(hashes: list[int], path: str, neighbours: list[tuple[str, list[int]]]) -> list[int]:
    """Indexes of the lines that the nearest neighbour shares.  Where more
    neighbours stand in the folder of both, one of them must hold the line
    too: what only two of several siblings share is a passage or a copy."""
    if not neighbours:
        return []
    (nearest, other), *more = sorted(neighbours, key=lambda n: -_common(path, n[0]))
    gone = shared(hashes, other)
    folder = path.rpartition("/")[0]
    siblings = [h for p, h in more if p.rpartition("/")[0] == folder]
    if gone and siblings and nearest.rpartition("/")[0] == folder:
        held = set().union(*siblings)
        gone = [i for i in gone if hashes[i] in held]
    return gone


_KEYS = "host string, path string, fold binary, hashes binary"
_TEXTS = "page_id long, url string, host string, fold binary, body string, marks binary"


def _page_lines(pages: DataFrame, texts: bool) -> DataFrame:
    """Every page's host and fold (the digest of its lines' hashes), with its
    lines and their marks; else, of the pages with a host and lines, the path
    and the hashes."""
    ship(pages.sparkSession)

    def run(batches):
        for b in slices(batches, 2):
            out = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                found, marks = lines(page or "")
                host, path = host_and_path(url)
                hashes = np.array([_hash(x) for x in found], "<i4").tobytes()
                fold = hashlib.blake2b(hashes, digest_size=16).digest()
                if texts:
                    out.append((page_id, url, host, fold, "\n".join(found), marks))
                elif host is not None and found:
                    out.append((host, path, fold, hashes))
            names = [f.split() for f in (_TEXTS if texts else _KEYS).split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)],
                                             [n for n, _ in names])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, _TEXTS if texts else _KEYS)


def templates(keys: DataFrame) -> DataFrame:
    """``host, fold, gone``: the indexes of the lines that each page's nearest
    neighbour shares.  Pages of a host with the same lines are one page."""
    pages = cut(keys.groupBy("host", "fold").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes")))
    ranked = rank_by_sort(pages, ["host"], ["path", "fold"], "pos")
    steps = F.explode(F.array(*[F.lit(i) for i in range(-REACH, REACH + 1)])).alias("step")
    groups = (ranked.select("host", "pos", "fold", "path", "hashes", steps)
              .groupBy("host", (F.col("pos") - F.col("step")).alias("at"))
              .agg(F.collect_list(F.struct("step", "fold", "path", "hashes")).alias("near")))

    def run(batches):
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            out = []
            for host, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                near.sort(key=lambda n: (abs(n["step"]), n["step"]))
                if near[0]["step"] == 0:
                    own, *others = [(n["path"], np.frombuffer(n["hashes"], "<i4").tolist()) for n in near]
                    gone = template_lines(own[1], own[0], others)
                    out.append((host, near[0]["fold"], np.array(gone, "<i4").tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.binary(), pa.binary()])],
                ["host", "fold", "gone"])

    return groups.select("host", "near").mapInArrow(run, "host string, fold binary, gone binary")


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every page (ranking the keys runs a job)."""
    gone = templates(_page_lines(pages, False))
    joined = _page_lines(pages, True).join(gone, ["host", "fold"], "left").select(
        "page_id", "url", "body", "marks", "gone")

    def run(batches):
        for b in slices(batches, 2):
            texts = []
            for body, marks, gone in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                template = set(np.frombuffer(gone or b"", "<i4").tolist())
                texts.append(" ".join(x for i, (x, mark) in enumerate(zip(body.split("\n"), marks))
                                      if mark == KEPT or mark == OPEN and i not in template))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def html_extraction(pages: DataFrame) -> DataFrame:
    """The query's rows for every page."""
    return extracted(pages.select("page_id", "url", "html")).withColumn(
        "n_chars", F.length("text").cast("long"))
