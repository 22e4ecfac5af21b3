"""Main text of web pages by nearest-URL page differencing.

Each page becomes text lines, one a block. Within each host a page is paired with the page of the nearest URL path (its
neighbours in path order; the one with the longer common beginning first), the two pages' lines are aligned by their
longest common subsequence, and shared lines are deleted. A neighbour that shares most of the text is a copy of the page,
not another page of the same frame, and the other neighbour is taken, or none.

Differencing decides what of an unmarked page is frame. Markup guards it where it alone would be wrong: lines inside an
<article> are never deleted (articles of one host do share lines); elements that say by their name, role or class that
they are menus, footers, forms, adverts, notices or comments are dropped also where their lines differ from page to page;
and where a page has an article, or else a main element, lines outside are no part of the text. A class or id word does
not drop an element that holds an article or main, nor the body.

White space inside a block, line breaks (br) included, becomes one blank. Reading is linear in the page: after an attribute
quote that is never closed, tags end at their first ">"; elements nested deeper than DEEPEST count as their parent's text.
Null html is empty and gives ""; a null url belongs to the host "". Repeated pages give repeated results: identical rows
are ordered once. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk
from lodestrata.llm.shared import in_order, stash

#: Of a page's text outside articles, the share from which a neighbour counts as a copy.
COPY = 0.8
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^'\">]*")
#: Elements whose content is no text or no HTML.
RAW = frozenset("script style noscript template textarea title iframe xmp svg math canvas object audio video".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
DEEPEST = 512
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
FURNITURE = frozenset("nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id values (split at blanks, hyphens, underscores) for furniture that differs from page to page.
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert newsletter subscribe subscription signup "
    "popup modal overlay comment comments commentlist disqus respond replies share sharing social related recommended recommendations trending breadcrumb breadcrumbs pagination pager".split()
)
#: Elements that such words do not drop.
FRAME = frozenset("html body main article".split())
#: An element of these closes an open one of the set, up to the given borders.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ARTICLE, OPEN, DROP = 0, 1, 2


def furniture(name: str, rest: str) -> int:
    """2: never main text by its name, role or being hidden; 1: by a word of its class or id; 0: neither."""
    if name in FURNITURE:
        return 2
    found = 0
    if rest:
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "role" and value.strip() in ROLES or key == "aria-hidden" and value == "true":
                return 2
            if key in ("class", "id") and name not in FRAME and not WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
                found = 1
    return found


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(from, to, lower-case name, whether it closes, the rest of the tag) of each tag; comments and raw elements have name ""."""
    at, last, quotes = 0, page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0 and (lt < last or page.startswith("<!--", lt)):
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            yield lt, at, "", False, ""
            continue
        if page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            yield lt, at, "", False, ""
            continue
        m = TAG.match(page, lt)
        if not m:
            at = lt + 1
            continue
        end = PLAIN.match(page, m.end()).end()
        while quotes and end < len(page) and page[end] != ">":
            close = page.find(page[end], end + 1)
            quotes = close >= 0
            end = PLAIN.match(page, close + 1).end()
        if not quotes or end >= len(page):
            quotes, end = False, page.find(">", m.end())
        at, name, closes = end + 1, m[1].lower(), page[lt + 1] == "/"
        rest = page[m.end() : end]
        if name in RAW and not closes:
            if not rest.endswith("/") or name not in ("svg", "math"):
                stop = RAW_END[name].search(page, at)
                close = page.find(">", stop.end()) if stop else -1
                at = close + 1 if close >= 0 else len(page)
            yield lt, at, "", False, ""
        else:
            yield lt, at, name, closes, rest


class Element:
    """An open element: what it is, and what its ancestors make of it."""

    __slots__ = ("above", "article", "head", "header", "main", "name", "off", "words")

    def __init__(self, name: str, rest: str, above: Element | None):
        kind = furniture(name, rest)
        self.name, self.above = name, above
        self.words = kind == 1  # taken back if an article or main opens inside
        self.off = kind == 2 or above is not None and above.off
        self.main = above is not None and above.main or name == "main" or "main" in rest and bool(re.search(r"role\s*=\s*[\"']?main\b", rest, re.IGNORECASE))
        self.article = above is not None and above.article or (name == "article" or "articleBody" in rest) and not self.off
        self.header = name == "header" or above is not None and above.header
        self.head = name in HEADINGS or above is not None and above.head
        if (self.article or self.main) and not (above is not None and (above.article or above.main)):
            while above is not None:
                above.words = False
                above = above.above

    def dropped(self) -> bool:
        e: Element | None = self
        while e is not None and not e.words:
            e = e.above
        return self.off or e is not None


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, ARTICLE, OPEN or DROP) of each non-empty block in page order."""
    found: list[tuple[str, Element]] = []
    root = Element("", "", None)
    stack, counts = [root], Counter()
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            found.append((text, stack[-1]))

    def cut(k: int) -> None:
        counts.subtract(x.name for x in stack[k:])
        del stack[k:]

    at = 0
    for start, end, name, closes, rest in tags(page):
        if start > at:
            buffer.append(html.unescape(page[at:start]))
        at = end
        if name == "br":
            buffer.append(" ")
        if not name or name == "br":
            continue
        if name in BLOCKS:
            flush()
        if closes:
            if counts[name] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
        elif name not in VOID and not (rest.endswith("/") and name not in BLOCKS):
            if name in BLOCKS:  # a block ends an open paragraph
                k = next(k for k in range(len(stack) - 1, -1, -1) if k == 0 or stack[k].name in BLOCKS)
                if stack[k].name == "p":
                    cut(k)
            if name in CLOSES and any(counts[x] > 0 for x in CLOSES[name][0]):
                closed, border = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in border:
                        break
                    if stack[k].name in closed:
                        cut(k)
                        break
            if len(stack) <= DEEPEST:
                stack.append(Element(name, rest, stack[-1]))
                counts[name] += 1
    if at < len(page):
        tail = page[at:]
        open_ = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that the page's end cuts off
        buffer.append(html.unescape(tail[: open_.start()] if open_ else tail))
    flush()
    drop: dict[int, bool] = {}
    for _, e in found:
        if id(e) not in drop:
            drop[id(e)] = e.dropped()
    any_article = any(e.article and not drop[id(e)] for _, e in found)
    any_main = any(e.main and not drop[id(e)] for _, e in found)
    out = []
    for text, e in found:
        if drop[id(e)] or e.header and not (e.head and (e.article or e.main)):  # of a header inside an article, headings are text
            kind = DROP
        elif e.article:
            kind = ARTICLE
        elif any_main:
            kind = OPEN if e.main else DROP
        else:
            kind = DROP if any_article else OPEN
        out.append((text, kind))
    return out


def common(a: list, b: list) -> list[int]:
    """Indexes into a of a longest common subsequence with b: bit-parallel rows, halved (Hirschberg) where they would be large."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    return [*range(head), *[head + i for i in _middle(x, y)], *range(len(a) - tail, len(a))]


def _rows(a: list, b: list) -> Iterator[int]:
    where: dict = {}
    for j, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        u = row & where.get(v, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _middle(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 1 << 28:
        half = len(a) // 2
        for left in _rows(a[:half], b):
            pass
        for right in _rows(a[half:][::-1], b[::-1]):
            pass
        m = len(b)
        bits = lambda v: np.cumsum(np.append(0, 1 - np.unpackbits(np.frombuffer(v.to_bytes(-(-m // 8), "little"), np.uint8), bitorder="little")[:m].astype(np.int64)))
        cut = int((bits(left) + bits(right)[::-1]).argmax())
        return [*_middle(a[:half], b[:cut]), *[half + i for i in _middle(a[half:], b[cut:])]]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def host_and_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", re.split(r"[?#]", url or "")[0])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the lines with their kinds and hashes, and sig: what the result depends on besides the neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                pages_, urls = part.column("html").to_pylist(), part.column("url").to_pylist()
                lines = [lines_of(p or "") for p in pages_]
                places = [host_and_path(u) for u in urls]
                hashes = [np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in page], np.uint64).view(np.int64) for page in lines]
                kinds = [np.array([k for _, k in page], np.int8) for page in lines]
                sig = [xxhash.xxh64_intdigest(h.tobytes() + k.tobytes()) for h, k in zip(hashes, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array([p[0] for p in places], pa.string()),
                        pa.array([p[1] for p in places], pa.string()),
                        pa.array(np.array(sig, np.uint64).view(np.int64)),
                        pa.array([[t if k != DROP else "" for t, k in page] for page in lines], pa.list_(pa.string())),
                        tk.nested(kinds, pa.int8()),
                        tk.nested(hashes, pa.int64()),
                        tk.nested([np.array([len(t) for t, _ in page], np.int64) for page in lines], pa.int64()),
                    ],
                    names=["page_id", "url", "host", "path", "sig", "lines", "kinds", "hashes", "sizes"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, host string, path string, sig long, lines array<string>, kinds array<byte>, hashes array<long>, sizes array<long>"
    )


def shared_lines(hashes: list, kinds: list, sizes: list, near: list[list], copy: float = COPY) -> list[int]:
    """Indexes of the lines outside articles that the first neighbour which is no copy shares with the page."""
    open_ = sum(s for s, k in zip(sizes, kinds, strict=True) if k == OPEN)
    for other in near:
        gone = [i for i in common(hashes, other) if kinds[i] != ARTICLE]
        if not open_ or sum(sizes[i] for i in gone if kinds[i] == OPEN) < copy * open_:
            return gone
    return []


def _ahead(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, copy: float = COPY) -> DataFrame:
    """page_id, url, text, n_chars of each page; a neighbour that shares `copy` of the text outside articles counts as a copy."""
    rows = stash(parsed(pages), "parsed")
    # one light row (no text) for each distinct page of a host; the hot host is split by path ranges, not held in one task
    light = rows.select("host", "path", "sig", "kinds", "hashes", "sizes").dropDuplicates(["host", "path", "sig"])
    placed = in_order(light, ["host"], ["path", "sig"], ["path", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            gone = []
            for k in range(batch.num_rows):
                near = [(x[f"{w}_path"][k], x[f"{w}_hashes"][k]) for w in ("prev", "next") if x[f"{w}_hashes"][k] is not None]
                near.sort(key=lambda n, own=x["path"][k]: -_ahead(own, n[0]))
                gone.append(shared_lines(x["hashes"][k], x["kinds"][k], x["sizes"][k], [h for _, h in near], copy))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), batch.column("sig"), pa.array(gone, pa.list_(pa.int32()))], names=["host", "path", "sig", "gone"])

    gone = placed.mapInArrow(run, "host string, path string, sig long, gone array<int>")
    gone = stash(gone.where(F.size("gone") > 0), "gone")
    out = rows.select("page_id", "url", "host", "path", "sig", "lines", "kinds").join(gone, ["host", "path", "sig"], "left")
    nothing = F.array().cast("array<int>")
    marked = F.transform("lines", lambda t, i: F.struct(t.alias("t"), F.element_at("kinds", i + 1).alias("k"), F.array_contains(F.coalesce("gone", nothing), i).alias("g")))
    left = F.filter(marked, lambda x: (x["k"] == ARTICLE) | ((x["k"] == OPEN) & ~x["g"]))
    text = F.array_join(F.transform(left, lambda x: x["t"]), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


#: For pages whose text lies in one <article> of h1 and p blocks with five character references: all those of the tables.
ORACLE = r"""
with a as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '[ \t\n\x0B\f\r]+', ' ', 'g') as x from pages),
b as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g') as x from a),
c as (select page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp', '&') as x from b),
d as (
  select page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda t: trim(regexp_replace(t, ' +', ' ', 'g'))), lambda t: t <> ''), chr(10)), '') as text
  from c)
select page_id, url, text, length(text)::bigint as n_chars from d
"""
