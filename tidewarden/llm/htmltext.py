"""Main text of web pages by nearest-URL page differencing, with markup beside it.

A page is cut into lines, the blocks of its text.  Pages of a host are put in the order
of their URL paths, each is paired with the nearer of its two neighbours, all lines of
both (menus, adverts and footers too) are aligned by their longest common subsequence,
and shared lines are deleted as the site's own.  A copy of the page says nothing about
the site: then the other neighbour is taken, if it is no copy.

What the alignment leaves is main text unless the markup says that it never is: menus,
footers, forms, adverts by class name and so on.  The markup also protects: an article
or main element is to be returned whole, and articles do share lines by chance, so lines
inside one stay.  Where a page marks no article, the alignment alone decides.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_RANGES, bounded_sample, map_rows, range_bounds

#: Pages in a range of neighbours.
RANGE_ROWS = 1024
#: A neighbour is a copy if the alignment covers more than this share of the page's own text.
COPY = 0.9
#: What a line is: outside of any article, inside one, or ruled out by the markup.
OUTSIDE, INSIDE, RULED_OUT = 0, 1, 2

# Element names of the HTML standard, by what they mean here.
DROPPED = frozenset("head nav footer aside form dialog template noscript iframe object svg canvas audio video select button datalist menu".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
BLOCKS = frozenset("html body address article blockquote center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li main ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that mark what is no main text.
MARKED = frozenset("ad ads adv advert adverts advertisement advertisements advertising alert alerts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
MARKED_ARTICLE = frozenset("ad ads advert advertisement comment comments disqus promo replies reply sponsored".split())

HEADED = frozenset("article content entry post story".split())  # their headers are part of the text

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|noembed|noframes)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
HEADER = frozenset("header page site".split())  # a token of these words with "header" is a page header
INERT = frozenset("head template noscript iframe object svg canvas audio video select button datalist".split())  # left out even around an article


def read_attributes(attributes: str) -> tuple[list[set[str]], bool]:
    """Words of each token of class, id and role, and whether the element is hidden."""
    tokens, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            tokens += [{w for w in _SPLIT.split(t) if w} for t in value.lower().split()]
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            hidden = True
    return [t for t in tokens if t], hidden


def marked(tokens: list[set[str]], words: frozenset[str]) -> bool:
    """Whether a whole token consists of the words: ``cookie-notice`` does, ``has-sidebar`` does not."""
    return any(t <= words for t in tokens)


# Open elements that an element closes if they were left open, and what it does not look beyond.
_CELL_END = ("table",)
_LIST_END = ("ul", "ol", "menu", "dl", "table", "article", "main", "section", "nav", "aside", "header", "footer", "form", "blockquote", "body")
_IMPLIED_END = {"li": (("li",), _LIST_END), "dt": (("dt", "dd"), _LIST_END), "dd": (("dt", "dd"), _LIST_END), "tr": (("tr", "td", "th"), _CELL_END), "td": (("td", "th"), (*_CELL_END, "tr")), "th": (("td", "th"), (*_CELL_END, "tr"))}
_PARAGRAPH = (("p",), ("table", "td", "th", "body"))


class _Mark:
    """A left-out element: whether it still is, its name, and the one around it."""

    __slots__ = ("around", "name", "out")

    def __init__(self, name: str, around: _Mark | None):
        self.out, self.name, self.around = True, name, around


class _Open:
    """The open elements that matter, with the places of each name: every step takes constant time on average."""

    def __init__(self):
        self.stack: list[tuple[str, _Mark | None]] = []
        self.places: dict[str, list[int]] = {}
        self.mark: _Mark | None = None
        self.settled = 0  # marks at the bottom that an article has already been found in
        self.marks: list[_Mark] = []
        self.articles = 0

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, left_out: bool) -> None:
        mark = None
        if left_out:
            mark = self.mark = _Mark(name, self.mark)
            self.marks.append(mark)
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, mark))
        self.articles += name in ("article", "main")

    def close(self, to: int) -> None:
        while len(self.stack) > to:
            name, mark = self.stack.pop()
            self.places[name].pop()
            if mark:
                self.mark = mark.around
                self.marks.pop()
                self.settled = min(self.settled, len(self.marks))
            self.articles -= name in ("article", "main")

    def close_implied(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        bound = self.last(within)
        found = [p[-1] for n in names if (p := self.places.get(n)) and p[-1] > bound]
        if found:
            self.close(min(found))

    def holds_article(self) -> None:
        """What is around holds an article or main element, so it is not left out."""
        for mark in self.marks[self.settled :]:
            mark.out = mark.name in INERT or mark.name == "article"
        self.settled = len(self.marks)


def blocks(page: str) -> list[tuple[str, int]]:
    """Blocks of a page in order, each with what it is; scripts, templates and other inert parts have none.

    An element that turns out to hold an article or main element of its own is not ruled
    out.  The time is in proportion to the page, however its elements are nested.
    """
    out: list[tuple[list, bool]] = []
    line: list[tuple[str, _Mark | None]] = []  # pieces of text, and the innermost left-out element around each
    opened = _Open()

    def close_block() -> None:
        if line:
            out.append((line.copy(), opened.articles > 0))
            line.clear()

    last = 0
    for piece in _PIECE.finditer(page):
        if piece.start() > last:
            line.append((page[last : piece.start()], opened.mark))
        last = piece.end()
        name = (piece["name"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS or name in DROPPED
        if name == "br":
            line.append((" ", opened.mark))
        elif piece["end"]:
            if block:
                close_block()
            if (at := opened.last((name,))) >= 0:
                opened.close(at)
        elif name in VOID:
            if name == "hr":
                close_block()
        else:
            if block:
                close_block()
                if name in _IMPLIED_END:
                    opened.close_implied(*_IMPLIED_END[name])
                else:
                    opened.close_implied(*_PARAGRAPH)
                if name == "body":
                    opened.close(0)
            attributes = piece["attributes"] or ""
            tokens, hidden = read_attributes(attributes) if attributes.strip() else ([], False)
            if name in ("article", "main", "body", "html"):
                left_out = name == "article" and marked(tokens, MARKED_ARTICLE)
                if name in ("article", "main") and not left_out:
                    opened.holds_article()
            else:
                left_out = name in DROPPED or (name == "header" and not opened.articles) or hidden or marked(tokens, MARKED)
                if not left_out and not opened.articles and not any(t & HEADED for t in tokens):
                    left_out = any("header" in t and t <= HEADER for t in tokens)
            if left_out and not block:
                line.append((" ", opened.mark))
            if left_out or block:
                opened.push(name, left_out)
    if last < len(page):
        line.append((page[last:], opened.mark))
    close_block()
    return _judged(out)


def _judged(out: list[tuple[list, bool]]) -> list[tuple[str, int]]:
    """Texts of blocks from their pieces, once it is known which elements are left out."""
    known: dict[_Mark | None, int] = {None: 0}  # 1 for what is ruled out, 2 for what is inert

    def state(mark: _Mark | None) -> int:
        path = []
        while mark not in known:
            path.append(mark)
            mark = mark.around
        for m in reversed(path):
            known[m] = max(known[m.around], (2 if m.name in INERT else 1) if m.out else 0)
        return known[path[0]] if path else known[mark]

    found = []
    for pieces, article in out:
        states = [state(m) for _, m in pieces]
        for wanted, kind in ((0, INSIDE if article else OUTSIDE), (1, RULED_OUT)):
            text = " ".join("".join(html.unescape(t) for (t, _), s in zip(pieces, states, strict=True) if s == wanted).split()) if wanted in states else ""
            if text:
                found.append((text, kind))
    return found


def _mask(places: Sequence[int]) -> int:
    """The whole number with a bit at each of the increasing places."""
    if len(places) <= 32:
        out = 0
        for j in places:
            out |= 1 << j
        return out
    held = bytearray(places[-1] // 8 + 1)
    for j in places:
        held[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(held, "little")


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: one whole number per line of ``a`` holds a row of the table, so a page
    of n lines against one of m takes n * m / 64 steps.  Only every sqrt(n)-th row is kept
    and those between are computed again on the way back: 2 * sqrt(n) * m bits, and m / 32
    bits a line for lines that stand over 32 times.
    """
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    kept = {*range(begin), *range(len(a) - end, len(a))}
    own, other = a[begin : len(a) - end], b[begin : len(b) - end]
    needed = set(own)
    where: dict[str, list[int]] = {}
    for j, text in enumerate(other):
        if text in needed:
            where.setdefault(text, []).append(j)
    masks = {text: _mask(places) for text, places in where.items() if len(places) > 32}  # of others a mask is soon made again
    full = (1 << len(other)) - 1

    def rows_after(row: int, begin: int, end: int) -> list[int]:
        rows = [row]
        for text in own[begin:end]:
            hit = row & (masks[text] if text in masks else _mask(where.get(text, ())))
            row = ((row + hit) | (row - hit)) & full
            rows.append(row)
        return rows

    step = math.isqrt(len(own)) + 1
    firsts, row = [], full  # the row before every step-th line
    for start in range(0, len(own), step):
        firsts.append(row)
        row = rows_after(row, start, start + step)[-1]
    i, j = len(own), len(other)
    for start in range((len(firsts) - 1) * step, -1, -step):
        rows = rows_after(firsts[start // step], start, i)
        while i > start and j:
            if rows[i - start] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - start - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                kept.add(begin + i)
        i = start
        if not j:
            break
    return kept


def shared_lines(own: list[tuple[str, int]], other: list[str]) -> set[int]:
    """Places of the lines shared with ``other``; of two longest alignments the one with less of the article."""
    lines = [text for text, _ in own]
    found = common_lines(lines, other)
    if any(own[i][1] == INSIDE for i in found) and any(kind != INSIDE for _, kind in own):
        turned = {len(lines) - 1 - i for i in common_lines(lines[::-1], other[::-1])}
        found = min(found, turned, key=lambda x: sum(own[i][1] == INSIDE for i in x))
    return found


def frame(own: list[tuple[str, int]], others: list[list[str]]) -> set[int]:
    """Places of a page's lines that the pages beside it, nearest first, show to be the site's own."""
    content = INSIDE if any(kind == INSIDE for _, kind in own) else OUTSIDE
    size = sum(len(text) for text, kind in own if kind == content)
    shared = [shared_lines(own, other) for other in others]
    # An alignment that takes nearly all of the content found a copy of it, not the site's frame.
    shared = [x for x in shared if sum(len(own[i][0]) for i in x if own[i][1] == content) <= COPY * size]
    return {i for i in shared[0] if own[i][1] != INSIDE} if shared else set()


def main_text(own: list[tuple[str, int]], *others: list[str]) -> str:
    """The main text of a page's blocks, given the lines of the pages beside it, nearest first."""
    gone = frame(own, [x for x in others if x])
    return "\n".join(text for i, (text, kind) in enumerate(own) if kind != RULED_OUT and i not in gone)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the URL filters take them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _key(url: str | None, page: int | None) -> str:
    """Place in the order over host, path, URL and page; equal URLs go by page_id, null first."""
    host, path = split_url(url)
    return f"{host}\x00{path}\x00{url or ''}\x00{'' if page is None else format(page + 2**63, '020d')}"


def _nearness(a: str, b: str) -> int:
    """Length of the common beginning of two keys; -1 for another host."""
    if a.split("\x00")[0] != b.split("\x00")[0]:
        return -1
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


SCHEMA = "page_id long, url string, text string, n_chars long"
CUT = "page_id long, url string, lines array<string>, kinds array<byte>, k string, range int, guest boolean"


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page, a row for each row of ``pages``.

    A null or empty page has the empty text.  Pages without a URL share the empty host.
    Equal URLs are neighbours in the order of page_id, null first; of two neighbours that
    are equally near the one before counts as nearer.  Repeated rows are copies of each other and come back
    repeated.  A very long page is read whole, in time and memory in proportion to it but for
    the alignment of ``common_lines``.  Other columns are ignored and an empty table gives no rows.

    No host is gathered: the order over (host, path, url, page_id) is cut into ranges by
    bounds from a bounded sample of keys, each read by one task as a stream; the pages at
    both ends of a range also go, as guests, to the ranges beside it, so bounds move work
    between tasks and change no pair.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    total = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_ROWS)))
    sample = bounded_sample(rows, F.struct(F.coalesce("url", F.lit("")).alias("url"), "page_id"), 8 * ranges, total) if ranges > 1 else []
    bounds = range_bounds([_key(r.url, r.page_id) for r in sample], ranges)
    # Ends of each range: two keys, whatever its size.

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[str, str]] = {}
        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                key = _key(url, page)
                place = bisect_right(bounds, key)
                low, high = found.get(place, (key, key))
                found[place] = min(low, key), max(high, key)
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), *(pa.array([x[i] for x in found.values()], pa.string()) for i in (0, 1))], ["range", "low", "high"])

    reduced = rows.select("url", "page_id").mapInArrow(ends, "range long, low string, high string")
    known = sorted(tuple(r) for r in reduced.groupBy("range").agg(F.min("low"), F.max("high")).collect())
    guests: dict[str, list[int]] = {}
    for (left, _, high), (right, low, _) in zip(known, known[1:], strict=False):
        guests.setdefault(high, []).append(right)
        guests.setdefault(low, []).append(left)
    shared = spark.sparkContext.broadcast((bounds, guests))  # bounded by MOST_RANGES

    def cut_up(row: tuple) -> Iterator[tuple]:
        bounds, guests = shared.value
        page, url, text = row
        key = _key(url, page)
        found = blocks(text or "")
        made = (page, url, [t for t, _ in found], [k for _, k in found], key)
        yield *made, bisect_right(bounds, key), False
        for place in guests.get(key, ()):
            yield *made, place, True

    def result(before: tuple | None, row: tuple, after: tuple | None) -> tuple:
        near = [(_nearness(row[4], x[4]), i, x) for i, x in ((1, before), (0, after)) if x and x[5] == row[5]]
        near.sort(key=lambda x: x[:2], reverse=True)
        text = main_text(list(zip(row[2], row[3], strict=True)), *(x[2] for n, _, x in near if n >= 0))
        return row[0], row[1], text, len(text)

    def paired(rows: Iterator[tuple]) -> Iterator[tuple]:
        before = row = None
        for after in rows:
            if row and not row[6]:
                yield result(before, row, after)
            before, row = row, after
        if row and not row[6]:
            yield result(before, row, None)

    dealt = map_rows(rows, lambda found: (x for row in found for x in cut_up(row)), CUT)
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "k", "guest")
    return map_rows(ordered, paired, SCHEMA)
